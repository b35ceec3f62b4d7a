"""Files of filings, ground truth, runs and configurations."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_filings(spark: SparkSession, base: str) -> DataFrame:
    """One row per `primary.html` below `base` with the metadata beside it: path, html, cik, accession_number, form_type, filing_date (SRC-01)."""
    html = spark.read.text(f"{base}/*/primary.html", wholetext=True).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("path"), F.col("value").alias("html"))
    schema = "cik string, accession_number string, form_type string, filing_date string"
    meta = spark.read.schema(schema).json(f"{base}/*/metadata.json", multiLine=True).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("path"), "*")
    return html.join(meta, "path", "left")


def document_head(df: DataFrame, n: int, column: str = "html") -> DataFrame:
    """The first `n` characters of each document (SRC-12)."""
    return df.withColumn(column, F.substring(column, 1, n))


def read_bodies(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """JSON files of a folder as bodies for `operators.nested`: record_id, record_kind, body (SRC-13, SRC-14, SRC-19..23)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.xxhash64(F.input_file_name()).alias("record_id"), F.lit(kind).alias("record_kind"), F.col("value").alias("body"))


def id_lists(spark: SparkSession, *files: str) -> DataFrame:
    """The distinct ids of JSON files that hold lists of ids (SRC-08)."""
    df = spark.read.text(list(files), wholetext=True)
    return df.select(F.explode(F.from_json("value", "array<string>")).alias("cik")).distinct()


def deep_merge(base: dict, override: dict) -> dict:
    """`base` with the values of `override`, merged level by level (SC-60)."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def config_hash(config: dict, without: tuple[str, ...] = ("metadata",)) -> str:
    """Twelve characters that name a configuration, whatever the order of its keys (SC-61)."""
    text = json.dumps({k: v for k, v in config.items() if k not in without}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def load_config(path: str, base: str | None = None) -> dict:
    """A YAML or JSON configuration over an optional base (SRC-16, SRC-17)."""

    def read(p: str) -> dict:
        text = Path(p).read_text()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml  # optional: JSON needs none

        return yaml.safe_load(text) or {}

    return deep_merge(read(base), read(path)) if base else read(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON lines, partitioned by a column if one is named (SNK-02, SNK-03, SNK-06, SNK-11)."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_errors(results: DataFrame, path: str) -> None:
    """The rows that are not correct, as CSV with a header (SNK-05)."""
    results.where("not correct").write.mode("overwrite").csv(path, header=True)


# The types of a main document in a filing's index page.
MAIN_TYPES = ("N-2", "N-2/A", "N-2 POS", "N-2 MEF")


def main_document(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The link to the main document in each index page (SRC-11): key, href; null if there is none.

    The first table row whose fourth cell is one of MAIN_TYPES, else the first link to a page that is no index, exhibit or
    graphic. A viewer's wrapper around a path is taken off. Done by array functions over the page's rows.
    """
    text = lambda c: F.upper(F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", "")))
    link = lambda c: F.regexp_extract(c, r"(?i)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)", 1)
    bare = lambda c: F.regexp_replace(c, r"^.*/ix\?doc=", "")
    page = lambda c: F.lower(c).rlike(r"\.html?$")
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    typed = F.filter(rows, lambda r: F.coalesce(text(F.get(cells(r), F.lit(3))).isin(*MAIN_TYPES), F.lit(False)) & page(link(r)))
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)"), F.lit(1))
    others = F.filter(links, lambda h: page(h) & ~F.lower(h).rlike("index|ex-|exhibit|graphic"))
    return pages.select(key, bare(F.coalesce(link(F.get(typed, F.lit(0))), F.get(others, F.lit(0)))).alias("href"))
