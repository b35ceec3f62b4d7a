"""Quarter tables: which quarters there are, their TSV files, their Parquet store."""

from __future__ import annotations

import zipfile
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Null spellings in the TSV files, and the first quarter published.
TSV_NULLS = ("", "NA", "N/A")
FIRST_QUARTER = date(2019, 10, 1)


def available_quarters(spark: SparkSession, today: date, first: date = FIRST_QUARTER) -> DataFrame:
    """`quarter` from the first published to the last one complete at `today` (SRC-07)."""
    last = F.add_months(F.date_trunc("quarter", F.lit(today).cast("date")).cast("date"), -3)
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), last, F.expr("interval 3 months"))).alias("d"))
    return starts.select(F.concat(F.year("d"), F.lit("q"), F.quarter("d")).alias("quarter"))


def nulls_of_tsv(df: DataFrame) -> DataFrame:
    """Text columns with every null spelling as null; Spark's reader takes only one."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*TSV_NULLS), F.col(c)) for c in text})


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV file with header, all columns as text by a stated schema (SRC-03)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return nulls_of_tsv(spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False, quote=""))


def unpack_member(archive: str, name: str, to: str) -> str | None:
    """Unpack the archive's member whose name ends in `name`.tsv (any case) to the folder `to`; None if there is none."""
    with zipfile.ZipFile(archive) as z:
        member = next((m for m in z.namelist() if m.lower().endswith(f"{name.lower()}.tsv")), None)
        return z.extract(member, to) if member else None


def read_store(spark: SparkSession, base: str, name: str, quarters: list[str] | None = None) -> DataFrame:
    """A stored table over all quarters in one partitioned read, or over some, which prunes folders (SRC-04, SRC-06)."""
    df = spark.read.parquet(f"{base}/{name}")
    return df.where(F.col("quarter").isin(quarters)) if quarters is not None else df


def overwrite_quarters(df: DataFrame, base: str, name: str) -> None:
    """Write `df` by quarter; quarters it holds are replaced, others stay (SNK-01, SNK-13..17)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter").parquet(f"{base}/{name}")


def stored(base: str, name: str, quarter: str) -> bool:
    """True if the local store has that quarter (SRC-05)."""
    return any(Path(base, name, f"quarter={quarter}").glob("*.parquet"))


def index_lines(lines: DataFrame, since: Column | None = None) -> DataFrame:
    """Filings of registration forms in quarterly index lines (SRC-10).

    lines: `value`, `line_no`. Gives company, form_type, cik (ten digits), filing_date, path, accession_number: the first per
    (cik, accession number). Lines that are no such filing, or older than `since`, are left out.
    """
    form = r"(N-2(?:/A|ASR|MEF)?)"
    line = rf"^(.*?)\s+{form}\s+([0-9]{{1,10}})\s+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\s+(\S+)\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    df = lines.where(F.col("value").rlike(line)).select("line_no", F.trim(part(1)).alias("company"), part(2).alias("form_type"), F.lpad(part(3), 10, "0").alias("cik"), part(4).try_cast("date").alias("filing_date"), part(5).alias("path"))
    df = df.withColumn("accession_number", F.regexp_extract("path", r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1)).where("accession_number <> ''")
    if since is not None:
        df = df.where(F.col("filing_date") >= since)
    return df.groupBy("cik", "accession_number").agg(F.min_by(F.struct("company", "form_type", "filing_date", "path"), "line_no").alias("r")).select("cik", "accession_number", "r.*")
