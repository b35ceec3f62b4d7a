"""Sequential chunking with back-overlap, and trees of summaries over chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.predictor import LeadPredictor, Predictor, embed, predict
from ledgerloom.workspace import in_workers, materialise

#: Where a chunk may end, strongest first.
ENDS = tuple(re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n\s*", r"(?<=[.!?])\s+", r"\s+"))
#: Characters that a cluster's summary is made of, and the nodes or seeds of a document that are compared at once.
SUMMARY_CHARS, BLOCK = 4000, 1024
CHUNKS = "chunk_index int, char_start int, char_end int, token_count int, content string"


def token_estimate(n_chars: int) -> int:
    """Tokens of a text where no tokenizer is at hand: a quarter of its characters (CH-04)."""
    return n_chars // 4


def cut(text: str, start: int, limit: int) -> int:
    """Where a chunk from `start` ends (CH-02, CH-03): after the last strongest boundary within the limit, else at the limit."""
    if len(text) - start <= limit:
        return len(text)
    for pattern in ENDS:
        ends = [m.start() for m in pattern.finditer(text, start, min(len(text), start + limit + 1)) if start < m.start() <= start + limit]
        if ends:
            return ends[-1]
    return start + limit


def chunk_spans(text: str | None, max_tokens: int, overlap_tokens: int) -> Iterator[tuple[int, int]]:
    """Spans of the chunks of a text (CH-01): each next one starts `overlap` before its predecessor's end, but at least one character on.

    Offsets are exact: a span without the white space at its ends. The overlap is at most half of the predecessor.
    """
    text, start = text or "", 0
    while start < len(text):
        end = cut(text, start, 4 * max_tokens)
        body = text[start:end]
        left, right = start + len(body) - len(body.lstrip()), end - (len(body) - len(body.rstrip()))
        if left < right:
            yield left, right
        if end >= len(text):
            return
        start = max(start + 1, end - min(4 * overlap_tokens, (end - start) // 2))


def chunk_texts(df: DataFrame, key: str, text: str, max_tokens: int = 500, overlap_tokens: int = 50) -> DataFrame:
    """Chunks of every text: key, chunk_index, char_start, char_end, token_count, content. Null and blank texts give none.

    Sequential by nature, so it runs in Arrow batches without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e, token_estimate(e - s), t[s:e]) for k, t in zip(b[key], b[text]) for i, (s, e) in enumerate(chunk_spans(t, max_tokens, overlap_tokens))]
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in CHUNKS.split(", ")]])

    return in_workers(df.select(key, text)).mapInPandas(run, f"`{key}` {kind}, {CHUNKS}")


class _Units(HTMLParser):
    """A document as a run of units in order: plain text, and tables and lists, each whole."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.units: list[tuple[str, list[str]]] = [("text", [])]
        self.inside: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("table", "ul", "ol"):
            if not self.inside:
                self.units.append(("table" if tag == "table" else "list", []))
            self.inside.append(tag)
        elif tag in ("p", "div", "tr", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.units[-1][1].append("\n" if self.inside or tag == "br" else "\n\n")
        elif tag in ("td", "th"):
            self.units[-1][1].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.inside:
            while self.inside.pop() != tag:
                pass
            if not self.inside:
                self.units.append(("text", []))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.units[-1][1].append(data)


def html_units(html: str | None) -> list[tuple[str, str]]:
    """Units of a document in order (CH-06): kind and text, white space tidied, empty ones left out."""
    p = _Units()
    p.feed(html or "")
    p.close()
    tidy = lambda parts: re.sub(r"[ \t\r]*\n[ \t\r]*", "\n", re.sub(r"[ \t\r]+", " ", "".join(parts))).strip()
    return [(k, t) for k, parts in p.units if (t := re.sub(r"\n{3,}", "\n\n", tidy(parts)))]


def chunk_html(df: DataFrame, key: str, html: str, max_tokens: int = 500, overlap_tokens: int = 50) -> DataFrame:
    """Chunks of HTML (CH-05, CH-07): key, chunk_index, kind, content. Tables and lists that fit stay whole, others and text are cut as texts are."""
    kind = df.schema[key].dataType.simpleString()

    def chunks(text: str | None) -> Iterator[tuple[str, str]]:
        for unit, t in html_units(text):
            if unit != "text" and len(t) <= 4 * max_tokens:
                yield unit, t
            else:
                yield from ((unit, t[s:e]) for s, e in chunk_spans(t, max_tokens, overlap_tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, u, t) for k, h in zip(b[key], b[html]) for i, (u, t) in enumerate(chunks(h))], columns=[key, "chunk_index", "kind", "content"])

    return in_workers(df.select(key, html)).mapInPandas(run, f"`{key}` {kind}, chunk_index int, kind string, content string")


def starts(texts: Column) -> Column:
    """The default summary of a cluster: the starts of its texts, together at most SUMMARY_CHARS characters."""
    share = F.greatest(F.lit(1), F.floor((F.lit(SUMMARY_CHARS) - 3 * (F.size(texts) - 1)) / F.size(texts))).cast("int")
    return F.array_join(F.transform(texts, lambda t: F.substring(t, F.lit(1), share)), " … ")


def _nearest_seeds(nodes: DataFrame) -> DataFrame:
    """Each node's nearest seed (pos below k) of its document by squared distance, ties to the lower one: document, pos, cluster.

    Nodes and seeds of a document are packed into blocks and joined on the document; nothing is broadcast by need or collected.
    """
    pack = lambda df, name: df.groupBy("document", F.floor(F.col("pos") / BLOCK).alias(f"{name}_block")).agg(F.collect_list(F.struct("pos", "embedding")).alias(name))
    a, b = pack(nodes, "rows"), pack(nodes.where("pos < k"), "seeds").withColumnRenamed("document", "__d")
    pairs = a.join(b, F.col("document").eqNullSafe(F.col("__d"))).select("document", "rows", "seeds")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def matrix(items: list) -> tuple[np.ndarray, np.ndarray]:
            at, m = np.array([x["pos"] for x in items]), np.array([x["embedding"] for x in items], dtype=np.float64)
            order = np.argsort(at)
            return at[order], m[order]

        for batch in batches:
            for document, rows, seeds in zip(batch["document"], batch["rows"], batch["seeds"]):
                (ra, rm), (sa, sm) = matrix(rows), matrix(seeds)
                d = np.round((rm * rm).sum(1)[:, None] + (sm * sm).sum(1)[None, :] - 2 * rm @ sm.T, 6)
                near = d.argmin(axis=1)
                yield pd.DataFrame({"document": document, "pos": ra, "cluster": sa[near], "distance": d[np.arange(len(ra)), near]})

    found = in_workers(pairs).mapInPandas(best, "document string, pos int, cluster int, distance double")
    return found.groupBy("document", "pos").agg(F.min(F.struct("distance", "cluster"))["cluster"].alias("cluster"))


def summary_tree(chunks: DataFrame, key: str, text: str, per_cluster: int = 8, levels: int = 3, document: str | None = None, summarise: Callable[[Column], Column] = starts) -> DataFrame:
    """A tree of cluster summaries over the chunks of each document (CH-20..24): document (if named), level, node_id, text, parent_id.

    On each level a document of n nodes has n // per_cluster clusters, one if n is at most per_cluster: each node goes to
    the nearest of so many centroids, the document's nodes of lowest key, so runs agree. A cluster is summarised by
    `summarise` from the array of its first five texts, as in the reference. A document ends with one node or at the highest level.
    Without `document` all chunks are one document's. The loop is bounded by `levels`; each level is written, so the plan stays short.
    """
    owner = F.col(document).cast("string") if document else F.lit(None).cast("string")
    level = chunks.where(F.char_length(text) > 0).select(owner.alias("document"), F.lit(0).alias("level"), F.col(key).cast("string").alias("node_id"), F.col(text).alias("text"), F.col(key).alias("place"))
    columns = ["document", "level", "node_id", "text", "parent_id"]
    parentless = lambda df: df.withColumn("parent_id", F.lit(None).cast("string")).select(columns)
    out = None
    for n in range(levels):
        w = Window.partitionBy("document")
        size = F.count("*").over(w)
        placed = level.withColumns({"pos": F.row_number().over(w.orderBy("place", "text")) - 1, "k": F.greatest(F.lit(1), F.floor(size / per_cluster)).cast("int"), "size": size}).drop("place")
        nodes = materialise(embed(placed, "text"), "tree")
        out = parentless(nodes.where("size = 1")) if out is None else out.unionByName(parentless(nodes.where("size = 1")))
        many = nodes.where("size > 1")
        if many.isEmpty():
            return out if document else out.drop("document")
        near = _nearest_seeds(many).select(F.col("document").alias("__d"), F.col("pos").alias("__p"), "cluster")
        parent = F.concat_ws("/", "document", F.format_string("L%d-%d", F.lit(n + 1), F.col("cluster")))
        joined = many.join(near, F.col("document").eqNullSafe(F.col("__d")) & (F.col("pos") == F.col("__p")))
        joined = materialise(joined.select("document", "level", "node_id", "text", parent.alias("parent_id"), "pos", "cluster"), "tree")
        out = out.unionByName(joined.select(columns))
        first = F.row_number().over(Window.partitionBy("document", "cluster").orderBy("pos"))
        tops = joined.withColumn("rn", first).where("rn <= 5").groupBy("document", "cluster", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("parts"))
        level = tops.select("document", F.lit(n + 1).alias("level"), "node_id", summarise(F.transform("parts", lambda p: p["text"])).alias("text"), F.col("cluster").alias("place"))
    out = parentless(level) if out is None else out.unionByName(parentless(level))
    return out if document else out.drop("document")


def section_summaries(chunks: DataFrame, document: str, section: str, title: str, position: str, text: str, predictor: Predictor | None = None) -> DataFrame:
    """A summary of each section (CH-16, CH-17): document, section, title, place, summary. Sections without an answer have no row.

    A section speaks by its first ten chunks, as far as those before hold at most 8000 characters, and of their text by the first
    6000; the question is its title. place orders the sections of a document: their least position, then their key.
    """
    w = Window.partitionBy(document, section).orderBy(position, text)
    size = F.coalesce(F.char_length(text), F.lit(0)) + 2
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.min(F.struct("__rn", title))[title]
    rows = chunks.withColumns({"__rn": F.row_number().over(w), "__before": before}).where("__rn <= 10 and __before <= 8000")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.coalesce(text, F.lit("")).alias("t")))), lambda p: F.concat(p["t"], F.lit("\n\n"))), "")
    sections = rows.groupBy(document, section).agg(first.alias(title), F.min(position).alias("place"), F.substring(joined, 1, 6000).alias("__text"))
    return predict(sections, title, "__text", predictor or LeadPredictor()).where("answer <> ''").select(document, section, title, "place", F.col("answer").alias("summary"))


def document_summaries(sections: DataFrame, document: str, section: str, title: str, predictor: Predictor | None = None) -> DataFrame:
    """A summary of each document from those of its sections in order (CH-18): document, summary. sections: from `section_summaries`."""
    line = F.concat(F.lit("**"), F.coalesce(title, F.lit("")), F.lit("**: "), "summary")
    parts = F.array_sort(F.collect_list(F.struct("place", section, line.alias("line"))))
    texts = sections.groupBy(document).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("__text")).withColumn("__q", F.lit("document"))
    return predict(texts, "__q", "__text", predictor or LeadPredictor()).where("answer <> ''").select(document, F.col("answer").alias("summary"))
