"""Retrieval: lexicon scores, top-k per group, dense search, rank fusion, packing, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.predictor import word_overlap
from ledgerloom.workspace import in_workers

#: A small default lexicon: field → {weight: terms}. Pass another of the same shape for other corpora.
LEXICON: dict[str, dict[int, tuple[str, ...]]] = {
    "repurchase": {3: ("repurchase offer", "tender offer"), 2: ("repurchase", "redemption"), 1: ("shares", "notice"), -2: ("borrow",)},
    "leverage": {3: ("asset coverage", "credit facility"), 2: ("borrow", "leverage"), 1: ("debt", "facility"), -2: ("repurchase offer",)},
    "fees": {3: ("management fee", "incentive fee"), 2: ("waiver", "expense"), 1: ("fee", "annual"), -2: ("glossary",)},
}


def lexicon_score(text: Column, terms: dict[int, tuple[str, ...]]) -> Column:
    """Sum of the weights of the terms that occur in `text` (RT-01, RT-07): occurrence counts once. Null text scores 0.

    One projection per field, no join: a lexicon is a parameter of bounded size, the texts are the data.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(t)), w).otherwise(0) for w, ts in terms.items() for t in ts), F.lit(0))


def score_sections(df: DataFrame, lexicon: dict[str, dict[int, tuple[str, ...]]], text: str = "content", title: str = "section_title", bonus: int = 5, too_long: int = 50_000) -> DataFrame:
    """A row per input row and field with its score: terms in the text, a bonus for a title term, −10 for an overlong text."""
    found = lambda terms: F.greatest(*[F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(t)) for w, ts in terms.items() if w > 1 for t in ts])
    scores = F.array(*[
        F.struct(F.lit(f).alias("field"), (lexicon_score(F.col(text), t) + F.when(found(t), bonus).otherwise(0) - F.when(F.char_length(text) > too_long, 10).otherwise(0)).alias("score")) for f, t in lexicon.items()
    ])
    return df.withColumn("s", F.explode(scores)).withColumns({"field": F.col("s.field"), "score": F.col("s.score")}).drop("s")


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows per group with their rank from 1 (RT-02). Spark keeps only k per group and task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def padded_top(df: DataFrame, groups: list[str], score: str, position: Column, most: int, least: int) -> DataFrame:
    """The best `most` rows with a score above 0; groups with under `least` such rows are filled up from the others in order (RT-03)."""
    w = Window.partitionBy(*groups)
    df = df.withColumn("__hits", F.sum(F.when(F.col(score) > 0, 1).otherwise(0)).over(w))
    rank = F.row_number().over(w.orderBy(F.desc(score), position))
    limit = F.when(F.col("__hits") < least, max(most, least)).otherwise(F.least(F.col("__hits"), F.lit(most)))
    return df.withColumn("rank", rank).where(F.col("rank") <= limit).drop("__hits")


# Above so many chunks, the most sections, chunks of a section, chunks of the first pass and reranked chunks.
SETTINGS = {2000: (20, 15, 400, 25), 1000: (15, 12, 300, 20), 500: (10, 10, 200, 15), 0: (5, 10, 50, 10)}


def adaptive_settings(n: Column) -> Column:
    """Steps of settings by the size of a document in chunks (RT-04): struct(top_k, chunks_per_section, first_pass, reranked)."""
    names = ("top_k", "chunks_per_section", "first_pass", "reranked")
    steps = [(above, F.struct(*[F.lit(x).alias(name) for name, x in zip(names, values)])) for above, values in SETTINGS.items()]
    return F.coalesce(*[F.when(n > above, step) for above, step in steps], steps[-1][1])


def rerank(df: DataFrame, groups: list[str], order: list[Column], query: str, text: str, scorer: Callable[[str, list[str]], list[float]] | None = word_overlap, first_pass: int = 50, k: int = 15, threshold: float = 0.3) -> DataFrame:
    """The first `first_pass` rows per group, scored anew, the best k with at least `threshold` (RT-05): adds original_index, relevance.

    `scorer` gets a group's query and texts in one call. Where it fails, the group keeps its first k rows with relevance 1, whatever
    the threshold; without a scorer all rows stay with relevance 1. Only texts go to Python, at most `first_pass` a group.
    """
    placed = df.withColumn("original_index", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    if scorer is None:
        return placed.withColumn("relevance", F.lit(1.0))
    in_workers(df)

    @F.pandas_udf("array<double>")
    def scored(queries: pd.Series, texts: pd.Series) -> pd.Series:
        def one(q: str | None, ts: list[str | None]) -> list[float] | None:
            try:
                got = [float(s) for s in scorer(q or "", [t or "" for t in ts])]
                return got if len(got) == len(ts) else None
            except Exception:  # whatever an outside service raises
                return None

        return pd.Series([one(q, ts) for q, ts in zip(queries, texts)], dtype=object)

    rows = F.array_sort(F.collect_list(F.struct("original_index", *[c for c in df.columns if c not in groups])), lambda a, b: a["original_index"] - b["original_index"])
    packed = placed.where(F.col("original_index") < first_pass).groupBy(*groups).agg(rows.alias("__rows"))
    packed = packed.withColumn("__scores", scored(F.col("__rows")[0][query] if query not in groups else F.col(query), F.transform("__rows", lambda r: r[text])))
    each = packed.select(*groups, "__scores", F.posexplode("__rows").alias("__i", "__row")).select(*groups, "__row.*", F.col("__scores").isNull().alias("__failed"), F.coalesce(F.get("__scores", F.col("__i")), F.lit(1.0)).alias("relevance"))
    best = top_k(each, groups, [F.desc("relevance"), F.col("original_index")], k, "__rank")
    return best.where(F.col("__failed") | (F.col("relevance") >= threshold)).select(*df.columns, "original_index", "relevance")


def fuse_two(left: DataFrame, right: DataFrame, keys: list[str], k: int = 60, missing: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists with a penalty rank for what a list lacks (RT-10): keys, ranks, rrf, found_by."""
    l, r = left.select(*keys, F.col("rank").alias("rank_l")), right.select(*keys, F.col("rank").alias("rank_r"))
    term = lambda c: F.lit(1.0) / (F.lit(k) + F.coalesce(F.col(c), F.lit(missing)))
    source = F.when(F.col("rank_l").isNull(), "right_only").when(F.col("rank_r").isNull(), "left_only").otherwise("both")
    return l.join(r, keys, "full").withColumns({"rrf": term("rank_l") + term("rank_r"), "found_by": source})


def fuse_many(ranked: DataFrame, keys: list[str], query: str, k: int = 60) -> DataFrame:
    """Fusion over any number of queries without penalty (RT-24): keys, rrf, n_queries, best_rank."""
    return ranked.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"), F.count(query).alias("n_queries"), F.min("rank").alias("best_rank"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = 2048, query_block: int = 256) -> DataFrame:
    """The k rows of greatest cosine for every query, the query's own row left out (RT-15, RT-32): query_id, key, score, rank.

    Both sides are packed into blocks that are numbered, each pair of blocks is one matrix product, and only k candidates per
    query and block leave it. The work is (queries × rows), as an exact search needs; neither side is broadcast or
    collected. Null, empty and zero vectors match nothing. Ties go to the lower key.
    """

    def pack(df: DataFrame, size: int, name: str) -> DataFrame:
        # Blocks by hash: as many as the table has rows divided by the block size, found without ordering it.
        n = max(1, -(-df.count() // size))
        rows = df.where(F.size(column) > 0).select(F.pmod(F.xxhash64(key), F.lit(n)).alias(name), F.struct(F.col(key).alias("id"), F.col(column).cast("array<float>").alias("v")).alias("x"))
        return rows.groupBy(name).agg(F.collect_list("x").alias(name + "s"))

    q, r = pack(queries, query_block, "qb"), pack(vectors, block, "rb")
    pairs = q.join(r, how="cross")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(items: list) -> tuple[np.ndarray, np.ndarray]:
            m = np.array([x["v"] for x in items], dtype=np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.array([x["id"] for x in items]), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        for b in batches:
            for qs, rs in zip(b["qbs"], b["rbs"]):
                (qi, qm), (ri, rm) = unit(qs), unit(rs)
                s = np.round(qm @ rm.T, 6) + 0.0  # no negative zero
                s[(qi[:, None] == ri[None, :]) | ~qm.any(axis=1)[:, None] | ~rm.any(axis=1)[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ri, s.shape), -s), axis=1)[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(qi, order.shape[1]), key: ri[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                yield out[out["score"] > -np.inf]

    hits = in_workers(pairs.select("qbs", "rbs")).mapInPandas(best, f"query_id bigint, {key} bigint, score double")
    return top_k(hits, ["query_id"], [F.desc("score"), F.col(key)], k)


def nearest_centroid(vectors: DataFrame, centroids: list[tuple[int, list[float]]], column: str = "embedding") -> DataFrame:
    """Each vector's nearest of a few given centroids by squared distance, ties to the lower id (CH-22): adds cluster, distance."""
    dist = lambda c: F.aggregate(F.zip_with(F.col(column), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    options = F.array(*[F.struct(F.round(dist(c), 6).alias("distance"), F.lit(i).alias("cluster")) for i, c in centroids])
    return vectors.withColumn("__near", F.array_min(options)).withColumns({"cluster": F.col("__near.cluster"), "distance": F.col("__near.distance")}).drop("__near")


def nearest_mean(vectors: DataFrame, means: DataFrame, label: str, mean: str, column: str = "embedding", block: int = 256) -> DataFrame:
    """Each vector's nearest of any number of means by squared distance, ties to the lower label (CH-22): adds cluster, distance.

    means: label, mean (an array). They are packed into blocks, and every row meets every block in a join; nothing is
    collected. Rows are told apart by a number of their own, so repeated ones all stay.
    """
    n = max(1, -(-means.count() // block))
    packed = means.groupBy(F.pmod(F.xxhash64(label), F.lit(n)).alias("__block")).agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(mean).alias("m"))).alias("__means")).drop("__block")
    dist = lambda m: F.aggregate(F.zip_with(F.col(column), m, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    near = F.array_min(F.transform("__means", lambda c: F.struct(F.round(dist(c["m"]), 6).alias("distance"), c["label"].alias("cluster"))))
    pairs = vectors.withColumn("__row", F.monotonically_increasing_id()).join(packed, how="cross").withColumn("__near", near)
    best = pairs.groupBy("__row").agg(F.min("__near").alias("__near"), F.first(F.struct(*vectors.columns)).alias("__v"))
    return best.select("__v.*", F.col("__near.cluster").alias("cluster"), F.col("__near.distance").alias("distance"))


def pack_within(df: DataFrame, groups: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The leading rows of each group whose sizes sum to at most `budget` (RT-43, RT-45)."""
    running = F.sum(size).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("running", running).where(F.col("running") <= budget)


def neighbours(df: DataFrame, groups: list[str], position: str, wanted: Column, before: int, after: int) -> DataFrame:
    """Rows within `before`/`after` places of a wanted one in their group (RT-33, SEG-23), by one range window."""
    w = Window.partitionBy(*groups).orderBy(position).rangeBetween(-after, before)
    return df.withColumn("__near", F.max(wanted.cast("int")).over(w)).where("__near = 1").drop("__near")


def islands(df: DataFrame, groups: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions per group: groups, first, last, n (gaps and islands)."""
    run = F.col(position) - F.row_number().over(Window.partitionBy(*groups).orderBy(position))
    return df.withColumn("__run", run).groupBy(*groups, "__run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("__run")


def regex_hits(df: DataFrame, pattern: str, text: str = "content", shown: int = 5) -> DataFrame:
    """Rows with matches of a pattern, how many and the first ones (RT-31)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return df.withColumn("hits", found).where(F.size("hits") > 0).withColumns({"n_hits": F.size("hits"), "shown": F.slice("hits", 1, shown)}).drop("hits")


def structure(df: DataFrame, groups: list[str], position: str) -> DataFrame:
    """Per section: how many chunks and which positions (RT-34)."""
    return df.groupBy(*groups).agg(F.count("*").alias("n_chunks"), F.min(position).alias("first"), F.max(position).alias("last"))


def query_score(text: Column, query: str) -> Column:
    """Terms of a query that a text holds: 5 each if it holds the whole phrase, else 1 (RT-25)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    weight = F.when(F.contains(low, F.lit(query.lower())), 5).otherwise(1)
    return sum((F.when(F.contains(low, F.lit(t)), weight).otherwise(0) for t in dict.fromkeys(query.lower().split())), F.lit(0))


def unique_queries(*lists: list[str]) -> list[str]:
    """Queries of several lists in order, without repeats whatever their case (RT-19)."""
    seen: dict[str, str] = {}
    for q in (q for qs in lists for q in qs):
        seen.setdefault(q.strip().lower(), q)
    return list(seen.values())


def diverse_top(df: DataFrame, groups: list[str], source: str, order: list[Column], k: int, per_source: int = 1) -> DataFrame:
    """The best k per group, those within `per_source` of their source before all others (RT-48): adds rank."""
    w = Window.partitionBy(*groups)
    within = F.row_number().over(Window.partitionBy(*groups, source).orderBy(*order))
    df = df.withColumn("__extra", (within > per_source).cast("int"))
    return df.withColumn("rank", F.row_number().over(w.orderBy("__extra", *order))).where(F.col("rank") <= k).drop("__extra")


def retrieval_verdict(df: DataFrame, groups: list[str], relevant: Column) -> DataFrame:
    """Per group the ratio of relevant hits and what it says (RT-35): correct from one half, ambiguous above none, else incorrect."""
    ratio = F.count_if(relevant) / F.count("*")
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.round(ratio, 6).alias("ratio")).withColumn("verdict", F.when(F.col("ratio") >= 0.5, "correct").when(F.col("ratio") > 0, "ambiguous").otherwise("incorrect"))
