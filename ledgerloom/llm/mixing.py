"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A mixture's size is a number of blocks of equal tokens. The blocks go to sources one by one to the highest quotient
weight / (2·seats + 1), each source at most as many as its repeats allow; the same rule then splits a source's blocks over
its shards by their tokens. A shard's quota is whole passes over its documents and, for the rest, the first blocks
of a seeded order. The division is found by its price (seats = weight / price, rounded), not by handing out
seats one at a time, so it costs the same for any size. Documents stay whole, so the last block of a shard is met by the document that
fits it best.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import states_nothing, trimmed
from ledgerloom.llm.tokenise import token_counts
from ledgerloom.workspace import materialise

#: Tokens of a block, the most shards that a source is cut into, and the tokens for which it gets another one.
BLOCK_TOKENS, SHARDS, SHARD_TOKENS = 512, 1024, 1 << 20


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients weight/(2k+1), at most `caps` each. Ties go to the earlier. Seats beyond all caps stay free.

    A party takes its k-th seat (k from 0) at quotients w/(2k+1) and above. For a price p it has all seats whose
    quotient exceeds p, floor((w/p + 1)/2) of them up to rounding; p is found by bisection, the last seats one by one.
    """
    caps = [seats if c is None else min(int(c), seats) for c in (caps or [None] * len(weights))]
    caps = [c if w > 0 else 0 for w, c in zip(weights, caps)]
    seats = min(seats, sum(caps))
    if seats <= 0:
        return [0] * len(weights)

    def at(p: float) -> list[int]:
        return [min(c, max(0, math.floor((w / p + 1) / 2))) for w, c in zip(weights, caps)]

    low, high = 0.0, max(weights) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    held = at(high * (1 + 1e-9))  # seats that tie at the price are left to the comparison of quotients
    while sum(held) < seats:
        best = max((i for i in range(len(weights)) if held[i] < caps[i]), key=lambda i: (weights[i] / (2 * held[i] + 1), -i))
        held[best] += 1
    return held


def source_key(c: Column) -> Column:
    """A source's name in lower case with blanks and hyphens as underscores; null if it states none."""
    return F.when(~states_nothing(c), F.regexp_replace(F.lower(trimmed(c)), r"[\s-]+", "_"))


def quotas(totals: list[tuple[str, int, int]], plan: list[tuple[str, float, int]], size: int, block: int) -> list[tuple[str, int, int, int]]:
    """A plan's share of each shard: (source, shard, whole passes, tokens of the partial pass).

    totals: (source, shard, tokens); plan: (source, target share, most repeats); size: tokens of the mixture.
    """
    by_source: dict[str, list[tuple[int, int]]] = {}
    for source, shard, tokens in sorted(totals):
        if tokens > 0:
            by_source.setdefault(source, []).append((shard, tokens))
    have = [sum(t for _, t in by_source.get(s, [])) for s, _, _ in plan]
    seats = sainte_lague([w for _, w, _ in plan], round(size / block), [-(-h * r // block) for h, (_, _, r) in zip(have, plan)])  # a cap's last block may be a part of one
    out = []
    for (source, _, repeats), n, total in zip(plan, seats, have):
        shards = by_source.get(source, [])
        # Whole passes go to all shards alike; what is left of the blocks is divided by tokens.
        passes = min(repeats, n * block // total) if total else 0
        rest = sainte_lague([t for _, t in shards], n - passes * total // block, [-(-t // block) for _, t in shards]) if shards and passes < repeats else [0] * len(shards)
        out += [(source, shard, passes, k * block) for (shard, _), k in zip(shards, rest) if passes or k]
    return out


def sized_documents(documents: DataFrame, shards: int = SHARDS, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source (normalised, null ones left out), shard, place (seeded order) and n_tokens of every document. Written once."""
    draw = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = documents.select("doc_id", "text", source_key(F.col("source")).alias("source"))
    sized = token_counts(rows, "doc_id", "source", vocabulary=vocabulary)
    return materialise(sized.withColumns({"place": draw, "shard": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(shards)).cast("int")}), "sized")


def apportion(sized: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Each plan's quota of each shard: plan_id, source, shard, n_shards (of the source), shard_tokens, passes, part (tokens beyond whole passes).

    The rows are (plans × sources named × shards), a bound that the parameters set, not the data; so are the totals that reach the driver.
    """
    spark = sized.sparkSession
    named = targets.select(source_key(F.col("source")).alias("source")).distinct()
    fine = [tuple(r) for r in sized.join(F.broadcast(named), "source").groupBy("source", "shard").agg(F.sum("n_tokens")).collect()]
    # Small sources have few shards, so that what a shard may miss its quota by stays small against it.
    shards: dict[str, int] = {}
    for source, _, tokens in fine:
        shards[source] = shards.get(source, 0) + tokens
    shards = {source: max(1, min(SHARDS, tokens // shard_tokens)) for source, tokens in shards.items()}
    merged: dict[tuple[str, int], int] = {}
    for source, shard, tokens in fine:
        merged[source, shard % shards[source]] = merged.get((source, shard % shards[source]), 0) + tokens
    totals = [(*at, tokens) for at, tokens in merged.items()]
    everything = sized.agg(F.sum("n_tokens")).first()[0] or 0
    plans: dict[str, tuple[float, list[tuple[str, float, int]]]] = {}
    for r in targets.select("plan_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_ratio").orderBy("plan_id", "source").collect():
        plans.setdefault(r["plan_id"], (r["budget_ratio"] or 0.0, []))[1].append((r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0))
    rows = [(p, s, k, shards[s], merged[s, k], n, part) for p, (ratio, plan) in plans.items() for s, k, n, part in quotas(totals, plan, round(ratio * everything), block)]
    return spark.createDataFrame(rows, "plan_id string, source string, shard int, n_shards int, shard_tokens bigint, passes int, part bigint")


def mix(sized: DataFrame, quota: DataFrame) -> DataFrame:
    """The documents of every mixture: plan_id, source, doc_id, copies, n_tokens.

    sized: from `sized_documents`; quota: from `apportion`. A plan's size is budget_ratio times the tokens of all documents, of any
    source. A source that cannot fill its share within max_repeats leaves the rest to the others in their proportions, as long as
    they can; a source without documents takes no part. No document occurs more than max_repeats times; a row of `sized` that is
    repeated counts as another document. Documents without tokens come with the whole passes only. A partial pass is the longest
    run of the shard's seeded order that its quota holds, and of the documents after it the one whose size comes nearest to what is left, if
    it comes nearer than none; so the miss is a fraction of a document.
    """
    n_shards = quota.select("source", "n_shards").distinct()
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.join(F.broadcast(n_shards), "source").withColumn("shard", F.pmod("shard", "n_shards")).withColumn("upto", F.sum("n_tokens").over(order))
    at = ["plan_id", "source", "shard"]
    chosen = placed.join(F.broadcast(quota.select(*at, "passes", "part")), ["source", "shard"])
    tokens, within = F.col("n_tokens") > 0, F.col("upto") <= F.col("part")
    # What the run leaves, and the document beyond it that fits that best: one row per quota.
    run = F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0))
    left = chosen.where("part > 0").groupBy(*at).agg((F.first("part") - run).alias("left"))
    beyond = chosen.where(tokens & ~within & (F.col("part") > 0)).join(F.broadcast(left), at)
    miss = F.abs(F.col("n_tokens") - F.col("left"))
    best = beyond.where(miss < F.col("left")).groupBy(*at).agg(F.min(F.struct(miss.alias("miss"), "upto", "doc_id")).alias("best")).select(*at, "best.upto", F.col("best.doc_id").alias("doc_id"), F.lit(True).alias("fits"))
    picked = chosen.join(F.broadcast(best), [*at, "upto", "doc_id"], "left")
    copies = F.col("passes") + F.when(tokens & (within | F.coalesce("fits", F.lit(False))), 1).otherwise(0)
    return picked.select("plan_id", "source", "doc_id", copies.cast("int").alias("copies"), "n_tokens").where("copies > 0")


def reached_shares(mixed: DataFrame, targets: DataFrame, quota: DataFrame) -> DataFrame:
    """What each plan's sources reached: plan_id, source, target_share, actual_share, quota_tokens, tokens, n_documents, most_copies, has_room.

    `quota_tokens` is what the apportionment gave the source; `has_room` that it gave less than the source has within its repeats.
    """
    got = mixed.groupBy("plan_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    given = quota.groupBy("plan_id", "source").agg(F.sum(F.col("passes") * F.col("shard_tokens") + F.col("part")).alias("quota_tokens"), F.sum("shard_tokens").alias("have"))
    want = targets.select("plan_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    both = F.broadcast(want).join(got, ["plan_id", "source"], "left").join(F.broadcast(given), ["plan_id", "source"], "left")
    zero = F.lit(0).cast("bigint")
    tokens, quota_tokens = F.coalesce("tokens", zero), F.coalesce("quota_tokens", zero)
    share = tokens / F.nullif(F.sum(tokens).over(Window.partitionBy("plan_id")), F.lit(0))
    room = F.coalesce(F.col("quota_tokens") < F.col("have") * F.col("max_repeats"), F.lit(False))
    return both.select("plan_id", "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), quota_tokens.alias("quota_tokens"), tokens.alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), room.alias("has_room"))
