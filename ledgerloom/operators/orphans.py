"""References to records that do not exist (yet, or any more), by a linear merge of both sides in time.

References and parent rows are put on one time line per key, co-partitioned and sorted; a running sum over it counts
the parent rows available at each reference. Parents are pre-aggregated per key and time. A key with more references than one task
should merge is split over several time lines, to each of which its parent events are copied.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import accession_key, cik_key, quarter_label

#: References from which on a key is split over time lines of so many each; the most keys that are split, and the most lines of one.
LINE_ROWS, MOST_SPLIT = 250_000, 4096


@dataclass(frozen=True)
class Reference:
    """`table.column` refers to `parent`; `key` normalises both sides."""

    table: str
    rows: DataFrame
    key: Column
    at: Column


@dataclass(frozen=True)
class Parent:
    """Parent rows are available from `start` (null: always) until before `end` (null: for ever)."""

    rows: DataFrame
    key: Column
    start: Column
    end: Column


def find_orphans(groups: list[tuple[str, Parent, list[Reference]]], line_rows: int = LINE_ROWS) -> DataFrame:
    """Every reference without a parent row available at its time: table_name, row_id, period, orphan_kind.

    groups: (name of the key space, parent, references). `missing`: no parent row at all; `late`: some parent row
    came in after the reference; else `deleted`. Null keys and null spellings are no references. A reference without
    a time is held against the parent rows that are never taken out. Repeated rows give a row each; a parent row
    whose end is not after its start was never available.
    """
    end_of_time = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    refs, parents = None, None
    for space, parent, references in groups:
        p = parent.rows.select(F.lit(space).alias("space"), parent.key.alias("key"), parent.start.cast("timestamp_ntz").alias("start"), parent.end.cast("timestamp_ntz").alias("end"))
        parents = p if parents is None else parents.unionByName(p)
        for r in references:
            x = r.rows.select(F.lit(space).alias("space"), r.key.alias("key"), F.coalesce(r.at.cast("timestamp_ntz"), end_of_time).alias("t"), F.lit(r.table).alias("table_name"), "row_id", F.coalesce(quarter_label(F.col("quarter")), F.lit("unknown")).alias("period"))
            refs = x if refs is None else refs.unionByName(x)
    refs, parents = refs.where("key is not null"), parents.where("key is not null")

    # Keys too hot for one time line: the MOST_SPLIT largest at most, so any other has under total / MOST_SPLIT references. Counted once.
    counts = refs.groupBy("space", "key").agg(F.count("*").alias("n")).where(F.col("n") > line_rows)
    largest = counts.orderBy(F.desc("n"), "space", "key").limit(MOST_SPLIT).collect()
    hot = refs.sparkSession.createDataFrame([(r["space"], r["key"], min(-(-r["n"] // line_rows), MOST_SPLIT)) for r in largest], "space string, key string, lines int")
    line = F.coalesce(F.pmod(F.xxhash64("table_name", "row_id"), "lines"), F.lit(0)).cast("int")
    refs = refs.join(F.broadcast(hot), ["space", "key"], "left").withColumn("line", line) if largest else refs.withColumn("line", F.lit(0))

    # Parents once per key and time: what starts, what ends; and once per key: that there are some, and when the last came in.
    lived = F.col("end").isNull() | F.col("start").isNull() | (F.col("start") < F.col("end"))
    ends = F.when(F.col("end").isNotNull(), F.struct(F.col("end").alias("t"), F.lit(-1).alias("delta")))
    starts = F.struct(F.col("start").alias("t"), F.lit(1).alias("delta"))
    steps = parents.select("space", "key", F.explode(F.when(lived, F.array(starts, ends)).otherwise(F.array(starts.withField("delta", F.lit(0))))).alias("e")).where("e is not null")
    steps = steps.groupBy("space", "key", F.col("e.t").alias("t")).agg(F.sum("e.delta").alias("delta"))
    last = parents.groupBy("space", "key").agg(F.max("start").alias("last_start"), F.lit(True).alias("known"))
    lines = F.sequence(F.lit(0), F.coalesce(F.col("lines"), F.lit(1)) - 1)

    def copied(df: DataFrame) -> DataFrame:
        """Parent rows for every time line of their key."""
        return df.join(F.broadcast(hot), ["space", "key"], "left").withColumn("line", F.explode(lines)).drop("lines") if largest else df.withColumn("line", F.lit(0))

    # At one moment: the header, what starts and ends, then the references.
    head = copied(last).select("space", "key", "line", F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("delta"), "known", "last_start")
    step = copied(steps).select("space", "key", "line", "t", F.lit(1).alias("kind"), "delta")
    ref = refs.select("space", "key", "line", "t", F.lit(2).alias("kind"), "table_name", "row_id", "period")
    time_line = head.unionByName(step, allowMissingColumns=True).unionByName(ref, allowMissingColumns=True)
    merge = Window.partitionBy("space", "key", "line").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = time_line.withColumns({"alive": F.coalesce(F.sum("delta").over(merge), F.lit(0)), "known": F.last("known", True).over(merge), "last_start": F.last("last_start", True).over(merge)})
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("last_start") > F.col("t"), "late").otherwise("deleted")
    return merged.where("kind = 2 and alive <= 0").select("table_name", "row_id", "period", kind.alias("orphan_kind"))


def filing_orphans(funds: DataFrame, submissions: DataFrame, fund_periods: DataFrame, monthly_returns: DataFrame, line_rows: int = LINE_ROWS) -> DataFrame:
    """Orphans of the holdings tables: submissions → funds by CIK, periods and returns → submissions by accession number."""
    at = F.col("loaded_at")
    fund = Parent(funds, cik_key(F.col("cik")), F.col("created_at"), F.col("deleted_at"))
    filing = Parent(submissions, accession_key(F.col("accession_number")), at, F.col("deleted_at"))
    by_filing = [Reference(n, df, accession_key(F.col("accession_number")), at) for n, df in (("fund_periods", fund_periods), ("monthly_returns", monthly_returns))]
    return find_orphans([("cik", fund, [Reference("submissions", submissions, cik_key(F.col("cik")), at)]), ("accession", filing, by_filing)], line_rows)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table and period: table_name, period, orphan_kind, n."""
    return orphans.groupBy("table_name", "period", "orphan_kind").agg(F.count("*").alias("n"))
