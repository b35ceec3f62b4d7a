"""Relational operators of the holdings star schema: semi-join cascades, latest rows, upserts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_keys(df: DataFrame, keys: DataFrame, column: str, normalise=lambda c: c) -> DataFrame:
    """Rows of `df` whose normalised `column` is among the normalised keys (REL-01..05). Nulls match nothing.

    A table without that column passes whole, as a source may have none. Spark broadcasts the keys if they are few.
    """
    if column not in df.columns:
        return df
    wanted = keys.select(normalise(F.col(keys.columns[0])).alias("__key")).where("__key is not null").distinct()
    return df.join(wanted, normalise(F.col(column)) == F.col("__key"), "left_semi")


def without_leading_zeros(c: Column) -> Column:
    """A key as text without leading zeros, so that `0000123` and `123` meet."""
    return F.ltrim(F.trim(c.cast("string")), F.lit("0"))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], normalise=lambda c: c) -> dict[str, DataFrame]:
    """Reduce tables along links (child, parent, column) in order: each child keeps rows whose parent row was kept."""
    out = dict(tables)
    for child, parent, column in links:
        out[child] = only_keys(out[child], out[parent].select(column), column, normalise)
    return out


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a stated order (REL-21, REL-22); null keys form a group of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, key: str, replace: list[str], keep_if_null: list[str], order: list[Column]) -> DataFrame:
    """`old` with the rows of `new` merged in by key (SNK-18).

    The last row of `new` per key in `order` decides. Columns in `replace` take its value even if null, those in
    `keep_if_null` only if it has one. Keys only in one side stay as they are.
    """
    latest = first_by(new.where(F.col(key).isNotNull()), [key], order).select(key, *replace, *keep_if_null)
    o, n = old.alias("o"), latest.withColumn("__new", F.lit(True)).alias("n")
    pick = [F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replace]
    keep = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep_if_null]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *pick, *keep)


def newer_rows(current: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """Incremental merge (REL-23): each incoming row as `new`, `updated` or `skipped` (the current one is as new)."""
    have = current.groupBy(key).agg(F.max(at).alias("__have"))
    status = F.when(F.col("__have").isNull(), "new").when(F.col(at) > F.col("__have"), "updated").otherwise("skipped")
    return incoming.join(have, key, "left").withColumn("status", status).drop("__have")


def net_flows(periods: DataFrame) -> DataFrame:
    """Gross sales, gross redemptions and net flows of three months; a missing month counts as zero (REL-09)."""
    total = lambda p: sum((F.coalesce(F.col(f"{p}_flow_mon{i}"), F.lit(0).cast("decimal(18,2)")) for i in (1, 2, 3)), F.lit(0).cast("decimal(18,2)")).cast("decimal(24,2)")
    out = periods.withColumns({"gross_sales": total("sales"), "gross_redemptions": total("redemption")})
    return out.withColumn("net_flows", (F.col("gross_sales") - F.col("gross_redemptions")).cast("decimal(24,2)"))


def rename_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename and project the columns of `names` that exist (REL-10), so a source may lack some."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def coerced(df: DataFrame, columns: list[str], to: str = "double") -> DataFrame:
    """Texts as numbers, bad ones as null (REL-11). A cast alone would read Java's suffixes, `90d` as 90."""
    number = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    text = lambda c: F.trim(F.col(c).cast("string"))
    return df.withColumns({c: F.when(text(c).rlike(number), text(c)).try_cast(to) for c in columns if c in df.columns})


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Groups of non-null values by count, then value; the largest `top` of them (REL-06)."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def quarter_summary(entities: DataFrame, periods: DataFrame, items: DataFrame, on: tuple[str, str, str, str], keys: list[str], item_key: str, level: str, levels: list[str], amount: str) -> DataFrame:
    """One row per entity and period with totals of its items (REL-14).

    on: (entity key, period's entity key, period key, item's period key). Items are aggregated by period before the join,
    so the wide side meets one row per period. Counts distinct `item_key`, sums `amount` for each of `levels`, else 0.
    """
    ek, pe, pk, ip = on
    sums = [F.sum(F.when(F.col(level) == v, F.col(amount)).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)").alias(f"total_{v.lower()}") for v in levels]
    per = items.groupBy(ip).agg(F.countDistinct(item_key).alias("n_items"), *sums)
    joined = entities.join(periods, F.col(ek) == F.col(pe)).join(per, F.col(pk) == F.col(ip), "left")
    zero = [F.coalesce(f"total_{v.lower()}", F.lit(0).cast("decimal(28,2)")).alias(f"total_{v.lower()}") for v in levels]
    return joined.select(*keys, F.coalesce("n_items", F.lit(0)).alias("n_items"), *zero)
