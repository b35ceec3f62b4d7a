"""Reconciling candidates of several methods, ordered rules with an audit log, and logs folded into states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalise import comparable, glob, values_match
from ledgerloom.functions.once import computed_once
from ledgerloom.functions.text import stated


def to_fields(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns as rows (field_path, value), nulls kept (EN-13, XT-54)."""
    cells = F.array(*[F.struct(F.lit(c).alias("field_path"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.field_path", "c.value")


def to_record(df: DataFrame, keys: list[str], paths: list[str]) -> DataFrame:
    """Rows (field_path, value) as columns, in one aggregation (XT-17..23)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("field_path") == p, F.col("value"))).alias(p) for p in paths])


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two methods' values side by side (EN-01, EN-07): keys, left_value, right_value; what one lacks is null."""
    return left.select(*keys, F.col("value").alias("left_value")).join(right.select(*keys, F.col("value").alias("right_value")), keys, "full")


def decide(aligned: DataFrame) -> DataFrame:
    """Adds reason, final_value and escalated (EN-02): agree, both_null, only one, or disagree; a disagreement keeps the left value and is escalated."""
    aligned = computed_once(aligned, {"__l": stated(F.col("left_value").cast("string")), "__r": stated(F.col("right_value").cast("string")), "__a": comparable(F.col("left_value").cast("string")), "__b": comparable(F.col("right_value").cast("string"))})
    l, r = F.col("__l"), F.col("__r")
    reason = F.when(l.isNull() & r.isNull(), "both_null").when(r.isNull(), "left_only").when(l.isNull(), "right_only").when(values_match(l, r, 0.001, (F.col("__a"), F.col("__b"))), "agree").otherwise("disagree")
    return aligned.withColumns({"reason": reason, "final_value": F.coalesce(l, r), "escalated": reason == "disagree"}).drop("__l", "__r", "__a", "__b")


def route_by_confidence(gap: Column, low: Column, high: Column, margin: float = 0.25, floor: float = 0.3, sure: float = 0.7) -> Column:
    """Where two confidences send a disagreement (EN-03): the clear winner, a second look if both are low or both sure, else the higher."""
    return F.when(gap >= margin, "winner").when(high < floor, "escalate_low").when(low >= sure, "escalate_conflict").otherwise("higher")


def gate(values: DataFrame, keys: list[str], parents: dict[str, str]) -> DataFrame:
    """Null the values of fields whose parent flag is false (EN-01): a window over the record, no self-join. Adds gated."""
    w = Window.partitionBy(*keys)
    parent = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])[F.col("field_path")]
    off = F.collect_set(F.when(F.col("field_path").isin(*set(parents.values())) & (F.lower("value") == "false"), F.col("field_path"))).over(w)
    gated = F.coalesce(F.array_contains(off, parent), F.lit(False)) & F.col("value").isNotNull()
    return values.withColumn("gated", gated).withColumn("value", F.when(~F.col("gated"), F.col("value")))


def fill_nulls(rows: DataFrame, specific: DataFrame, general: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Null values from a source per part, else from one per key (EN-12, XB-22)."""
    s = specific.select(*keys, part, F.col("value").alias("__s"))
    g = general.select(*keys, F.col("value").alias("__g"))
    return rows.join(s, [*keys, part], "left").join(g, keys, "left").withColumn("value", F.coalesce("value", "__s", "__g")).drop("__s", "__g")


@dataclass(frozen=True)
class Rule:
    """If `when` holds, `column` becomes `then`; a null condition does not hold."""

    name: str
    column: str
    when: Column
    then: Column


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules in order, each on what the ones before left (RU-01). Adds corrections: array of (rule, column, old, new).

    Each rule is a projection over the row, so any number of them is one stage. Only a change is logged.
    """
    df = df.withColumn("corrections", F.array().cast("array<struct<rule:string,column:string,old:string,new:string>>"))
    for r in rules:
        kind = df.schema[r.column].dataType
        hit = F.coalesce(r.when, F.lit(False)) & ~F.col(r.column).eqNullSafe(r.then.cast(kind))
        entry = F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(r.column).cast("string").alias("old"), r.then.cast("string").alias("new"))
        df = df.withColumns({"corrections": F.when(hit, F.concat("corrections", F.array(entry))).otherwise(F.col("corrections")), r.column: F.when(hit, r.then.cast(kind)).otherwise(F.col(r.column))})
    return df


def audit_log(corrected: DataFrame, keys: list[str]) -> DataFrame:
    """The corrections as rows with their order (RU-14)."""
    return corrected.select(*keys, F.posexplode("corrections").alias("seq", "c")).select(*keys, "seq", "c.rule", "c.column", "c.old", "c.new")


def fold_log(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The state a log ends in: last non-null value, last entry, how many (EN-36), with partial maxima before the shuffle."""
    at = F.when(F.col(value).isNotNull(), F.struct(seq, value))
    return log.groupBy(*keys).agg(F.max(at).getField(value).alias("final_value"), F.max(seq).alias("last_seq"), F.count("*").alias("n_entries"))


def carried(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """Each entry with the last non-null value before it (XT-42)."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("previous", F.last(value, ignorenulls=True).over(w))


# Confidences from the surest down.
CONFIDENCES = ("explicit", "inferred", "not_found")


def confidence_rank(c: Column) -> Column:
    """0 for the surest; null and unknown words come last (EN-19: by rank, not by letters)."""
    return F.coalesce(F.create_map(*[F.lit(x) for i, w in enumerate(CONFIDENCES) for x in (w, i)])[F.lower(F.trim(c))], F.lit(len(CONFIDENCES)))


def merge_confident(rows: DataFrame, keys: list[str], attributes: list[str], confidence: str, order: str) -> DataFrame:
    """One record per key: of each attribute the first stated value by confidence, then order (EN-19, EN-20, EN-35). One aggregation."""
    rank = F.struct(confidence_rank(F.col(confidence)), F.col(order))
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(a), F.when(F.col(a).isNotNull(), rank)).alias(a) for a in attributes])


def overlay(base: DataFrame, new: DataFrame, keys: list[str], replace: list[str], fill: list[str]) -> DataFrame:
    """`base` with a second result laid over it (EN-23..33): `replace` where the new one states something, `fill` where the old one doesn't."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in (*replace, *fill)])
    out = base.join(n, keys, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in replace} | {c: F.coalesce(c, f"__{c}") for c in fill}).drop(*[f"__{c}" for c in (*replace, *fill)])


def first_of_tiers(tiers: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """The value of the first tier that states one (EN-21): keys, value, tier. One aggregation over the union, not a chain of anti-joins."""
    rows = None
    for i, (name, df) in enumerate(tiers):
        x = df.select(*keys, "value", F.lit(i).alias("__i"), F.lit(name).alias("tier"))
        rows = x if rows is None else rows.unionByName(x)
    best = rows.where(stated(F.col("value")).isNotNull()).groupBy(*keys).agg(F.min(F.struct("__i", "value", "tier")).alias("b"))
    return best.select(*keys, "b.value", "b.tier")


def log_summary(log: DataFrame, layer: str, decision: str) -> DataFrame:
    """Entries by layer and decision with totals of each and of all (EN-14, EN-37), in one pass."""
    return log.cube(layer, decision).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grouping_level"))


def count_confidence(fields: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    """How many fields are explicit, inferred and not found (SC-19), whatever the case; a confidence that states nothing counts as not found."""
    said = F.lower(F.trim(F.coalesce(stated(F.col(confidence)), F.lit("not_found"))))
    return fields.groupBy(*by).agg(*[F.count_if(said == c).alias(f"n_{c}") for c in ("explicit", "inferred", "not_found")])


# Fields for which the first of two methods is preferred, and the second.
FIRST_PREFERRED = (
    "incentive_fee.has_incentive_fee", "incentive_fee.high_water_mark", "incentive_fee.has_catch_up", "expense_cap.has_expense_cap", "leverage_limits.uses_leverage",
    "share_classes.distribution_fee_pct", "distribution_terms.distribution_frequency", "repurchase_terms.lock_up_period_years", "incentive_fee.underlying_fund_incentive_range",
)
FIRST_IF_CONTAINED = "distribution_fee_pct"
SECOND_PREFERRED = ("incentive_fee.hurdle_rate_as_stated", "incentive_fee.hurdle_rate_frequency", "leverage_limits.leverage_basis", "leverage_limits.max_leverage_pct", "repurchase_terms.repurchase_basis")
# Patterns of fields that each method reads better, tried in this order.
ROUTES = {"t3_k10": ("has_*", "*_policy", "*_basis", "fund_type", "default_*"), "reranker": ("share_classes.*minimum*", "*expense_cap_pct", "distribution_frequency", "leverage_basis")}


def preferred_side(field: Column) -> Column:
    """Which of two methods a field prefers (EN-05, EN-06): `left`, `right` or null."""
    return F.when(field.isin(*FIRST_PREFERRED) | F.contains(field, F.lit(FIRST_IF_CONTAINED)), "left").when(field.isin(*SECOND_PREFERRED), "right")


def route_by_field(aligned: DataFrame, escalate: bool = True) -> DataFrame:
    """Settles disagreements by the method that the field prefers (EN-04): adds routed_value, route, escalated.

    The preferred method's value, else the other's; if both are null it is escalated. A field without preference is escalated, or takes the
    left value, else the right, if `escalate` is off.
    """
    l, r, side = stated(F.col("left_value")), stated(F.col("right_value")), preferred_side(F.col("field_path"))
    by_side = F.when(side == "left", F.coalesce(l, r)).when(side == "right", F.coalesce(r, l))
    open_ = F.lit(None).cast("string") if escalate else F.coalesce(l, r)
    value = F.when(side.isNotNull(), by_side).otherwise(open_)
    taken = lambda a, b, name: F.when(a.isNotNull(), f"{name}_preferred").when(b.isNotNull(), f"{name}_fallback").otherwise("both_null")
    route = F.when(side == "left", taken(l, r, "left")).when(side == "right", taken(r, l, "right")).otherwise("disagreement" if escalate else F.when(l.isNotNull(), "left").when(r.isNotNull(), "right").otherwise("none"))
    return aligned.withColumns({"routed_value": value, "route": route, "escalated": route.isin("both_null", "disagreement")})


def method_for(field: Column, default: str = "t3_k10", routes: dict[str, tuple[str, ...]] = ROUTES) -> Column:
    """The method that reads a field best by its name (EN-17, EN-18): the first with a matching pattern, else the default."""
    return F.coalesce(*[F.when(F.greatest(*[glob(field, p) for p in patterns], F.lit(False)), method) for method, patterns in routes.items()], F.lit(default))


def validated_classes(extracted: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Extracted share classes beside those discovered (EN-11): adds is_validated (one name contains the other, whatever the case).

    extracted: key, class_name and whatever else; discovered: key, class_name. Unnamed classes are contained in every discovered name. A record's
    discovered names are one small array, so each extracted row meets one row.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    names = discovered.where("class_name is not null").groupBy(key).agg(F.collect_set(low(F.col("class_name"))).alias("__names"))
    own = low(F.col("class_name"))
    return extracted.join(names, key, "left").withColumn("is_validated", F.coalesce(F.exists("__names", lambda n: F.contains(n, own) | F.contains(own, n)), F.lit(False))).drop("__names")


# What an agent can do, in the order in which a misspelt action is matched.
ACTIONS = ("search_keywords", "search_regex", "search_semantic", "get_context", "get_structure", "evaluate_retrieval", "extract", "validate", "stop_success", "stop_not_found")


def agent_steps(responses: DataFrame, response: str = "response") -> DataFrame:
    """An agent's answers as steps (LL-24): adds action, action_input (JSON), thought. An answer that is no object, or has no action, has none.

    An action is trimmed and lowered; one that is not known becomes the first known one that contains it or that it contains, else there is none.
    """
    part = lambda name: F.get_json_object(response, f"$.{name}")
    said = F.lower(F.trim(part("action")))
    near = F.coalesce(*[F.when(F.contains(said, F.lit(a)) | F.contains(F.lit(a), said), a) for a in ACTIONS])
    action = F.when(said.isin(*ACTIONS), said).otherwise(near)
    known = action.isNotNull()
    return responses.withColumns({"action": action, "action_input": F.when(known, F.coalesce(part("action_input"), F.lit("{}"))), "thought": F.when(known, F.coalesce(part("thought"), F.lit("No reasoning provided")))})
