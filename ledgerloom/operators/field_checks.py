"""Which checks ground which field: numbers, names and telling words of extracted records against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.once import computed_once
from ledgerloom.operators.grounding import number_in_text

# Group of fields → fields whose value has to stand in the source as a number.
NUMBERS = {
    "repurchase_terms": ("repurchase_percentage_min", "repurchase_percentage_max", "repurchase_percentage_typical", "early_repurchase_fee", "notice_period_days"),
    "share_classes": ("sales_load_pct", "distribution_servicing_fee_pct", "minimum_initial_investment"),
    "allocation_targets": ("target_percentage", "range_min", "range_max"),
    "concentration_limits": ("limit_percentage",),
    "incentive_fee": ("incentive_fee_rate", "hurdle_rate"),
    "expense_cap": ("cap_rate",),
}
#: Numbers that are not checked if they are zero.
NOT_IF_ZERO = ("sales_load_pct", "distribution_servicing_fee_pct")
#: Fields whose value has to stand in the source as a name; of the second, half of its longer words will do.
NAMES = {"share_classes": "class_name", "allocation_targets": "asset_class"}
#: (group, field, value) → phrases of which the source has to hold one, and what it means if it holds none.
PHRASES = {
    ("repurchase_terms", "fund_structure", "interval_fund"): (("interval",), "unverified"),
    ("repurchase_terms", "fund_structure", "tender_offer_fund"): (("tender",), "unverified"),
    ("concentration_limits", "has_concentration_limits", "false"): (("no limit", "no restriction", "without limit", "unlimited"), "issue"),
    ("incentive_fee", "has_incentive_fee", "false"): (("no performance", "no incentive"), None),
    ("expense_cap", "has_fee_waiver", "true"): (("waive",), "unverified"),
}


def check_fields(values: DataFrame, source: str = "source") -> DataFrame:
    """Adds `status` to extracted values (GR-07..12): verified, unverified, issue, or null where nothing is to be checked.

    values: field_group, field, value (text) and the source text. Names count whatever their case; an asset class counts if half of
    its words of over three letters stand in the source; that a fund has no incentive fee is verified by `does not` beside `incentive`, too.
    """
    df = computed_once(values, {"__s": F.lower(F.coalesce(F.col(source), F.lit(""))), "__v": F.lower(F.trim("value")), "__n": F.col("value").try_cast("double")})
    at = lambda group, fields: (F.col("field_group") == group) & F.col("field").isin(*fields)
    numeric = F.greatest(*[F.coalesce(at(g, fields), F.lit(False)) for g, fields in NUMBERS.items()]) & F.col("__n").isNotNull() & ~(F.col("field").isin(*NOT_IF_ZERO) & (F.col("__n") == 0))
    held = lambda c: F.contains("__s", c)
    words = F.filter(F.split("__v", r"\s+"), lambda w: F.char_length(w) > 3)
    fuzzy = (F.size(words) >= 2) & (F.size(F.filter(words, held)) * 2 >= F.size(words))
    named = F.when(at("share_classes", ("class_name",)), held(F.col("__v"))).when(at("allocation_targets", ("asset_class",)), held(F.col("__v")) | fuzzy)
    status = F.when(numeric, F.when(number_in_text(F.col("__n"), F.col("__s")), "verified").otherwise("unverified")).when((F.col("__v") != "") & named.isNotNull(), F.when(named, "verified").otherwise("unverified"))
    for (group, field, value), (phrases, otherwise) in PHRASES.items():
        said: Column = F.greatest(*[held(F.lit(p)) for p in phrases], F.lit(False))
        if field == "has_incentive_fee":
            said = said | held(F.lit("does not")) & held(F.lit("incentive"))
        status = F.when(at(group, (field,)) & (F.col("__v") == value), F.when(said, "verified").otherwise(F.lit(otherwise))).otherwise(status)
    return df.withColumn("status", status).drop("__s", "__v", "__n")


def grounding_status(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Per record and group of fields (GR-01, GR-30): n_verified, n_unverified, n_issues, score (verified of both, one half if neither) and is_grounded (from one half on)."""
    counts = checked.groupBy(*keys, "field_group").agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in (("n_verified", "verified"), ("n_unverified", "unverified"), ("n_issues", "issue"))])
    both = F.col("n_verified") + F.col("n_unverified")
    score = F.when(both > 0, F.col("n_verified") / F.nullif(both, F.lit(0))).otherwise(0.5)
    return counts.withColumn("score", score).withColumn("is_grounded", F.col("score") >= 0.5)


def correct_minimums(classes: DataFrame, source: str = "source", fields: tuple[str, ...] = ("minimum_initial_investment", "minimum_additional_investment")) -> DataFrame:
    """Minimum investments that do not stand in the source are nulled (GR-13): adds `corrections`, the names of the fields that were."""
    bad = {f: F.col(f).isNotNull() & ~number_in_text(F.col(f), F.col(source)) for f in fields}
    df = computed_once(classes, {f"__{f}": b for f, b in bad.items()})
    out = df.withColumn("corrections", F.array_compact(F.array(*[F.when(F.col(f"__{f}"), f) for f in fields])))
    return out.withColumns({f: F.when(~F.col(f"__{f}"), F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])
