"""A library of worked examples as a table, and the examples that suit a document."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.once import computed_once

EXAMPLES = "field_category string, ord int, source_text string, extraction string, difficulty string, fund_name string"
# Field → category of its examples.
CATEGORIES = {
    "incentive_fee": "fees", "expense_cap": "fees", "management_fee": "fees", "repurchase_terms": "repurchase", "allocation_targets": "allocation",
    "concentration_limits": "concentration", "share_classes": "share_classes", "minimum_investment": "share_classes",
}
# Phrases that tell a document's kind, and terms that it can share with an example.
INTERVAL, NO_LIMIT = ("interval fund", "rule 23c-3"), ("no limit", "no restriction", "unlimited", "without limit")
NEGATIVE, FUND_OF_FUNDS = ("does not", "will not", "not subject to", "no sales load"), ("underlying fund", "acquired fund", "affe", "fund-of-funds")
TERMS = (
    "quarterly", "semi-annual", "annual", "monthly", "management fee", "incentive fee", "performance fee", "hurdle rate", "high water mark",
    "class s", "class d", "class i", "minimum investment", "sales load", "25%", "5%", "80%",
)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A library from a JSON or YAML file of categories, each a list of examples (SRC-18): EXAMPLES; a file that is not there gives none."""
    if not Path(path).exists():
        return spark.createDataFrame([], EXAMPLES)
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml  # optional: JSON needs none

        data = yaml.safe_load(text)
    names = ("source_text", "extraction", "difficulty", "fund_name")
    as_text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    rows = [(category, i, *[as_text(e.get(n)) for n in names]) for category, examples in (data or {}).items() for i, e in enumerate(examples)]
    return spark.createDataFrame(rows, EXAMPLES)


def write_examples(examples: DataFrame, path: str) -> None:
    """The library as one JSON file of categories (SNK-08); a library is written by hand, so it is small."""
    out: dict[str, list[dict]] = {}
    for r in examples.orderBy("field_category", "ord").collect():
        out.setdefault(r["field_category"], []).append({k: v for k, v in r.asDict().items() if k not in ("field_category", "ord")})
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=1), encoding="utf-8")


def pick_examples(examples: DataFrame, category: str, most: int = 3, difficulty: str | None = None) -> DataFrame:
    """The first examples of a category, of one difficulty if it is named (RT-50, RT-51)."""
    rows = examples.where(F.col("field_category") == category)
    return (rows.where(F.col("difficulty") == difficulty) if difficulty else rows).orderBy("ord").limit(most)


def count_examples(examples: DataFrame) -> DataFrame:
    """Examples per category (RT-52)."""
    return examples.groupBy("field_category").agg(F.count("*").alias("n"))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(p)) for p in phrases])


def characteristics(text: Column) -> Column:
    """What a document is like (RT-49): struct(fund_structure, is_fund_of_funds, has_no_limit_language, has_explicit_percentages)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    structure = F.when(_any(low, INTERVAL), "interval_fund").when(F.contains(low, F.lit("tender offer")), "tender_offer_fund").otherwise("unknown")
    return F.struct(structure.alias("fund_structure"), _any(low, FUND_OF_FUNDS[:3]).alias("is_fund_of_funds"), _any(low, NO_LIMIT[:3]).alias("has_no_limit_language"), low.rlike("[1-9]%|[1-9][0-9]%").alias("has_explicit_percentages"))


def _traits(low: Column) -> Column:
    tender = F.contains(low, F.lit("tender offer")) & ~F.contains(low, F.lit("interval"))
    terms = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in TERMS]))
    return F.struct(_any(low, INTERVAL).alias("interval"), tender.alias("tender"), _any(low, NO_LIMIT).alias("no_limit"), _any(low, NEGATIVE).alias("negative"), _any(low, FUND_OF_FUNDS).alias("fof"), F.contains(low, F.lit("explicit")).alias("explicit"), terms.alias("terms"))


def suitable_examples(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """The examples that suit each document (RT-48): key, field_category, rank, ord, score.

    documents: key, field_category, text. Scored by structure, edge cases, shared terms and difficulty; ties keep the library's order. Of one
    fund's examples the first is taken, except for the last place; places that stay empty are filled in order of score. Each text is
    looked through once; documents meet the examples of their category only.
    """
    docs = computed_once(documents.select(key, "field_category", F.lower(F.coalesce(text, F.lit(""))).alias("__low")), {"d": _traits(F.col("__low"))}).drop("__low")
    held = computed_once(examples.withColumn("__low", F.lower(F.coalesce("source_text", F.lit("")))), {"e": _traits(F.col("__low"))}).select("field_category", "ord", "fund_name", "difficulty", "e")
    both = docs.join(held, "field_category")
    on = lambda test, points: F.when(test, points).otherwise(0.0)
    same = F.when((F.col("d.interval") & F.col("e.interval")) | (F.col("d.tender") & F.col("e.tender")), 3.0).when((F.col("d.interval") & F.col("e.tender")) | (F.col("d.tender") & F.col("e.interval")), -1.0).otherwise(0.0)
    level = F.when(F.col("difficulty") == "medium", 0.5).when((F.col("difficulty") == "easy") & F.col("d.explicit"), 0.3).when((F.col("difficulty") == "hard") & F.col("d.no_limit"), 0.8).otherwise(0.0)
    score = same + on(F.col("d.no_limit") & F.col("e.no_limit"), 2.5) + on(F.col("d.negative") & F.col("e.negative"), 1.5) + on(F.col("d.fof") & F.col("e.fof"), 2.0) + F.size(F.array_intersect("d.terms", "e.terms")) * 0.3 + level
    scored = both.groupBy(key, "field_category").agg(F.array_sort(F.collect_list(F.struct((-F.round(score, 6)).alias("minus"), "ord", "fund_name"))).alias("all"))
    none = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("funds"))

    def take(a: Column, x: Column) -> Column:
        n, fund = F.size(a["taken"]), F.coalesce(x["fund_name"], F.lit(""))
        free = (n < most) & (~F.array_contains(a["funds"], fund) | (n >= most - 1))
        return F.when(free, F.struct(F.array_append(a["taken"], x["ord"]).alias("taken"), F.array_append(a["funds"], fund).alias("funds"))).otherwise(a)

    first = computed_once(scored, {"first": F.aggregate("all", none, take)["taken"]})
    rest = F.filter(F.transform("all", lambda x: x["ord"]), lambda o: ~F.array_contains("first", o))
    picked = first.select(key, "field_category", "all", F.posexplode(F.slice(F.concat("first", rest), 1, most)).alias("pos", "ord"))
    points = F.get(F.filter("all", lambda x: x["ord"] == F.col("ord")), F.lit(0))["minus"]
    return picked.select(key, "field_category", (F.col("pos") + 1).alias("rank"), "ord", (-points).alias("score"))
