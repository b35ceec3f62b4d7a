"""Evaluation against ground truth: error types, precision and recall, breakdowns, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalise import class_key, comparable, values_match
from ledgerloom.functions.once import computed_once
from ledgerloom.functions.text import states_nothing

# The outcomes of a field.
OUTCOMES = ("correct", "wrong_value", "missed", "hallucinated")


def judge(predicted: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Each expected field with its prediction (EV-01): keys, expected, extracted, correct, error_type. Fields only predicted are hallucinated if they state something."""
    both = expected.select(*keys, F.col("value").alias("expected")).join(predicted.select(*keys, F.col("value").alias("extracted")), keys, "full")
    got, want = F.col("extracted"), F.col("expected")
    both = computed_once(both, {"__a": comparable(got), "__b": comparable(want), "has_value": ~states_nothing(got), "has_truth": ~states_nothing(want)})
    both = computed_once(both, {"correct": F.coalesce(values_match(got, want, tolerance, (F.col("__a"), F.col("__b"))), F.lit(False))}).drop("__a", "__b")
    error = F.when(F.col("correct"), "correct").when(F.col("has_value") & F.col("has_truth"), "wrong_value").when(F.col("has_truth"), "missed").otherwise("hallucinated")
    return both.withColumn("error_type", error)


def scores(n: Column, correct: Column, extracted: Column, extracted_ok: Column, expected: Column, expected_ok: Column) -> dict[str, Column]:
    """precision, recall, f1 and accuracy from counts (EV-06..14); recall is 1 where nothing was expected."""
    p = F.when(extracted > 0, extracted_ok / F.nullif(extracted, F.lit(0))).otherwise(0.0)
    r = F.when(expected > 0, expected_ok / F.nullif(expected, F.lit(0))).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6), "accuracy": F.round(correct / F.nullif(n, F.lit(0)), 6)}


def _counts() -> dict[str, Column]:
    ok = F.col("correct")
    return {"n": F.count("*"), "n_correct": F.count_if(ok), "n_extracted": F.count_if(F.col("has_value")), "ok_extracted": F.count_if(ok & F.col("has_value")), "n_expected": F.count_if(F.col("has_truth")), "ok_expected": F.count_if(ok & F.col("has_truth"))}


def metrics(judged: DataFrame, by: list[str]) -> DataFrame:
    """Counts, scores and zero-filled outcome counts per group, or overall for no `by` (EV-05..14)."""
    outcomes = {f"n_{o}_type": F.count_if(F.col("error_type") == o) for o in OUTCOMES}
    g = judged.groupBy(*by).agg(*[c.alias(n) for n, c in (_counts() | outcomes).items()])
    c = [F.col(x) for x in ("n", "n_correct", "n_extracted", "ok_extracted", "n_expected", "ok_expected")]
    return g.withColumns(scores(*c)).select(*by, "n", "n_correct", "precision", "recall", "f1", "accuracy", *outcomes)


def metric_sets(judged: DataFrame, first: str, second: str) -> DataFrame:
    """Totals overall, by each of two columns and by both in one pass over grouping sets (EV-20): grouping_level tells which."""
    out = judged.groupingSets([[], [first], [second], [first, second]], first, second).agg(F.grouping_id().alias("grouping_level"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return out.select(first, second, F.col("grouping_level").cast("bigint").alias("grouping_level"), "n", "n_correct")


def field_report(judged: DataFrame, field: str, entity: str) -> DataFrame:
    """Per field: totals and how many distinct entities have it right and wrong (EV-15)."""
    right = F.when(F.col("correct"), F.col(entity))
    wrong = F.when(~F.col("correct"), F.col(entity))
    return judged.groupBy(field).agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct"), F.countDistinct(right).alias("entities_correct"), F.countDistinct(wrong).alias("entities_incorrect"), F.round(F.count_if("correct") / F.count("*"), 6).alias("accuracy"))


def extremes(report: DataFrame, n: int, worst: bool = True) -> DataFrame:
    """The n fields of lowest (or highest) accuracy, ties by name (EV-22, EV-23)."""
    name = report.columns[0]
    return report.orderBy(F.asc("accuracy") if worst else F.desc("accuracy"), name).limit(n)


def compare_runs(baseline: DataFrame, variant: DataFrame, key: str) -> DataFrame:
    """Accuracies of two runs by key with delta and verdict; what a run lacks counts as 0 (EV-24, EV-26)."""
    b, v = baseline.select(key, F.col("accuracy").alias("baseline")), variant.select(key, F.col("accuracy").alias("variant"))
    both = b.join(v, key, "full").select(key, F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("variant", F.lit(0.0)).alias("variant"))
    delta = F.round(F.col("variant") - F.col("baseline"), 6)
    return both.withColumns({"delta": delta, "verdict": F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("same")})


def judge_records(got: DataFrame, want: DataFrame, keys: list[str], name: str, attributes: list[str], tolerance: float = 0.01) -> DataFrame:
    """Lists of records compared by normalised name, attribute by attribute (EV-02, EV-03, SC-08): keys, name, attribute, expected, extracted, correct.

    Only attributes that the expected record states are judged; a record that is not found has null extracted. Several records of one
    name count once, the first by its values.
    """

    def tall(df: DataFrame, value: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias(value)) for a in attributes])
        rows = df.select(*keys, class_key(F.col(name)).alias("name"), F.explode(cells).alias("c")).select(*keys, "name", "c.attribute", f"c.{value}")
        return rows.groupBy(*keys, "name", "attribute").agg(F.min(value).alias(value))

    both = tall(want, "expected").where(~states_nothing(F.col("expected"))).join(tall(got, "extracted"), [*keys, "name", "attribute"], "left")
    both = computed_once(both, {"__a": comparable(F.col("extracted")), "__b": comparable(F.col("expected"))})
    match = values_match(F.col("extracted"), F.col("expected"), tolerance, (F.col("__a"), F.col("__b")))
    return both.withColumn("correct", F.coalesce(match, F.lit(False))).drop("__a", "__b")
