"""The queries of the general data problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import nested, orphans, units, wide
from ledgerloom.sources.tables import table
from ledgerloom.workspace import materialise


def _unit_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, d, "repurchase_terms", "extraction_id", "method", "lock_up_period_years", "lock_up_period_days", "citation"),
        table(spark, d, "leverage_limits", "extraction_id", "method", "max_leverage_pct", "leverage_basis", "citation"),
        table(spark, d, "unit_conventions"),
    )


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    terms, limits, notes = _unit_tables(spark, d)
    return units.parse_values(units.all_values(terms, limits), notes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that the mixture, held to what is stated of each, puts in another unit than the declared one, converted."""
    return units.decided_conversions(_parsed(spark, d)).select("extraction_id", "field_name", "common_value")


def p1_harmonised(spark: SparkSession, d: str) -> DataFrame:
    """Every stated value with evidence, unit, common value, posterior and flag."""
    return units.harmonise_units(*_unit_tables(spark, d))


def p1_inferred(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's record per field on bare numbers whose stated unit is hidden from it: how many, sure, right, both."""
    by_method = units.held_out(materialise(_parsed(spark, d), "units"))
    return by_method.groupBy("field_name").agg(*[F.sum(c).alias(c) for c in ("n_values", "n_sure", "n_right", "n_sure_right")])


def _nested(spark: SparkSession, d: str, *tables: str, content: bool = True) -> DataFrame:
    return nested.flatten_records(table(spark, d, "raw_nested", "record_id", "body"), tables, content)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per child row of every usable body."""
    return _nested(spark, d, *nested.PARENT_OF, content=False).select("record_id", "child_table", "parent_key", "child_ord", "child_key")


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The bodies themselves: the parents of four tables."""
    rows = nested.child_table(_nested(spark, d, nested.BODIES), nested.BODIES, fund_name="string", cik="string", filing_date="date", form_type="string", verified_by="string", notes="string", run_id="string", ground_truth_version="string")
    return rows.drop("parent_key", "child_ord", "child_key", "pre", "post", "parent_pre", "value")


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of expected fields; `given` is a value that stands without a record, or a scalar `expected`."""
    rows = nested.child_table(_nested(spark, d, "fields"), "fields", expected="string", nullable="boolean", tolerance="double", match_mode="string", source_section="string", source_quote="string")
    bare = F.when(F.col("value") != "null", F.get_json_object("value", "$"))
    return rows.select("record_id", F.col("child_key").alias("field_path"), F.coalesce("expected", bare).alias("given"), "nullable", "tolerance", "match_mode", "source_section", "source_quote")


def p3_share_classes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of share classes, each with the path and place it stands at."""
    rows = nested.child_table(_nested(spark, d, "share_classes"), "share_classes", minimum_initial_investment="bigint", minimum_additional_investment="bigint", sales_load_pct="double", distribution_fee_pct="double")
    return rows.select("record_id", F.col("parent_key").alias("field_path"), F.col("child_ord").alias("ord"), F.col("child_key").alias("class_name"), "minimum_initial_investment", "minimum_additional_investment", "sales_load_pct", "distribution_fee_pct")


def p3_funds(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of fund results."""
    funds = nested.child_table(_nested(spark, d, "per_fund"), "per_fund", accuracy="double", precision="double", recall="double", f1_score="double", total_fields="int", correct_fields="int")
    return funds.withColumnRenamed("child_key", "fund_name").drop("body_ord", "parent_key", "child_ord", "pre", "post", "parent_pre", "value")


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of error counts per fund result."""
    rows = _nested(spark, d, "error_breakdown")
    return rows.select("record_id", F.col("parent_key").alias("fund_name"), F.col("child_key").alias("error_type"), F.col("value").try_cast("bigint").alias("n"))


def p3_field_results(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of field results."""
    rows = nested.child_table(_nested(spark, d, "per_field"), "per_field", total="int", correct="int")
    return rows.select("record_id", F.col("child_key").alias("field_path"), "total", "correct")


def p3_fund_lists(spark: SparkSession, d: str) -> DataFrame:
    """The two fund lists of the field results, one row per element."""
    rows = _nested(spark, d, "funds_correct", "funds_incorrect", content=False)
    return rows.select("record_id", F.col("child_table").alias("list_name"), F.col("parent_key").alias("field_path"), F.col("child_ord").alias("ord"), F.col("child_key").alias("fund_name"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """What no other table holds: leaves deeper than a typed row's own members."""
    rows = _nested(spark, d, nested.MEMBERS)
    return rows.select("record_id", "parent_table", "parent_key", F.col("child_key").alias("member_path"), F.when(F.col("value") != "null", F.get_json_object("value", "$")).alias("value"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.filing_orphans(
        table(spark, d, "funds", "cik", "created_at", "deleted_at"),
        table(spark, d, "submissions", "row_id", "accession_number", "cik", "quarter", "loaded_at", "deleted_at"),
        table(spark, d, "fund_periods", "row_id", "accession_number", "quarter", "loaded_at"),
        table(spark, d, "monthly_returns", "row_id", "accession_number", "quarter", "loaded_at"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references."""
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and period."""
    return orphans.orphan_report(_orphans(spark, d))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expected_fields", "gt_row_id", "filing_id", "field_path", "expected", "updated_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the wide table."""
    catalog = wide.catalog_of(table(spark, d, "field_catalog"))
    return wide.cells_of(wide.widen(_expected(spark, d), catalog), catalog)


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table itself, with the cast failures as sorted text entries."""
    catalog = wide.catalog_of(table(spark, d, "field_catalog"))
    df = wide.widen(_expected(spark, d), catalog)
    return df.withColumn("cast_failures", F.array_join(F.array_sort(F.transform(F.map_entries("cast_failures"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";"))


def p5_failures(spark: SparkSession, d: str) -> DataFrame:
    """What the wide table could not take: values that cannot be read as their type, and how many attributes have no column."""
    return p5_wide(spark, d).select("filing_id", "cast_failures", "n_unknown")


def p5_others(spark: SparkSession, d: str) -> DataFrame:
    """The attributes outside the catalog, in rows."""
    return wide.others(_expected(spark, d), wide.catalog_of(table(spark, d, "field_catalog")))


QUERIES = {f.__name__: f for f in (p1_found, p1_harmonised, p1_inferred, p3_found, p3_bodies, p3_fields, p3_share_classes, p3_funds, p3_errors, p3_field_results, p3_fund_lists, p3_members, p4_found, p4_report, p5_found, p5_wide, p5_failures, p5_others)}
