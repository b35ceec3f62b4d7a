"""Ground-truth sheets: rows of category, datapoint and value, in which names of classes and allocations hold for the rows below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import trimmed

# Datapoint in words → field.
FIELD_NAMES = {
    "fund name": "fund_name", "fund manager": "fund_manager", "sponsor": "sponsor", "fund cik": "fund_cik", "fund currency": "fund_currency", "fund type": "fund_type", "fiscal year end": "fiscal_year_end",
    "number of share types": "number_of_share_types", "fund target investment type": "fund_target_investment_type", "fund target asset class": "fund_target_asset_class",
    "fund target asset classes, as defined by gp": "fund_target_asset_classes_gp", "fund target geography": "fund_target_geography", "target commitments invested": "target_commitments_invested",
    "target commitments invested incl subscription lines": "target_commitments_invested_incl_sub", "maximum fund-level leverage %": "max_fund_leverage_pct", "maximum fund-level leverage basis": "max_fund_leverage_basis",
    "management fee %": "management_fee_pct", "management fee basis": "management_fee_basis", "estimated subscription interest payments": "estimated_subscription_interest",
    "estimated acquired fund fees and expenses": "estimated_affe", "estimated other expenses": "estimated_other_expenses",
    "repurchase %": "repurchase_pct", "maximum repurchase %": "max_repurchase_pct", "maximum repurchase basis": "repurchase_basis", "repurchase frequency": "repurchase_frequency", "lock-up period (years)": "lockup_period_years",
    "lock-up maximum early repurchase deduction": "lockup_early_repurchase_deduction", "lock-up early repurchase deduction": "lockup_early_repurchase_deduction", "mandatory repurchase minimum": "mandatory_repurchase_minimum",
    "target distribution frequency": "target_distribution_frequency", "default distribution policy": "default_distribution_policy",
    "share name": "share_name", "offering price": "offering_price", "fee at commitment (sales load) %": "sales_load_percent", "distribution / service fee %": "distribution_fee_percent",
    "minimum initial investment": "minimum_initial", "minimum follow-on investment": "minimum_followon", "repurchase threshold": "repurchase_threshold",
    "allocation target minimum": "target_min", "allocation target maximum": "target_max", "allocation target - single point": "target_single",
    "maximum allocation to single asset": "max_single_asset", "maximum allocation to single fund": "max_single_fund", "maximum allocation to single manager": "max_single_manager",
    "maximum allocation to single country": "max_single_country", "maximum allocation to single sector": "max_single_sector", "derivatives": "derivatives_allowed", "expected derivative use": "expected_derivative_use",
}
# Categories of allocations, the datapoints that give an allocation's numbers, and spellings of no value.
ALLOCATIONS = ("investment type", "asset class", "geography")
TARGETS = ("allocation target minimum", "allocation target maximum", "allocation target - single point")
NO_VALUE = ("none", "n/a", "not applicable", "", "nan")


def field_name(c: Column) -> Column:
    """The field that a datapoint in words names (SC-13, SC-14): by the table, else its words joined by underscores; empty for null."""
    low = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    named = F.create_map(*[F.lit(x) for kv in FIELD_NAMES.items() for x in kv])[low]
    return F.coalesce(named, F.regexp_replace(low, "[ -]", "_"))


def sheet_value(c: Column) -> Column:
    """A cell as text (SC-12): null if it states nothing, a number without thousands commas."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(*NO_VALUE), F.when(t.rlike(r"^[+-]?[0-9][0-9,]*(?:\.[0-9]*)?$"), F.regexp_replace(t, ",", "")).otherwise(t))


def datapoints(rows: DataFrame) -> DataFrame:
    """The datapoints of sheets (SRC-15): sheet, key, value, category, notes; of a key that occurs again the last row decides.

    rows: sheet, row_no, category, datapoint, value, notes. In a category `Share type n` keys get the number of the class whose name was
    last given above, and there are none before the first name; in an allocation category a row of another datapoint names the allocation, under
    whose name the targets below it come. Rows without a datapoint are left out.
    """
    category, low = F.lower(F.coalesce(trimmed(F.col("category")), F.lit(""))), F.lower(trimmed(F.col("datapoint")))
    df = rows.where(low.isNotNull() & (low != "")).withColumns({"cat": category, "low": low, "field": field_name(F.col("datapoint")), "v": sheet_value(F.col("value"))})
    number = F.regexp_extract("cat", r"share type ([0-9]+)", 1)
    above = Window.partitionBy("sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_class, in_allocation = F.startswith("cat", F.lit("share type")) & (number != ""), F.col("cat").isin(*ALLOCATIONS)
    names_one = in_allocation & ~F.col("low").isin(*TARGETS)
    named = F.struct(F.regexp_replace("cat", " ", "_").alias("kind"), F.regexp_replace("low", " ", "_").alias("name"))
    df = df.withColumns({
        "class_key": F.last(F.when(in_class & (F.col("field") == "share_name"), F.concat(F.lit("share_class_"), number)), True).over(above),
        "allocation": F.last(F.when(names_one, named), True).over(above),
    })
    other = ~F.startswith("cat", F.lit("share type")) & ~in_allocation
    key = F.when(in_class, F.concat("class_key", F.lit("."), "field")).when(in_allocation & ~names_one, F.concat("allocation.kind", F.lit("."), "allocation.name", F.lit("."), "field")).when(other, F.col("field"))
    last = df.withColumn("key", key).where("key is not null").groupBy("sheet", "key").agg(F.max_by(F.struct("v", F.trim("category").alias("c"), "notes"), "row_no").alias("r"))
    return last.select("sheet", "key", F.col("r.v").alias("value"), F.col("r.c").alias("category"), F.col("r.notes").alias("notes"))


def read_workbook(spark: SparkSession, path: str, sheets: list[str]) -> DataFrame:
    """The rows of a workbook as `datapoints` takes them, if a library for workbooks is there; the value column is the first that is no other."""
    import pandas as pd  # with openpyxl, which is optional

    out = []
    for sheet in sheets:
        df = pd.read_excel(path, sheet_name=sheet, dtype=str)
        names = {c.lower(): c for c in df.columns}
        value = next((c for c in df.columns if c.lower() not in ("data category", "datapoint", "notes")), None)
        if value is None:
            raise ValueError(f"the sheet {sheet} has no column of values")
        get = lambda r, n: r.get(names.get(n)) if isinstance(r.get(names.get(n)), str) else None
        out += [(sheet, i, get(r, "data category"), get(r, "datapoint"), r[value] if isinstance(r[value], str) else None, get(r, "notes")) for i, r in enumerate(df.to_dict("records"))]
    return spark.createDataFrame(out, "sheet string, row_no int, category string, datapoint string, value string, notes string")
