"""The holdings star schema: typed tables, loading of quarters from raw tables, the store, and the quarterly summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.holdings import coerced, first_by, net_flows, upsert
from ledgerloom.sources.quarters import overwrite_quarters

_FLOWS = ", ".join(f"{kind}_flow_mon{i} decimal(18,2)" for kind in ("sales", "redemption", "reinvestment") for i in (1, 2, 3))
# The columns and types of the tables.
TABLES = {
    "funds": "cik string, name string, fund_type string, lei string",
    "submissions": "accession_number string, cik string, filing_date date, report_date date, quarter string",
    "fund_periods": f"accession_number string, cik string, series_name string, series_id string, series_lei string, report_date date, total_assets decimal(18,2), total_liabilities decimal(18,2), net_assets decimal(18,2), {_FLOWS}, gross_sales decimal(18,2), gross_redemptions decimal(18,2), net_flows decimal(18,2), quarter string",
    "monthly_returns": "accession_number string, id int, class_id string, monthly_total_return1 decimal(10,6), monthly_total_return2 decimal(10,6), monthly_total_return3 decimal(10,6), quarter string",
    "holdings": "accession_number string, holding_id bigint, issuer_name string, issuer_lei string, issuer_title string, issuer_cusip string, balance decimal(18,4), unit string, currency_code string, currency_value decimal(18,2), exchange_rate decimal(12,6), percentage decimal(10,6), payoff_profile string, asset_cat string, issuer_type string, investment_country string, is_restricted_security string, fair_value_level string, derivative_cat string, quarter string",
    "holding_identifiers": "holding_id bigint, identifiers_id bigint, identifier_isin string, identifier_ticker string, other_identifier string, other_identifier_desc string, quarter string",
    "debt_securities": "holding_id bigint, maturity_date date, coupon_type string, annualized_rate decimal(10,6), is_default string, are_any_interest_payment string, is_any_portion_interest_paid string, is_convtible_mandatory string, is_convtible_contingent string, quarter string",
}
#: Raw table of each table (funds come from the registrants), and raw columns of another name than the table's in capitals.
RAW = {"submissions": "submission", "fund_periods": "fund_reported_info", "monthly_returns": "monthly_total_return", "holdings": "fund_reported_holding", "holding_identifiers": "identifiers", "debt_securities": "debt_security"}
RAW_NAMES = {"id": "MONTHLY_TOTAL_RETURN_ID", "name": "REGISTRANT_NAME"}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in TABLES[name].split(", ")]


def typed(raw: DataFrame, name: str, quarter: str | None = None) -> DataFrame:
    """A raw table of texts with the columns and types of `name` (REL-10, REL-11, REL-20): unreadable values and absent columns are null, a number has to be one as a whole."""
    have = {c.upper(): c for c in raw.columns}
    of = {c: have.get(RAW_NAMES.get(c, c.upper())) for c, _ in _columns(name)}
    numbers = [of[c] for c, t in _columns(name) if of[c] and t.startswith(("decimal", "int", "bigint"))]
    rows = coerced(raw, numbers, "string")

    def value(c: str, t: str) -> Column:
        if c == "quarter" and quarter is not None:
            return F.lit(quarter)
        if of[c] is None:
            return F.lit(None)
        text = F.trim(F.col(of[c]).cast("string"))
        # Dates of the quarterly files are written 31-DEC-2024, others as usual.
        return F.coalesce(F.try_to_timestamp(F.initcap(text), F.lit("dd-MMM-yyyy")).cast("date"), text.try_cast("date")) if t == "date" else text

    return rows.select(*[value(c, t).try_cast(t).alias(c) for c, t in _columns(name)])


def quarter_tables(raw: dict[str, DataFrame], quarter: str) -> dict[str, DataFrame]:
    """The tables of one quarter from its raw tables (REL-07, REL-08, REL-17): `registrant` gives each filing its cik, flows are summed over the months.

    Raw tables that are absent are left out. A filing of several registrants takes the first cik in order.
    """
    out = {name: typed(raw[r], name, quarter) for name, r in RAW.items() if r in raw}
    if "registrant" in raw:
        names = {c.upper(): c for c in raw["registrant"].columns}
        ciks = raw["registrant"].groupBy(F.col(names["ACCESSION_NUMBER"]).alias("accession_number")).agg(F.min(names["CIK"]).alias("cik"))
        for name in ("submissions", "fund_periods"):
            if name in out:
                columns = out[name].columns
                out[name] = out[name].drop("cik").join(ciks, "accession_number", "left").select(columns)
        out["funds"] = typed(raw["registrant"], "funds")
    if "fund_periods" in out:
        columns = out["fund_periods"].columns
        money = {c: F.col(c).cast("decimal(18,2)") for c in ("gross_sales", "gross_redemptions", "net_flows")}
        out["fund_periods"] = net_flows(out["fund_periods"].drop(*money)).withColumns(money).select(columns)
    return out


def load_quarter(raw: dict[str, DataFrame], quarter: str, store: str) -> None:
    """Load a quarter into the store (REL-17, SRC-05, SNK-13..18): its rows replace those that the store has of it, funds are merged by cik.

    The funds are written as a version beside the old ones, complete or not there, so a reader sees one state or the other.
    """
    tables = quarter_tables(raw, quarter)
    funds = tables.pop("funds", None)
    for name, df in tables.items():
        overwrite_quarters(df, store, name)
    if funds is not None:
        spark = funds.sparkSession
        new = funds.where("cik is not null")
        merged = upsert(read_table(spark, store, "funds"), new, "cik", ["name"], ["fund_type", "lei"], [F.desc_nulls_last("name"), F.desc_nulls_last("lei")])
        version = latest_version(spark, store) + 1
        merged.write.mode("overwrite").parquet(f"{store}/funds/version={version}")


def latest_version(spark: SparkSession, store: str) -> int:
    """The newest complete version of the funds; -1 if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/funds")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(inside(s.getPath(), "_SUCCESS"))]
    return max((int(n.split("=")[1]) for n in done if n.startswith("version=")), default=-1)


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store over all quarters; empty with its types if nothing was loaded (REL-18, REL-19)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if name == "funds":
        version = latest_version(spark, store)
        return spark.read.schema(TABLES[name]).parquet(f"{store}/{name}/version={version}") if version >= 0 else spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(f"{store}/{name}") if there else spark.createDataFrame([], TABLES[name])


def open_store(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of the store and `fund_quarter_summary` as views for `spark.sql` (REL-16, REL-19); returns them too."""
    tables = {name: read_table(spark, store, name) for name in TABLES}
    tables["fund_quarter_summary"] = fund_quarter_summary(tables["funds"], tables["fund_periods"], tables["holdings"])
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def fund_quarter_summary(funds: DataFrame, fund_periods: DataFrame, holdings: DataFrame) -> DataFrame:
    """One row per fund, quarter and stated amounts, with what its filings hold (REL-14): holdings_count and the value by level and of restricted securities.

    Holdings are aggregated by filing and holding before the join, so a fund's periods meet one row per filing; periods of a fund that is
    not known are left out, those without holdings count 0.
    """
    value = F.coalesce("currency_value", F.lit(0).cast("decimal(18,2)"))
    zero = F.lit(0).cast("decimal(18,2)")
    sums = {f"level{n}_value": F.col("fair_value_level") == str(n) for n in (1, 2, 3)} | {"restricted_value": F.col("is_restricted_security") == "Y"}
    by_holding = holdings.groupBy("accession_number", "holding_id").agg(*[F.sum(F.when(test, value).otherwise(zero)).alias(n) for n, test in sums.items()])
    fund = first_by(funds.where("cik is not null"), ["cik"], [F.col("name")]).select("cik", F.col("name").alias("fund_name"), "fund_type")
    keys = ["cik", "fund_name", "fund_type", "quarter", "report_date", "net_assets", "gross_sales", "gross_redemptions", "net_flows"]
    rows = fund_periods.join(fund, "cik").select(*keys, "accession_number").join(by_holding, "accession_number", "left")
    total = lambda n: F.coalesce(F.sum(n), zero).cast("decimal(28,2)").alias(n)
    return rows.groupBy(*keys).agg(F.countDistinct("holding_id").alias("holdings_count"), *[total(n) for n in sums])
