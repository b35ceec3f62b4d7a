"""The star schema: typing, loading quarters twice, restatements, views; ground-truth sheets."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import star
from ledgerloom.sources import sheets


def raw(spark, name="Fund A", value="100.50", restricted="Y"):
    table = lambda columns, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))
    return {
        "registrant": table("ACCESSION_NUMBER CIK REGISTRANT_NAME LEI", ("a1", "7", name, None), ("a2", "8", "Fund B", "L8")),
        "submission": table("ACCESSION_NUMBER FILING_DATE REPORT_DATE", ("a1", "28-FEB-2025", "2024-12-31"), ("a2", "bad", None)),
        "fund_reported_info": table("ACCESSION_NUMBER SERIES_NAME NET_ASSETS SALES_FLOW_MON1 SALES_FLOW_MON2 REDEMPTION_FLOW_MON1", ("a1", "S", "1000", "5", "x", "2"), ("a2", "T", "90d", None, None, None)),
        "fund_reported_holding": table("ACCESSION_NUMBER HOLDING_ID CURRENCY_VALUE FAIR_VALUE_LEVEL IS_RESTRICTED_SECURITY", ("a1", "1", value, "1", restricted), ("a1", "2", "7", "3", "N"), ("a1", "3", None, "2", None)),
        "debt_security": table("HOLDING_ID MATURITY_DATE ANNUALIZED_RATE", ("1", "15-JAN-2030", "4.5")),
    }


def test_quarters_replace_and_funds_merge(spark, tmp_path):
    store = str(tmp_path / "store")
    assert star.open_store(spark, store)["fund_quarter_summary"].count() == 0
    star.load_quarter(raw(spark), "2024q4", store)
    star.load_quarter(raw(spark), "2024q4", store)
    star.load_quarter(raw(spark, value="1"), "2025q1", store)
    star.load_quarter(raw(spark, name="Fund A2", value="200", restricted="N"), "2024q4", store)  # a restatement
    tables = star.open_store(spark, store)
    assert sorted(tuple(r) for r in tables["funds"].select("cik", "name", "lei").collect()) == [("7", "Fund A2", None), ("8", "Fund B", "L8")]
    assert {(r["quarter"], r["n"]) for r in spark.sql("select quarter, count(*) as n from submissions group by quarter").collect()} == {("2024q4", 2), ("2025q1", 2)}
    dates = {r["accession_number"]: (r["filing_date"], r["report_date"]) for r in tables["submissions"].where("quarter = '2024q4'").collect()}
    assert dates == {"a1": (date(2025, 2, 28), date(2024, 12, 31)), "a2": (None, None)}
    rows = {(r["cik"], r["quarter"]): r for r in spark.sql("select * from fund_quarter_summary").collect()}
    a, b = rows["7", "2024q4"], rows["8", "2024q4"]
    # Filings keep their number in both quarters here, so each period meets the holdings of both.
    assert a["holdings_count"] == 3 and a["net_assets"] == Decimal("1000.00") and a["net_flows"] == Decimal("3.00") and a["level3_value"] == Decimal("14.00")
    assert a["level1_value"] == Decimal("201.00") and a["restricted_value"] == Decimal("1.00") and b["holdings_count"] == 0 and b["net_assets"] is None and b["level1_value"] == 0
    assert tables["debt_securities"].first()["maturity_date"] == date(2030, 1, 15)


def test_sheets(spark):
    rows = [
        ("Fund data", "Fund name", "X Fund", None), ("Fund data", "fund CIK", "0001", "see cover"), ("Fees", "Management fee %", "1,250.5", None), ("Share type 1", "offering price", "9", None),
        ("Share type 1", "share name", "Class I", None), ("Share type 1", "minimum initial investment", "1,000,000", None), ("Share type 2", "Share name", "Class S", None), ("Share type 2", "repurchase threshold", "N/A", None),
        ("Asset class", "Private Equity", None, None), ("Asset class", "allocation target minimum", "20", None), ("asset class", "Allocation target maximum", "40", None), ("Geography", "North America", "", None), ("Geography", "allocation target - single point", "70", None),
        ("Concentration limits", "derivatives", "No", None), (None, None, "lost", None), ("Other", "Odd-name here", "v", None), ("Fund data", "Fund name", "Y Fund", None),
    ]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "sheet string, row_no int, category string, datapoint string, value string, notes string")
    got = {r["key"]: r["value"] for r in sheets.datapoints(df).collect()}
    assert got == {
        "fund_name": "Y Fund", "fund_cik": "0001", "management_fee_pct": "1250.5", "share_class_1.share_name": "Class I", "share_class_1.minimum_initial": "1000000", "share_class_2.share_name": "Class S", "share_class_2.repurchase_threshold": None,
        "asset_class.private_equity.target_min": "20", "asset_class.private_equity.target_max": "40", "geography.north_america.target_single": "70", "derivatives_allowed": "No", "odd_name_here": "v",
    }
    assert sheets.datapoints(df.limit(0)).count() == 0
    names = {"fund name": "fund_name", "management fee %": "management_fee_pct", "lock-up period (years)": "lockup_period_years", None: ""}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "a string").select(sheets.field_name(F.col("a"))).collect()] == list(names.values())
