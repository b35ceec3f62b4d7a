"""Wide tables: versions, spellings, types, failures."""

from datetime import datetime

from ledgerloom.operators import wide

ROWS = "gt_row_id bigint, filing_id string, field_path string, expected string, updated_at timestamp_ntz, cik string"
CATALOG = [wide.Attribute("a.flag", "boolean"), wide.Attribute("a.rate_pct", "number", "a.old_rate"), wide.Attribute("kind", "text"), wide.Attribute("a.classes", "records")]


def cells(spark, rows):
    df = spark.createDataFrame([(i, f, p, e, t, None) for i, (f, p, e, t) in enumerate(rows)], ROWS)
    return sorted(tuple(r) for r in wide.cells_of(wide.widen(df, CATALOG), CATALOG).collect())


def test_latest_decides_even_without_value(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [("f", "A.Flag", "yes", t2), ("f", "a.flag", "no", t1), ("f", "a.old_rate", "5", t1), ("f", "a.rate_pct", "N/A", t2), ("g", "a.rate_pct", "1", None), ("g", "fields.a.ratePct", "2", None), ("h", "kind", "Net  Assets", t1)]
    assert cells(spark, rows) == [("f", "a.flag", "true"), ("g", "a.rate_pct", "2"), ("h", "kind", "net_assets")]


def test_numbers(spark):
    texts = {"5.": "5", ".5": "0.5", "+1,234.50 %": "1234.5", "1.5e+1": "15", "2e-1": "0.2", '"007"': "7", " 12.5 percent": "12.5", "100": "100", "0.0": "0", "-0.50": "-0.5", "1,2": None, "TBD": None, "1e99": None, "1e-15": "0.000000000000001", "500000e-20": "0.000000000000005", "1.10000000000000000000": "1.1", "12000": "12000", "0e-40": "0", "0.00000000000000012345": None, "1.1234567890123456789": None, "7e-99999": None, "": None, "n.m.": None, "-": None}
    rows = [(k or "empty", "a.rate_pct", k, None) for k in texts]
    assert dict((f, c) for f, _, c in cells(spark, rows)) == {k or "empty": v for k, v in texts.items() if v is not None}


def test_numbers_are_exact_or_failures(spark):
    texts = ["0.00000000000000012345", "1.1234567890123456789", "0.5"]
    df = spark.createDataFrame([(i, t, "a.rate_pct", t, None, None) for i, t in enumerate(texts)], ROWS)
    assert {r["filing_id"]: r["cast_failures"] for r in wide.widen(df, CATALOG).collect()} == {t: {"a.rate_pct": t} if t != "0.5" else {} for t in texts}


def test_failures_unknowns_and_empty_entities(spark):
    df = spark.createDataFrame([(1, "f", "a.flag", "maybe", None, "c"), (2, "f", "legacy.x", "1", None, "c"), (3, "f", "a.classes", '[{"class_name": "A"}]', None, "c"), (4, "g", "kind", "none", None, "c"), (5, None, "kind", "x", None, None), (6, "f", None, "x", None, None)], ROWS)
    got = {r["filing_id"]: r for r in wide.widen(df, CATALOG).collect()}
    assert got["f"]["cast_failures"] == {"a.flag": "maybe"} and got["f"]["n_unknown"] == 2 and got["f"]["a__classes"] == '[{"class_name": "A"}]'
    assert got["g"]["kind"] is None and got["g"]["cast_failures"] == {} and got[None]["kind"] == "x"
    assert wide.widen(df.limit(0), CATALOG).count() == 0
    assert sorted((r["field_path"] or "", r["value"]) for r in wide.others(df, CATALOG).collect()) == [("", "x"), ("legacy.x", "1")]
    assert wide.widen(df, []).columns == ["filing_id", "cast_failures", "n_unknown"]
