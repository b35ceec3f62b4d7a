"""Examples for documents; checks of extracted fields against their source."""

from ledgerloom.operators import examples as X
from ledgerloom.operators import field_checks as C


def test_library_and_selection(spark, tmp_path):
    rows = [
        ("fees", 0, "The interval fund pays a management fee.", None, "easy", "A"), ("fees", 1, "A tender offer of 5%.", '{"a": 1}', "medium", "B"), ("fees", 2, "interval fund; no limit; quarterly management fee", None, "hard", "A"),
        ("fees", 3, "interval fund", None, None, "C"), ("repurchase", 0, "x", None, "easy", None),
    ]
    library = spark.createDataFrame(rows, X.EXAMPLES)
    X.write_examples(library, str(tmp_path / "lib.json"))
    back = X.read_examples(spark, str(tmp_path / "lib.json"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str) and X.read_examples(spark, str(tmp_path / "no.json")).count() == 0
    assert {(r["field_category"], r["n"]) for r in X.count_examples(back).collect()} == {("fees", 4), ("repurchase", 1)}
    assert [r["ord"] for r in X.pick_examples(back, "fees", 2).collect()] == [0, 1] and [r["ord"] for r in X.pick_examples(back, "fees", 3, "hard").collect()] == [2]
    docs = spark.createDataFrame([(1, "fees", "An INTERVAL fund without limit: quarterly, management fee."), (2, "fees", None), (3, "other", "x")], "doc_id bigint, field_category string, text string")
    got = {}
    for r in X.suitable_examples(docs, library).collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = (r["ord"], r["score"])
    # 2: 3 + 2.5 + 2 terms + hard; 0: 3 + 1 term, but of the same fund as 2, so 3 comes before it, and the last place is free.
    assert got[1] == {1: (2, 6.9), 2: (3, 3.0), 3: (1, -0.5)}
    assert got[2] == {1: (1, 0.5), 2: (0, 0.0), 3: (2, 0.0)} and 3 not in got
    s = docs.select(X.characteristics(docs["text"]).alias("s")).first()["s"]
    assert tuple(s) == ("interval_fund", False, False, False)


def test_field_checks(spark):
    source = "Class S shares of the interval fund carry a sales load of 3.50% and a minimum of $2,500. Secondaries in private markets; the Adviser will waive. The Fund does not pay incentive fees."
    cases = {
        ("share_classes", "class_name", "CLASS S"): "verified", ("share_classes", "class_name", "Class D"): "unverified", ("share_classes", "sales_load_pct", "3.5"): "verified", ("share_classes", "sales_load_pct", "0"): None,
        ("share_classes", "minimum_initial_investment", "2500"): "verified", ("share_classes", "minimum_initial_investment", "1000000"): "unverified", ("repurchase_terms", "fund_structure", "interval_fund"): "verified",
        ("repurchase_terms", "fund_structure", "tender_offer_fund"): "unverified", ("allocation_targets", "asset_class", "Private Markets Secondaries"): "verified", ("concentration_limits", "has_concentration_limits", "false"): "issue",
        ("incentive_fee", "has_incentive_fee", "false"): "verified", ("expense_cap", "has_fee_waiver", "true"): "verified", ("expense_cap", "cap_rate", "x"): None, ("other", "y", "1"): None,
    }
    df = spark.createDataFrame([(1, *k, source) for k in cases], "id int, field_group string, field string, value string, source string")
    checked = C.check_fields(df)
    assert {(r["field_group"], r["field"], r["value"]): r["status"] for r in checked.collect()} == cases
    status = {r["field_group"]: (r["n_verified"], r["n_unverified"], r["n_issues"], r["is_grounded"]) for r in C.grounding_status(checked, ["id"]).collect()}
    assert status["share_classes"] == (3, 2, 0, True) and status["concentration_limits"] == (0, 0, 1, True) and status["repurchase_terms"] == (1, 1, 0, True)
    fixed = C.correct_minimums(spark.createDataFrame([("S", 2500.0, 50.0, source), ("D", None, None, None)], "class_name string, minimum_initial_investment double, minimum_additional_investment double, source string")).collect()
    assert [(r["minimum_initial_investment"], r["minimum_additional_investment"], r["corrections"]) for r in fixed] == [(2500.0, None, ["minimum_additional_investment"]), (None, None, [])]
