"""Routing by field, validated classes, an agent's steps."""

from pyspark.sql import functions as F

from ledgerloom.operators import decisions as D


def test_routes(spark):
    rows = [("incentive_fee.has_incentive_fee", "a", "b"), ("x.distribution_fee_pct", None, "b"), ("leverage_limits.leverage_basis", "a", "N/A"), ("repurchase_terms.repurchase_basis", "a", "b"), ("incentive_fee.has_catch_up", None, ""), ("odd", "a", "b")]
    df = spark.createDataFrame(rows, "field_path string, left_value string, right_value string")
    got = [(r["routed_value"], r["route"], r["escalated"]) for r in D.route_by_field(df).collect()]
    assert got == [("a", "left_preferred", False), ("b", "left_fallback", False), ("a", "right_fallback", False), ("b", "right_preferred", False), (None, "both_null", True), (None, "disagreement", True)]
    assert D.route_by_field(df, escalate=False).where("field_path = 'odd'").first()["routed_value"] == "a"
    names = {"has_x": "t3_k10", "leverage_basis": "t3_k10", "x.expense_cap_pct": "reranker", "distribution_frequency": "reranker", "other": "t3_k10"}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "f string").select(D.method_for(F.col("f"))).collect()] == list(names.values())


def test_classes_and_steps(spark):
    extracted = spark.createDataFrame([(1, "Class I Shares"), (1, "class s"), (1, "Class D"), (2, "Class I"), (1, None)], "id int, class_name string")
    discovered = spark.createDataFrame([(1, "Class I"), (1, "Class S Shares"), (1, None)], "id int, class_name string")
    got = {(r["id"], r["class_name"]): r["is_validated"] for r in D.validated_classes(extracted, discovered, "id").collect()}
    assert got == {(1, "Class I Shares"): True, (1, "class s"): True, (1, "Class D"): False, (2, "Class I"): False, (1, None): True}
    texts = {'{"action": " Extract ", "action_input": {"a": 1}, "thought": "t"}': ("extract", '{"a":1}', "t"), '{"action": "search_keyword"}': ("search_keywords", "{}", "No reasoning provided"), '{"action": "please stop_success now"}': ("stop_success", "{}", "No reasoning provided"), '{"action": "dance"}': (None,) * 3, "[1]": (None,) * 3, "x": (None,) * 3, None: (None,) * 3}
    rows = D.agent_steps(spark.createDataFrame([(t,) for t in texts], "response string")).collect()
    assert [(r["action"], r["action_input"], r["thought"]) for r in rows] == list(texts.values())
    counts = D.count_confidence(spark.createDataFrame([("m", "Explicit"), ("m", "inferred "), ("m", None), ("m", "N/A")], "method string, confidence string"), ["method"]).first()
    assert (counts["n_explicit"], counts["n_inferred"], counts["n_not_found"]) == (1, 1, 2)
