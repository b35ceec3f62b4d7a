"""Nested bodies: layouts, wrappings, interval links, what no table is made for."""

import json

from ledgerloom.operators import nested

CLASS = {"class_name": "Class A", "sales_load_pct": "1"}


def rows_of(spark, bodies, tables=(nested.BODIES, *nested.PARENT_OF, nested.MEMBERS)):
    raw = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "record_id bigint, body string, extra string")
    return nested.flatten_records(raw, tables).collect()


def flat(spark, *bodies):
    return sorted((r["record_id"], r["child_table"], r["parent_key"], r["child_ord"], r["child_key"]) for r in rows_of(spark, bodies, tuple(nested.PARENT_OF)))


def members(spark, body):
    return {(r["parent_table"], r["parent_key"], r["child_key"]): r["value"] for r in rows_of(spark, [json.dumps(body)]) if r["child_table"] == "members"}


def test_fields_and_share_classes(spark):
    body = {"fund_name": "F", "fields": {"a.b": {"expected": 1}, "c": "bare", "share_classes.share_classes": {"expected": [None, CLASS, {"x": 1}]}}}
    want = [(0, "fields", "", 0, "a.b"), (0, "fields", "", 0, "c"), (0, "fields", "", 0, "share_classes.share_classes"), (0, "share_classes", "share_classes.share_classes", 2, "Class A"), (0, "share_classes", "share_classes.share_classes", 3, "")]
    assert flat(spark, json.dumps(body)) == want
    assert members(spark, body) == {("fields", "share_classes.share_classes", "expected[1]"): "null"}


def test_wrappings_give_the_same(spark):
    body = {"fields": {"share_classes.share_classes": {"expected": json.dumps([CLASS])}}}
    alone = {"fields": [{"field_path": "share_classes.share_classes", "expected": CLASS}]}
    variants = [json.dumps(body), "﻿" + json.dumps(body, indent=1), json.dumps(json.dumps(body)), json.dumps([body]), json.dumps({"schema_version": 2, "ground_truth": body}), json.dumps(alone)]
    rows = flat(spark, *variants)
    assert rows == sorted((i, *r) for i in range(len(variants)) for r in [("fields", "", 0, "share_classes.share_classes"), ("share_classes", "share_classes.share_classes", 1, "Class A")])


def test_evaluation_tables(spark):
    one = {"accuracy": 0.5, "error_breakdown": {"correct": 1, "missed": 0}}
    field = {"total": 2, "funds_correct": ["F", "G"], "funds_incorrect": None}
    a = {"per_fund": {"F": one}, "per_field": {"x.y": field}}
    b = {"evaluation": {"per_fund": [{"fund_name": "F", **one}], "per_field": {"x.y": field}}}
    want = [("error_breakdown", "F", 0, "correct"), ("error_breakdown", "F", 0, "missed"), ("funds_correct", "x.y", 1, "F"), ("funds_correct", "x.y", 2, "G"), ("per_field", "", 0, "x.y"), ("per_fund", "", 0, "F")]
    assert flat(spark, json.dumps(a), json.dumps(b)) == [(i, *w) for i in (0, 1) for w in want]


def test_nothing_is_lost(spark):
    body = {"fund_name": "F", "overall": {"precision": 0.5, "by": [{"q": 1}, []]}, "fields": {"l": {"expected": ["a", "b"], "nullable": True}, "d": {"expected": {"k": 1}}, "bare": ["x"], "e": {"expected": {}}}, "per_fund": [7, {"fund_name": "G", "deep": {"n": None}}]}
    assert members(spark, body) == {
        ("bodies", "", "overall.precision"): "0.5", ("bodies", "", "overall.by[1].q"): "1", ("bodies", "", "overall.by[2]"): "[]", ("bodies", "", "per_fund[1]"): "7",
        ("fields", "l", "expected[1]"): '"a"', ("fields", "l", "expected[2]"): '"b"', ("fields", "d", "expected.k"): "1", ("fields", "bare", "[1]"): '"x"', ("fields", "e", "expected"): "{}", ("per_fund", "G", "deep.n"): "null",
    }
    root = next(r for r in rows_of(spark, [json.dumps({"schema_version": 2, "ground_truth": body})]) if r["child_table"] == "bodies")
    assert json.loads(root["scalars"]) == {"schema_version": 2, "fund_name": "F"} and root["parent_pre"] is None


def test_bodies_of_one_record_are_told_apart(spark):
    rows = rows_of(spark, [json.dumps([{"fields": {"a": 1}}, {"fields": {"a": 2}}])])
    bodies = {r["body_ord"]: r["pre"] for r in rows if r["child_table"] == "bodies"}
    assert {(r["parent_pre"], r["value"]) for r in rows if r["child_table"] == "fields"} == {(bodies[0], "1"), (bodies[1], "2")}


def test_unusable_bodies_and_empty_table(spark):
    assert flat(spark, None, "", "null", "{", '{"fields": {"a"', "7", "{}", '{"fields": null}', "[[[") == []
    assert nested.flatten_records(spark.createDataFrame([], "record_id bigint, body string")).count() == 0


def test_parents_contain_their_children(spark):
    body = {"per_fund": {"F": {"error_breakdown": {"missed": 3}}, "G": {"x": [[1]], "error_breakdown": {"missed": 1}}}, "fields": {"share_classes.share_classes": [CLASS]}}
    rows = rows_of(spark, [json.dumps(body)])
    at = {r["pre"]: r for r in rows}
    assert len(at) == len(rows) and sorted(r["post"] for r in rows) == sorted({r["post"] for r in rows})
    for r in rows:
        for other in rows:
            below = other["pre"] < r["pre"] and r["post"] < other["post"]
            assert not (other["pre"] == r["parent_pre"]) or below
        assert r["child_table"] == "bodies" or at[r["parent_pre"]]["child_table"] == r["parent_table"]
    assert {at[r["parent_pre"]]["child_key"] for r in rows if r["child_table"] == "error_breakdown"} == {"F", "G"}


def test_typed_child_table_and_deep_nesting(spark):
    deep = "[" * 400 + "1" + "]" * 400
    body = '{"per_fund": {"F": {"accuracy": 0.25, "total_fields": "x", "deep": ' + deep + "}}}"
    out = nested.child_table(nested.flatten_records(spark.createDataFrame([(1, body)], "record_id bigint, body string")), "per_fund", accuracy="double", total_fields="int").collect()
    assert [(r["child_key"], r["accuracy"], r["total_fields"]) for r in out] == [("F", 0.25, None)]
