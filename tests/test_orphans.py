"""Orphans: against a plain loop, with ties, hot keys, nulls."""

import random
from datetime import datetime, timedelta

from ledgerloom.operators import orphans

T0 = datetime(2024, 1, 1)
FUNDS = "cik string, created_at timestamp_ntz, deleted_at timestamp_ntz, note string"
SUBS = "row_id bigint, accession_number string, cik string, quarter string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
REFS = "row_id bigint, accession_number string, quarter string, loaded_at timestamp_ntz, cik string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, funds, subs, periods=(), returns=(), **kw):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = orphans.filing_orphans(make(funds, FUNDS), make(subs, SUBS), make(periods, REFS), make(returns, REFS), **kw)
    return sorted(tuple(r) for r in out.collect())


def test_kinds_spellings_and_ties(spark):
    funds = [("0000000007", day(5), day(10), "x"), ("CIK0000000008", day(5), None, None), (None, day(1), None, None)]
    subs = [
        (1, "0000000001-24-000001", "7", "2024q1", day(5), None),  # available from its own moment on
        (2, "0000000001-24-000002", " 0000000007 ", "Q2 2024", day(10), None),  # taken out at that moment
        (3, "0000000001-24-000003", "7.0", None, day(4), None),  # came in later
        (4, "0000000001-24-000004", "9", "2024-Q3", day(6), None),  # never there
        (5, "0000000001-24-000005", "N/A", "x", day(6), None),
        (6, "0000000001-24-000006", "8", "2024Q4", day(6), None),
    ]
    refs = [(1, "100000124000001", "2024q1", day(6), None), (2, "1-2", "2024q1", day(6), None), (3, None, None, day(6), None), (4, "0000000001-24-000001.txt", "2024q1", day(1), None)]
    got = run(spark, funds, subs, refs)
    assert ("submissions", 2, "2024q2", "deleted") in got and ("submissions", 3, "unknown", "late") in got and ("submissions", 4, "2024q3", "missing") in got
    assert [r for r in got if r[0] == "submissions"] == sorted([("submissions", 2, "2024q2", "deleted"), ("submissions", 3, "unknown", "late"), ("submissions", 4, "2024q3", "missing")])
    assert [(r[1], r[3]) for r in got if r[0] == "fund_periods"] == [(1, "missing"), (2, "missing"), (4, "late")]


def test_against_a_loop_with_hot_keys(spark):
    rng = random.Random(5)
    funds = [(str(rng.randint(1, 6)), day(rng.randint(0, 30)), day(rng.choice([None, None, rng.randint(0, 40)])), None) for _ in range(20)]
    subs = [(i, f"{i:010d}-24-000001", str(rng.choice([1, 1, 1, 1, 2, 3, 4, 5, 6, 7])), "2024q1", day(rng.randint(0, 40)), None) for i in range(400)]
    want = []
    for row_id, _, cik, _, at, _ in subs:
        rows = [f for f in funds if f[0] == cik]
        if not any(s <= at and (e is None or at < e) for _, s, e, _ in rows):
            want.append(("submissions", row_id, "2024q1", "missing" if not rows else "late" if any(f[1] > at for f in rows) else "deleted"))
    assert run(spark, funds, subs) == sorted(want)
    assert run(spark, funds, subs, line_rows=10) == sorted(want)


def test_null_times_repeats_and_empty(spark):
    funds = [("7", None, None, None), ("8", day(3), day(3), None)]
    subs = [(1, "1", "7", None, None, None), (1, "1", "7", None, None, None), (2, "2", "8", None, day(5), None), (2, "2", "8", None, day(5), None)]
    assert run(spark, funds, subs) == [("submissions", 2, "unknown", "deleted")] * 2
    assert run(spark, [], []) == []


def test_report(spark, data):
    from ledgerloom.plans.data_queries import p4_found, p4_report

    assert sum(r["n"] for r in p4_report(spark, data).collect()) == p4_found(spark, data).count()
