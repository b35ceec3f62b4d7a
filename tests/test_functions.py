"""Scalar functions on single values."""

from pyspark.sql import functions as F

from ledgerloom.functions import normalise as N
from ledgerloom.functions import synonyms as Y
from ledgerloom.functions import text as T
from ledgerloom.operators import grounding as G
from ledgerloom.operators import retrieval as R
from ledgerloom.operators import sections as S


def values(spark, column, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_numbers(spark):
    cases = {"$2.5 million": 2.5e6, "1,000": 1000.0, "5%": 5.0, "10-15%": 10.0, "twenty-five": 25.0, "one hundred four": 104.0, "N/A": None, "about 7 days": 7.0, "none": None, "-0.5": -0.5, "3k": 3000.0, ".25": 0.25, "abc": None, None: None}
    assert values(spark, N.numeric_text(F.col("a")), list(cases)) == list(cases.values())


def test_numbers_in_words(spark):
    cases = {"one": 1.0, " Twenty five": 25.0, "two million": 2e6, "five hundred": 500.0, "one hundred twenty": 120.0, "first": 1.0, "half": 0.5, "a year": 1.0, "three years": 3.0, "four years": None, "one month": None, "two classes": None, "ten five": None, "twenty-one hundred": None, "": None, None: None}
    assert values(spark, N.word_number(F.col("a")), list(cases)) == list(cases.values())
    assert values(spark, T.words_to_number(F.col("a")), ["two million three hundred thousand and five", "one billion", "x"]) == [2_300_005, 10**9, None]
    more = {"one month": None, "US$ 5": 5.0, "100 dollars": 100.0, "2M": 2e6, "$1.5 Million": 1.5e6, "5 to 25": 5.0, "5 – 25%": 5.0, "(5)": 5.0, "5 b": 5e9, "1.5e3": 1500.0, "90d": 90.0, "between 3 and 4": 3.0, "first": 1.0, ",": None}
    assert values(spark, N.numeric_text(F.col("a")), list(more)) == list(more.values())


def test_synonyms(spark):
    rows = {"Semi-Annual": ("semi_annually", "annual"), "twice per year": ("semi_annually", "annual"), "paid ANNUALLY": ("annually", "annual"), "each_quarter": ("quarterly", "quarterly"), "daily": ("daily", "daily"), "odd": ("odd", "odd")}
    assert values(spark, N.mapped(F.col("a"), Y.DISTRIBUTION_FREQUENCY), list(rows)) == [a for a, _ in rows.values()]
    assert values(spark, N.mapped(F.col("a"), Y.HURDLE_FREQUENCY), list(rows)) == [b for _, b in rows.values()]
    settings = spark.createDataFrame([(0,), (500,), (501,), (1001,), (2001,)], "n int").select(R.adaptive_settings(F.col("n")).alias("s")).collect()
    assert [tuple(r["s"]) for r in settings] == [(5, 10, 50, 10), (5, 10, 50, 10), (10, 10, 200, 15), (15, 12, 300, 20), (20, 15, 400, 25)]


def test_keys(spark):
    assert values(spark, T.cik_key(F.col("a")), ["7", "CIK0000000007", " 7.0 ", "n/a", None, "x", "0"]) == ["0000000007"] * 3 + [None, None, "X", "0" * 10]
    assert values(spark, T.accession_key(F.col("a")), ["0009000011-24-000057", "9000011240 00057", "900001124000057.txt", "NA"]) == ["000900001124000057"] * 3 + [None]
    assert values(spark, T.quarter_label(F.col("a")), ["2024q1", "Q2 2024", "2024-Q3", "2024", None]) == ["2024q1", "2024q2", "2024q3", None, None]


def test_matching(spark):
    m = N.values_match(F.col("a"), F.col("b"))
    rows = {("5%", "5.005"): True, ("5", "5.2"): False, (None, "false"): True, ("False", None): True, (None, "x"): False, ("Net Assets", "nav"): True, ("no", None): False, ("N/A", ""): True, ("a", "b"): False, ("one year", "one month"): False, ("two classes", "two funds"): False, ("one year", "1"): True, ("x", "5"): False, ("5", "x"): False, ("reinvested", "DRIP"): True, ("300%", "asset coverage"): True, ("$2,500", "2500"): True}
    assert values(spark, m, list(rows), "a string, b string") == list(rows.values())
    lists = spark.createDataFrame([(["A", "b"], ["B", "a"], "exact"), (["a"], ["a", "b"], "subset"), (["a"], ["a", "b"], "superset"), (["a", "b", "c"], ["a"], "superset"), (["a", "a"], ["a"], "exact")], "a array<string>, b array<string>, m string")
    assert [r[0] for r in lists.select(N.lists_match(F.col("a"), F.col("b"), F.col("m"))).collect()] == [True, True, False, True, False]


def test_labels_and_paths(spark):
    assert values(spark, N.class_label(F.col("a")), ["i shares", "Class S Shares", "d"]) == ["Class I", "Class S", "Class D"]
    assert values(spark, N.class_key(F.col("a")), [" Class I Shares", "I"]) == ["class i", "i"]
    globs = {"has_*": [True, False, None], "*_POLICY": [False, True, None], "*policy*": [True, True, None], "policy": [True, True, None], "x.*y": [False, False, None]}
    for pattern, want in globs.items():
        assert values(spark, N.glob(F.col("a"), pattern), ["Has_policy_x", "default_policy", None]) == want
    assert values(spark, S.camel_words(F.col("a")), ["FeeTableTextBlock"]) == ["Fee Table Text Block"]
    assert values(spark, S.titles_similar(F.col("a"), F.lit("Risk Factors")), ["RISK-FACTORS (cont.)", "123", None]) == [True, False, False]
    assert values(spark, S.content_type(F.col("a")), ["a | b | c", "- x", "plain", "<table><ul>"]) == ["table", "list", "text", "mixed"]


def test_focus_and_grounding(spark):
    assert values(spark, N.focus(F.col("a"), F.lit("25"), 3, 4), ["abcdef 25 ghijkl", "nothing"]) == ["ef 25 gh", "noth"]
    assert values(spark, G.number_in_text(F.lit(5.0), F.col("a")), ["is 5%", "15%", "5.5%", "5.00", "1,5", "2, 5.", None]) == [True, False, False, True, False, True, False]
    found = lambda f, q, rows: [r["found"] for r in f(spark.createDataFrame([(q, t) for t in rows], "q string, t string"), "q", "t").collect()]
    assert found(G.partial_quotes, "one two three four five six", ["x TWO  three four\nfive six y", "one two three four"]) == [True, False]
    assert found(G.partial_quotes, "Two words", ["has two words", "two other words", None]) == [True, False, False]
    assert values(spark, G.quote_in_text(F.lit("Class A"), F.col("a")), ["of CLASS A shares", "class b"]) == [True, False]
    assert found(G.fuzzy_terms, "private market secondaries", ["secondaries in a private fund", "market", None]) == [True, False, False]
