"""Files in and out: quarters, index lines, configurations, tagged documents, predictors."""

import json
import zipfile
from datetime import date

from ledgerloom.functions import predictor
from ledgerloom.sources import documents, ixbrl, quarters


def test_quarters(spark):
    got = [r[0] for r in quarters.available_quarters(spark, date(2020, 7, 1)).collect()]
    assert got == ["2019q4", "2020q1", "2020q2"]


def test_tsv_store_and_overwrite(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("2024/SUBMISSION.tsv", "ACCESSION_NUMBER\tCIK\n1\tNA\n2\t\n3\t0007\n")
    path = quarters.unpack_member(str(tmp_path / "q.zip"), "submission", str(tmp_path))
    df = quarters.read_tsv(spark, path, ["ACCESSION_NUMBER", "CIK"])
    assert [tuple(r) for r in df.collect()] == [("1", None), ("2", None), ("3", "0007")]
    assert quarters.unpack_member(str(tmp_path / "q.zip"), "holding", str(tmp_path)) is None
    base = str(tmp_path / "store")
    for q, rows in (("2024q1", [(1,)]), ("2024q2", [(2,)]), ("2024q1", [(3,), (4,)])):
        quarters.overwrite_quarters(spark.createDataFrame([(q, *r) for r in rows], "quarter string, n int"), base, "t")
    assert sorted(r["n"] for r in quarters.read_store(spark, base, "t").collect()) == [2, 3, 4]
    assert quarters.read_store(spark, base, "t", ["2024q2"]).count() == 1 and quarters.stored(base, "t", "2024q1") and not quarters.stored(base, "t", "2020q1")


def test_index_lines(spark):
    text = ["Company Name  Form", "Some Fund, LLC   N-2/A   7000017  2024-02-06  edgar/data/7000017/0009000011-24-000057.txt", "Some Fund, LLC   N-2   7000017  2024-02-06  edgar/data/7000017/0009000011-24-000057.txt", "Old   N-2  1  2001-01-01  edgar/1/0009000011-01-000001.txt", "Other  10-K  5  2024-02-06  edgar/5/0009000011-24-000058.txt"]
    from pyspark.sql import functions as F

    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, value string")
    rows = quarters.index_lines(lines, F.lit("2020-01-01").cast("date")).collect()
    assert [(r["cik"], r["form_type"], r["company"]) for r in rows] == [("0007000017", "N-2/A", "Some Fund, LLC")]


def test_configurations(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": {"x": 1, "y": 2}, "metadata": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"a": {"y": 3}, "metadata": 2}))
    merged = documents.load_config(str(tmp_path / "b.json"), str(tmp_path / "a.json"))
    assert merged["a"] == {"x": 1, "y": 3}
    assert documents.config_hash({"b": 1, "a": 2, "metadata": 5}) == documents.config_hash({"a": 2, "b": 1})


def test_files(spark, tmp_path):
    (tmp_path / "f1").mkdir()
    (tmp_path / "f1/primary.html").write_text("<p>one</p>\n<p>two</p>")
    (tmp_path / "f1/metadata.json").write_text('{"cik": "7",\n "form_type": "N-2"}')
    row = documents.read_filings(spark, str(tmp_path)).first()
    assert row["html"] == "<p>one</p>\n<p>two</p>" and row["cik"] == "7"
    (tmp_path / "ids.json").write_text('["1", "2", "1"]')
    assert documents.id_lists(spark, str(tmp_path / "ids.json")).count() == 2
    errors = spark.createDataFrame([("a", True), ("b", False)], "field string, correct boolean")
    documents.write_errors(errors, str(tmp_path / "errors"))
    assert spark.read.csv(str(tmp_path / "errors"), header=True).first()["field"] == "b"
    documents.write_json(errors, str(tmp_path / "runs"), "correct")
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


HTML = """<html><head><script>var x = '<ix:nonFraction>';</script></head><body><h1>Fees</h1>
<xbrli:context id="c_ClassISharesMember"><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrldi:explicitMember>f:LiquidityRiskMember</xbrldi:explicitMember><xbrli:instant>2024-06-30</xbrli:instant></xbrli:context>
<ix:nonFraction name="f:ManagementFeesPercent" contextRef="c_ClassISharesMember" scale="-2" id="a">1.25</ix:nonFraction>
<ix:nonFraction name="f:ManagementFeesPercent" contextRef="c2" scale="-2" id="b">2</ix:nonFraction>
<ix:nonFraction name="f:OtherFees" contextRef="c2" id="">1,<b>234</b></ix:nonFraction><ix:nonFraction name="f:OtherFees" contextRef="c2" id="">-</ix:nonFraction>
<ix:nonFraction name="f:Days" contextRef="c2" format="ixt:numwordsen" id="d">twenty-one</ix:nonFraction><ix:nonFraction name="f:Bad" contextRef="c2" id="e">about 5</ix:nonFraction>
<ix:nonNumeric name="f:RiskTextBlock" id="t1" continuedAt="k">First<br/>part</ix:nonNumeric><ix:continuation id="k">and more</ix:continuation>
<ix:nonNumeric name="cef:IntervalFundFlag" id="f1">☒</ix:nonNumeric><p>open"""


def test_tagged_documents(spark):
    stream = ixbrl.events(spark.createDataFrame([("x", HTML), ("y", None), ("z", "<<<&")], "filing_id string, html string")).cache()
    facts = ixbrl.numeric_facts(stream).cache()
    got = sorted((r["name"], float(r["value"]), r["share_class"]) for r in facts.collect())
    assert got == [("f:Days", 21.0, None), ("f:ManagementFeesPercent", 0.0125, "Class I"), ("f:ManagementFeesPercent", 0.02, None), ("f:OtherFees", 0.0, None), ("f:OtherFees", 1234.0, None)]
    ctx = {r["context_ref"]: r for r in ixbrl.contexts(stream).collect()}
    assert ctx["c2"]["instant"] == "2024-06-30" and ctx["c_ClassISharesMember"]["period_end"] == "2024-12-31"
    assert [r["content"] for r in ixbrl.text_blocks(stream).collect()] == ["First part and more"]
    fees = ixbrl.fee_table(facts, {"f:ManagementFeesPercent": "management_fee"}, ("management_fee",))
    classes = spark.createDataFrame([("x", "Class I"), ("x", "Class S")], "filing_id string, share_class string")
    assert sorted((r["share_class"], float(r["value"])) for r in ixbrl.class_value(fees, classes).collect()) == [("Class I", 0.0125), ("Class S", 0.02)]
    assert ixbrl.fund_type(ixbrl.fund_type_flags(stream)).first()["fund_type"] == "interval_fund"
    cover = {r["tag"]: (r["is_mapped"], r["is_seen"]) for r in ixbrl.tag_coverage(facts, ["Days", "Never"]).collect()}
    assert cover["Days"] == (True, True) and cover["Never"] == (True, False) and cover["OtherFees"] == (False, True)


def test_fee_footnotes(spark):
    html = "<ix:footnote id='a'>12.5% of <b>Pre-Incentive Fee</b>\n Net Investment Income</ix:footnote><ix:footnote id='b'>Audited.</ix:footnote><ix:footnote id='c'> </ix:footnote><ix:nonNumeric name='f:T' id='t'>x</ix:nonNumeric>"
    rows = ixbrl.text_blocks(ixbrl.events(spark.createDataFrame([("x", html + HTML)], "filing_id string, html string"))).collect()
    assert sorted((r["id"], r["name"], r["content"]) for r in rows) == [("a", "ix:footnote:FeeStructure", "12.5% of Pre-Incentive Fee Net Investment Income"), ("t1", "f:RiskTextBlock", "First part and more")]


def test_predictors(spark):
    df = spark.createDataFrame([("management fee rate", "No. The management fee rate is 1%. Other.", 1), ("x", None, 2)], "q string, t string, n int")
    got = {r["n"]: r for r in predictor.predict(df, "q", "t").collect()}
    assert got[1]["answer"] == "The management fee rate is 1%." and got[2]["answer"] is None
    v = predictor.embed(df, "t").where("n = 1").first()["embedding"]
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def test_two_phase_and_blocks(spark):
    df = spark.createDataFrame([(1, "The lockup period applies. The lockup period is one year."), (2, "Nothing here."), (3, None)], "n int, t string")
    got = {r["n"]: r for r in predictor.two_phase(df, "lockup period", "lockup period year", "t").collect()}
    assert got[1]["found"] and got[1]["answer"] == "The lockup period is one year." and not got[2]["found"] and got[2]["answer"] is None and got[3]["answer"] is None
    text = "NAME: Class I\nLOAD: 1.5\n---\nname: Class S\r\nLOAD: none\n----\nLOAD: 3"
    rows = predictor.parse_blocks(spark.createDataFrame([(1, text), (2, None)], "n int, t string"), ["n"], "t", {"NAME": "string", "LOAD": "double"}, "NAME").collect()
    assert [(r["ord"], r["name"], r["load"]) for r in rows] == [(0, "Class I", 1.5), (1, "Class S", None)]


def test_bounded_rounds(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(i,) for i in range(6)], "n int")
    done = predictor.bounded_rounds(items, lambda df, k: df.withColumn("value", F.when(F.col("n") <= k, F.col("n").cast("string"))), "n", 4)
    assert sorted((r["n"], r["round"]) for r in done.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_main_document(spark):
    row = "<tr><td>1</td><td>x</td><td><a href='{}'>doc</a></td><td>{}</td></tr>"
    pages = [
        (1, "<table>" + row.format("/a/ex-99.htm", "EX-99") + row.format("/ix?doc=/a/main.htm", "N-2/A") + "</table>"),
        (2, "<a href='/x-index.htm'>i</a><a href='/exhibit.htm'>e</a><a href='b.pdf'>p</a><a class='y' href=\"/b/doc.html\">d</a>"),
        (3, None),
        (4, "nothing"),
    ]
    got = {r["n"]: r["href"] for r in documents.main_document(spark.createDataFrame(pages, "n int, html string"), "n").collect()}
    assert got == {1: "/a/main.htm", 2: "/b/doc.html", 3: None, 4: None}
