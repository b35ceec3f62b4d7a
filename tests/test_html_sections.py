"""HTML headings and sections, standard sections, share class names."""

from pyspark.sql import functions as F

from ledgerloom.operators import sections as S
from ledgerloom.sources import html_sections as H
from ledgerloom.sources import ixbrl


def only(html):
    tree = H.Tree(html)
    return tree, next(x for x in tree.root.below() if x.attrs.get("id") == "x")


def test_styles_and_levels():
    cases = {
        "<p id=x style='font-weight:bold;font-size:10pt'>Fees</p>": (True, 4), "<p id=x style='font-weight: 700; font-size: 16pt'>Fees</p>": (True, 1), "<p id=x style='font-weight:bold'>Fees</p>": (False, 3),
        "<p id=x style='font-weight:bold;font-size:9pt'>Fees</p>": (False, 4), "<div id=x>RISK FACTORS</div>": (True, 2), "<div id=x>RISKS</div>": (False, 2), "<td id=x><span><b>Fees</b></span></td>": (True, 3),
        "<p id=x>" + "w " * 80 + "<b>x</b></p>": (False, 3), "<p id=x style='font-size:12.5pt'><strong>A b</strong></p>": (True, 3), "<p id=x style='font-size:14pt'>a</p>": (False, 2),
    }
    for html, want in cases.items():
        tree, x = only(html)
        assert (H.styled_heading(tree, x), H.heading_level(tree, x)) == want, html


def test_contents_and_cover():
    row = "<tr><td id={}><b>Fees</b></td><td>{}</td></tr>"
    table = lambda n, page: "<table><tbody>" + "".join(row.format("x" if i == 1 else i, page) for i in range(n)) + "</tbody></table>"
    assert H.contents_entry(*only(table(5, "12"))) and not H.contents_entry(*only(table(4, "12"))) and not H.contents_entry(*only(table(6, "12%")))
    assert H.contents_entry(*only("<table><tr><td>Table of Contents</td></tr>" + "<tr><td id=x>a</td></tr>" * 4 + "</table>"))
    assert H.contents_entry(*only("<table>" + "<tr><td id=x><a href='#a'>a</a></td></tr>" * 11 + "</table>")) and not H.contents_entry(*only("<p id=x>a</p>"))
    cover = lambda html: H.cover_line(only(html)[1], H.Tree(html).joined(only(html)[1]))
    assert cover("<body><div><p id=x>Form N-2</p></div></body>") and cover("<body><p id=x>SOME FUND</p></body>") and not cover("<body><div><p id=x>SOME FUND</p></div></body>")


def test_sections_end_with_their_parent_or_the_next_heading():
    long = "words " * 30
    html = f"<body><div><h1>One</h1>{long}<p>tail</div><div><h2>Two</h2><p>{long}<h2>Three</h2>short</div><p>outside"
    got = [(t, tag, level, c) for _, t, tag, level, _, c, _ in H.sections_of(html)]
    assert got == [("One", "h1", 1, f"One {long}tail"), ("Two", "h2", 2, f"Two {long.strip()}")]
    assert H.sections_of(None) == H.sections_of("") == [] and H.sections_of("<<p>&lt;") == []
    q = f"<table><tr><td>Q: Who may invest?</td></tr></table><ul><li>{long}</ul><p>{long}</p>"
    assert [(t, level, kind) for _, t, _, level, _, _, kind in H.sections_of(q)] == [("Q: Who may invest?", 4, "mixed")]


def test_a_heading_in_a_table_does_not_take_what_follows_a_later_one():
    row = lambda t: f"<tr><td><b>{t}</b></td><td>x</td></tr>"
    html = "<div><table>" + row("First") + row("Last") + "</table><p>" + "words " * 40 + "</div>"
    assert [t for _, t, *_ in H.sections_of(html)] == ["Last"]


def test_offsets_are_those_of_the_text(spark):
    html = "<html><script>no</script><body><div><h1>A &amp; B</h1>" + "text " * 40 + "</div></body></html>"
    df = spark.createDataFrame([("f", html, 1), ("g", None, 2)], "filing_id string, html string, x int")
    text = {r["filing_id"]: r["text"] for r in H.plain_text(df).collect()}
    rows = H.heading_sections(df).collect()
    assert [(r["filing_id"], text["f"][r["char_start"] :][:5]) for r in rows] == [("f", "A & B")] and text["g"] is None
    assert H.heading_sections(df.limit(0)).count() == 0


def test_standard_sections(spark):
    toc = "TABLE OF CONTENTS\n" + "".join(f"{t} {'.' * 60} 1\n" for t in ("THE   FUND", "RISK FACTORS", "CUSTODIAN"))
    text = toc + "The\n Fund is new. " + "It invests. " * 20 + "Risk Factors: " + "many. " * 30 + "CUSTODIAN x"
    spans = {n: (t, text[s:e]) for n, t, s, e in S.standard_spans(text)}
    assert spans["the_fund"][0] == "The Fund" and spans["the_fund"][1].startswith("The\n Fund") and spans["the_fund"][1].endswith("It invests. ")
    assert spans["risk_factors"][1].startswith("Risk Factors: many") and "custodian" not in spans
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in S.standard_sections(df).collect()} == {1}
    fields = spark.createDataFrame([("Fees and Expenses", None), ("odd", "cef:RiskTextBlock"), (None, None)], "t string, g string").select(S.target_fields(F.col("t"), F.col("g")).alias("f"), S.section_name(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in fields] == ["summary_of_fund_expenses", None, None] and fields[1]["f"] == ["key_risks"] and fields[2]["f"] == [] and "incentive_fee" in fields[0]["f"]


def test_share_class_names(spark):
    names = {"f_ClassISharesMember": "Class I", "ClassDAdvisorySharesMember": "Class D Advisory", "ClassSInstitutionalMember": "Class S Institutional", "x_Class_T_y": "Class T", "a_ClassU": "Class U", "f:InstitutionalSharesMember": "Institutional", "f:PremierSharesMember": "Premier", "PreferredShareMember": "Preferred", "ClassISharesRepurchasedMember": None, "LiquidityRiskClassIMember": None, "ClassZ": None, None: None}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "a string").select(ixbrl.share_class(F.col("a"))).collect()] == list(names.values())
