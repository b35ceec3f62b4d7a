"""Sequential chunks and summary trees."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import chunker


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\t!漢", max_size=400), st.integers(1, 12), st.integers(0, 8))
def test_spans_cover_the_text(text, size, overlap):
    spans = list(chunker.chunk_spans(text, size, overlap))
    covered = set()
    for s, e in spans:
        assert 0 <= s < e <= len(text) and e - s <= 4 * size
        assert text[s:e] == text[s:e].strip()
        covered.update(range(s, e))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert spans == sorted(spans)


def test_strongest_boundary_and_overlap():
    text = "First part. Still first.\n\nSecond part is here and goes on for some time."
    spans = list(chunker.chunk_spans(text, 10, 2))
    assert text[slice(*spans[0])] == "First part. Still first." and spans[1][0] < spans[0][1]


def test_table(spark):
    df = spark.createDataFrame([(1, "word " * 900, "x"), (2, None, "x"), (3, "", "x"), (4, "  \n ", "x")], "doc_id bigint, text string, chunk_index string")
    rows = chunker.chunk_texts(df, "doc_id", "text", 100, 20).collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(len(r["content"]) == r["char_end"] - r["char_start"] for r in rows)
    assert chunker.chunk_texts(df.limit(0), "doc_id", "text").count() == 0


def test_summary_tree(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fee", "fund", "risk", "share", "loan"]) for _ in range(20))) for i in range(40)]
    tree = chunker.summary_tree(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    ids = {r["node_id"] for r in tree}
    assert sum(r["level"] == 0 for r in tree) == 40 and len(ids) == len(tree)
    assert all(r["parent_id"] in ids for r in tree if r["parent_id"] is not None)
    assert all(r["parent_id"] is not None for r in tree if r["level"] == 0)


def test_summary_tree_per_document(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = [(d, i, " ".join(rng.choices(words, k=30))) for d, n in (("a", 600), ("b", 20), ("c", 1), (None, 9)) for i in range(n)]
    tree = chunker.summary_tree(spark.createDataFrame(rows, "doc string, id bigint, text string"), "id", "text", document="doc").collect()
    at = lambda d, level: [r for r in tree if r["document"] == d and r["level"] == level]
    assert [len(at("a", n)) for n in (0, 1, 2, 3)] == [600, 75, 9, 1] and [len(at("b", n)) for n in (0, 1, 2, 3)] == [20, 2, 1, 0]
    assert [len(at("c", n)) for n in (0, 1)] == [1, 0] and [len(at(None, n)) for n in (0, 1, 2)] == [9, 1, 0]
    ids = {(r["document"], r["node_id"]): r["level"] for r in tree}
    assert len(ids) == len(tree) and all(ids[r["document"], r["parent_id"]] == r["level"] + 1 for r in tree if r["parent_id"] is not None)
    # By the definition, one by one: the nearest of the document's first 75 in order of their numbers, and the first five texts whole.
    import numpy as np

    from ledgerloom.functions.predictor import hashed_embedding

    texts = [t for d, _, t in rows if d == "a"]
    m = np.array([hashed_embedding(t) for t in texts], dtype=np.float32).astype(float)
    near = [int(np.round(((m[:75] - v) ** 2).sum(1), 6).argmin()) for v in m]
    assert {r["node_id"]: r["parent_id"] for r in at("a", 0)} == {str(i): f"a/L1-{c}" for i, c in enumerate(near)}
    assert {r["node_id"]: r["text"] for r in at("a", 1)} == {f"a/L1-{c}": " … ".join([texts[i] for i in range(600) if near[i] == c][:5]) for c in set(near)}


def test_html_keeps_tables_and_lists(spark):
    html = "<h1>Fees</h1><p>Some text.</p><table><tr><td>Class I</td><td>1%</td></tr><tr><td><ul><li>x</li></ul></td></tr></table><script>no</script>more<ul><li>a<li>b</ul>" + "<table>" + "<tr><td>row of cells</td></tr>" * 50 + "</table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>open")], "doc_id bigint, html string")
    rows = [r for r in chunker.chunk_html(df, "doc_id", "html", 50, 5).collect()]
    first = [(r["kind"], r["content"]) for r in rows if r["doc_id"] == 1]
    assert first[0] == ("text", "Fees\n\nSome text.") and first[1][0] == "table" and "Class I 1%" in first[1][1] and first[2] == ("text", "more") and first[3] == ("list", "a\nb")
    assert all(len(r["content"]) <= 200 for r in rows) and {r["doc_id"] for r in rows} == {1, 3}


def test_section_and_document_summaries(spark):
    class Whole:
        def answer(self, question, text):
            return (f"{question}|{len(text)}|{text[:7]}", 1.0) if question != "none" else (None, 0.0)

    rows = [("a", "s2", "Fees", i, f"{i:02d}" + "x" * 500) for i in range(12)] + [("a", "s1", "Long", 1, "y" * 7990), ("a", "s1", "Long", 2, "z" * 50), ("a", "s1", "Long", 3, "never"), ("a", "s3", "none", 0, "q"), ("b", "s1", "Null", 0, None)]
    chunks = spark.createDataFrame(rows, "doc string, sec string, title string, i int, t string")
    got = {(r["doc"], r["sec"]): r["summary"] for r in chunker.section_summaries(chunks, "doc", "sec", "title", "i", "t", Whole()).collect()}
    assert got == {("a", "s2"): "Fees|5040|00xxxxx", ("a", "s1"): "Long|6000|yyyyyyy", ("b", "s1"): "Null|2|\n\n"}
    short = spark.createDataFrame([("a", "s2", "B", 0, "Two. More."), ("a", "s1", "A", 1, "One.\n\nAlso. No."), ("c", "s1", "C", 0, " ")], "doc string, sec string, title string, i int, t string")
    sections = chunker.section_summaries(short, "doc", "sec", "title", "i", "t")
    assert {r["sec"]: r["summary"] for r in sections.collect()} == {"s1": "One. Also.", "s2": "Two."}
    assert [tuple(r) for r in chunker.document_summaries(sections, "doc", "sec", "title").collect()] == [("a", "**B**: Two. **A**: One.")]
