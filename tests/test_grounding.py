"""Verdicts by similarity, entailment and a judge, and reranking."""

from pyspark.sql import functions as F

from ledgerloom.operators import grounding, retrieval


def test_sentence_similarity(spark):
    axes = lambda t: [float("fee" in t), float("risk" in t)]
    rows = [(1, "fee", "Too short fee. A long sentence about risk! A long sentence about a fee?", None), (2, "fee", "risk", ["Both of fee and risk are in here", None]), (3, "fee", None, ["short"]), (4, "else", "A long sentence about a fee", [])]
    df = spark.createDataFrame(rows, "n int, claim string, evidence string, more array<string>")
    got = {r["n"]: (round(r["similarity"], 6), r["best_sentence"], r["grounded"]) for r in grounding.sentence_similarity(df, "claim", "evidence", "more", embedder=axes).collect()}
    assert got == {1: (1.0, "A long sentence about a fee", True), 2: (0.707107, "Both of fee and risk are in here", False), 3: (0.0, None, False), 4: (0.0, "A long sentence about a fee", False)}


def test_cascade_asks_only_what_is_open(spark):
    class Given:
        def scores(self, claim, evidence):
            return tuple(map(float, evidence.split()))

    class Judge:
        def answer(self, question, text):
            assert text in ("0.8 0.1", "0.3 0.2")  # only what is open is sent
            return ("yes", 0.9) if text == "0.8 0.1" else (None, 0.2)

    df = spark.createDataFrame([("c", e) for e in ("0.9 0.05", "0.9 0.8", "0.2 0.7", "0.8 0.1", "0.3 0.2")], "claim string, evidence string")
    plain = {r["evidence"]: (r["grounded"], round(r["confidence"], 6)) for r in grounding.entailed(df, "claim", "evidence", Given()).collect()}
    assert plain == {"0.9 0.05": (True, 0.855), "0.9 0.8": (False, 0.18), "0.2 0.7": (False, 0.06), "0.8 0.1": (True, 0.72), "0.3 0.2": (False, 0.24)}
    got = {r["evidence"]: (r["strategy"], r["grounded"], round(r["confidence"], 6)) for r in grounding.cascade(df, "claim", "evidence", Given(), Judge()).collect()}
    assert got == {"0.9 0.05": ("hybrid_nli_fast", True, 0.855), "0.9 0.8": ("hybrid_nli_fast", False, 0.18), "0.2 0.7": ("hybrid_nli_reject", False, 0.1), "0.8 0.1": ("hybrid_llm_fallback", True, 0.9), "0.3 0.2": ("hybrid_llm_fallback", False, 0.2)}
    alone = {r["evidence"]: r["strategy"] for r in grounding.cascade(df, "claim", "evidence", Given(), ask=False).collect()}
    assert alone["0.3 0.2"] == "hybrid_nli_only" and alone["0.2 0.7"] == "hybrid_nli_reject"


def test_rerank(spark):
    rows = [(g, i, g, f"t{i}") for g in ("good", "bad") for i in range(8)]
    df = spark.createDataFrame(rows, "g string, i bigint, q string, t string")

    def scorer(query, texts):
        if query == "bad":
            raise OSError("no service")
        assert len(texts) == 6
        return [{"t1": 0.9, "t3": 0.9, "t5": 0.2, "t4": 0.4}.get(t, 0.1) for t in texts]

    got = retrieval.rerank(df, ["g"], [F.col("i")], "q", "t", scorer, first_pass=6, k=4).collect()
    assert sorted((r["i"], r["original_index"], r["relevance"]) for r in got if r["g"] == "good") == [(1, 1, 0.9), (3, 3, 0.9), (4, 4, 0.4)]
    assert sorted((r["i"], r["relevance"]) for r in got if r["g"] == "bad") == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    assert retrieval.rerank(df, ["g"], [F.col("i")], "q", "t", None).count() == 16
