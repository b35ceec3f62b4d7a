"""Shared spans against plain search."""

import random
from collections import defaultdict

from ledgerloom.llm import spans


def brute(docs, least):
    at = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - least + 1):
            at[t[p : p + least]].add((i, p))
    pairs, marks = set(), defaultdict(set)
    for places in at.values():
        ids = {i for i, _ in places}
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for i, p in places:
                marks[i].update(range(p, p + least))
    return pairs, {i: len(m) for i, m in marks.items()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh é漢😀\n") for _ in range(k))
    shared = [word(k) for k in (199, 200, 201, 240, 299, 300, 350, 500, 1200)]
    docs = []
    for i in range(n):
        t = word(rng.randint(0, 700))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 40) if rng.random() < 0.3 else 0
            t += s[a : len(s) - (rng.randint(0, 40) if rng.random() < 0.3 else 0)] + word(rng.randint(0, 300))
        docs.append((i, t))
    run = "-" * 450
    return docs + [(n, None), (n + 1, ""), (n + 2, run), (n + 3, "x" + run[:320] + "y"), (n + 4, docs[3][1] + "tail"), (n + 5, shared[8]), (n + 6, shared[8])]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, 1) for i, t in docs], "doc_id bigint, text string, hash string, pos int")


def test_pairs_and_amounts(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        pairs, amounts = brute(docs, 200)
        df = frame(spark, docs)
        assert {tuple(r) for r in spans.sharing_pairs(df).collect()} == pairs
        got = {r["doc_id"]: r for r in spans.shared_amounts(df).collect()}
        assert {i: r["shared_chars"] for i, r in got.items() if r["shared_chars"]} == amounts
        assert set(got) == {i for i, _ in docs} and got[60]["n_chars"] is None and got[61]["shared_ratio"] == 0.0


def test_other_lengths(spark):
    docs = corpus(4, 40)
    for least in (30, 61, 260, 401):
        pairs, amounts = brute(docs, least)
        df = frame(spark, docs)
        assert {tuple(r) for r in spans.sharing_pairs(df, least).collect()} == pairs
        assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_amounts(df, least).collect() if r["shared_chars"]} == amounts


def periodic(seed):
    """Texts full of runs: periods 1, 2, 7, 40, 60 and 150 in several lengths and phases, cut and mixed with other text."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh \n") for _ in range(k))
    units = [".", ". ", "-=-=+- ", word(40), word(60), word(150), " "]
    docs = []
    for i in range(45):
        t = word(rng.randint(0, 150))
        for _ in range(rng.randint(1, 3)):
            u = rng.choice(units)
            n, at = rng.choice((99, 100, 101, 150, 198, 199, 200, 201, 205, 240, 300, 500)), rng.randrange(len(u))
            t += (u * (n // len(u) + 2))[at : at + n] + word(rng.choice((0, 1, 20, 120)))
        docs.append((i, t))
    return docs


def test_runs(spark):
    for seed in (1, 2, 3):
        docs = periodic(seed)
        for least in (200, 60, 330):
            pairs, amounts = brute(docs, least)
            df = frame(spark, docs)
            assert {tuple(r) for r in spans.sharing_pairs(df, least).collect()} == pairs
            assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_amounts(df, least).collect() if r["shared_chars"]} == amounts


def test_long_runs_cost_no_squares(spark):
    import time

    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abcdef") for _ in range(300)) + (" " * 32_000 if i % 2 else ". " * 16_000) + f"end {i}") for i in range(8)]
    start = time.time()
    rows = spans.shared_spans(frame(spark, docs)).collect()
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in rows} == {(a, b) for a in range(8) for b in range(8) if a < b and (b - a) % 2 == 0}
    assert max(r["length"] for r in rows) >= 32_000 and len(rows) < 200 and time.time() - start < 60


def test_links_by_class(spark):
    docs = corpus(1)
    pairs, _ = brute(docs, 200)
    texts = defaultdict(list)
    for i, t in docs:
        texts[t].append(i)
    cls = {i: (min(texts[t]) if t is not None else i) for i, t in docs}
    want = {i: len({cls[x] for p in pairs for x in p if i in p} - {cls[i]}) for i, _ in docs}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spans.text_links(frame(spark, docs)).collect()}
    assert got == {i: (cls[i], want[i]) for i, _ in docs}


def test_repeats_are_maximal(spark):
    docs = dict(corpus(3, 30))
    rows = spans.shared_spans(frame(spark, docs.items())).collect()
    assert rows
    for a, b, s, t, n in rows:
        x, y = docs[a], docs[b]
        assert n >= 200 and x[s : s + n] == y[t : t + n]
        assert s == 0 or t == 0 or x[s - 1] != y[t - 1] or set(x[s : s + n]) == {"-"}
        assert s + n == len(x) or t + n == len(y) or x[s + n] != y[t + n]


def test_same_document_again_and_empty(spark):
    text = corpus(1)[-1][1]
    assert spans.sharing_pairs(frame(spark, [(1, text), (1, text)])).count() == 0
    assert spans.sharing_pairs(frame(spark, [(1, text)]).limit(0)).count() == 0
    assert spans.shared_amounts(frame(spark, []).limit(0)).count() == 0
