"""Splitting: offsets, limits, boundaries, overlap."""

import random
import re

import pytest

from ledgerloom.llm import split

SCHEMA = "chunk_id string, section_title string, content string, token_count int"
RUNS = {
    "paragraph": re.compile(r"[ \t\r\n]*(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*"),
    "line": re.compile(r"[ \t\r\n]*[\r\n][ \t\r\n]*"),
    "sentence": re.compile(r"[ \t\r\n]*[\r\n][ \t\r\n]*|(?<=[.!?])[ \t\r\n]+"),
    "word": re.compile(r"[ \t\r\n]+"),
}


def boundary(title, content, limit=2000):
    room = limit - (len(title) + 1 if title is not None else 0)
    marked = content.replace("\r\n", "")
    for kind, run in RUNS.items():
        run = re.compile(run.pattern.replace(r"[ \t\r\n]", "[ \t\r\n]").replace(r"[\r\n]", "[\r\n]").replace(r"(?:\r\n|\r|\n)", "(?:|\r|\n)"))
        if max(map(len, run.split(marked))) <= room:
            return kind
    return "none"


def texts():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgé漢😀") for _ in range(n))
    out = []
    for _ in range(60):
        seps = rng.choice([[" "], [" ", ". "], [" ", ". ", "\n"], [" ", ".\r\n", "\r\n\r\n"], [" ", "! ", "\n", "\n \n", "\t"]])
        t = ""
        while len(t) < rng.choice([100, 1990, 2500, 9000]):
            t += word(rng.choice([1, 3, 8, 30])) + rng.choice(seps) * rng.choice([1, 1, 1, 2])
        out.append((rng.choice([None, "", "Title", "T" * 90]), t))
    return out + [(None, "x" * 5000), ("t", "a" * 1990 + " " + "b" * 30), (None, " " * 3000), ("T" * 2500, "some words " * 300), (None, "\n" * 2001), ("😀" * 20, "😀漢" * 2000), (None, "a. " * 4000)]


def rows(spark, cases):
    df = spark.createDataFrame([(str(i), t, c, 0) for i, (t, c) in enumerate(cases)], SCHEMA)
    out = {}
    for r in split.split_chunks(df).collect():
        out.setdefault(int(r["chunk_id"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_index"]) for k, v in out.items()}, df


def test_pieces(spark):
    cases = texts()
    got, df = rows(spark, cases)
    found = {int(r["chunk_id"]): r["boundary"] for r in split.oversized(split.split_chunks(df)).collect()}
    for i, (title, content) in enumerate(cases):
        size = len(content) + (len(title) + 1 if title is not None else 0)
        pieces = got[i]
        assert [p["piece_index"] for p in pieces] == list(range(len(pieces))) and all(p["n_pieces"] == len(pieces) for p in pieces)
        assert (i in found) == (size > 2000)
        if size <= 2000:
            assert len(pieces) == 1 and pieces[0]["piece"] == (content if title is None else f"{title}\n{content}")
            continue
        assert found[i] == boundary(title, content)
        head = title if title is None or len(title) < 1000 else title[:1799]
        at = 0
        for p in pieces:
            assert len(p["piece"]) <= 2000
            assert p["piece"] == ("" if head is None else head + "\n") + content[p["char_start"] : p["char_end"]]
            assert content[at : p["char_start"] + p["overlap"]].strip(" \t\r\n") == ""
            assert 0 <= p["overlap"] <= 200
            at = p["char_end"]
        assert content[at:].strip(" \t\r\n") == ""


def test_boundary_by_bounded_extraction(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    cases = [(rng.randint(-1, 12), "".join(rng.choices("ab. \n\r\t!😀", k=rng.randint(0, 40)))) for _ in range(3000)]
    df = spark.createDataFrame(cases, "room int, content string")
    needed = split.boundary_needed(F.col("content"), F.col("room"))
    longest = {k: F.array_max(F.transform(F.split("content", run, -1), F.char_length)) for k, run in split._RUN.items()}
    by_split = F.coalesce(*[F.when(longest[k] <= F.col("room"), k) for k in split.KINDS], F.lit("none"))
    got = df.select("room", "content", needed.alias("a"), by_split.alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == [] and {r["a"] for r in got} == {*split.KINDS, "none"}
    plan = split.oversized(split.split_chunks(spark.createDataFrame([("1", "T", "x", 0)], SCHEMA)))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and " split(" not in plan and "(split(" not in plan


def test_cuts_at_the_coarsest_boundary_with_overlap(spark):
    para = "word " * 100 + "end."
    got, _ = rows(spark, [("T", "\n\n".join([para] * 12))])
    assert all(p["piece"].endswith("end.") for p in got[0]) and {p["boundary"] for p in got[0]} == {"paragraph"}
    assert [p["overlap"] for p in got[0][1:]] == [200] * (len(got[0]) - 1)


def test_long_titles_lose_nothing(spark):
    title = lambda n: "".join(chr(97 + i % 26) for i in range(n))
    content = "some words " * 30
    cases = [(title(n), content) for n in (1799, 1800, 1998, 1999, 2500, 6100)] + [(title(3800), None), (None, "x " * 1500), (title(2100), "")]
    df = spark.createDataFrame([(str(i), t, c, 0) for i, (t, c) in enumerate(cases)], SCHEMA)
    got = {}
    for r in split.split_chunks(df, rest_of_title=True).collect():
        got.setdefault(int(r["chunk_id"]), []).append(r)
    for i, (t, c) in enumerate(cases):
        pieces = sorted(got[i], key=lambda r: r["piece_index"])
        assert [p["piece_index"] for p in pieces] == list(range(len(pieces))) and {p["n_pieces"] for p in pieces} == {len(pieces)}
        assert all(len(p["piece"]) <= 2000 for p in pieces)
        whole = t is None or len(t) <= 1998
        head = "" if t is None else (t if whole else t[:1799]) + "\n"
        carrying = [p for p in pieces if t is None or p["piece"].startswith(head)]
        covered = {j for p in carrying for j in range(p["char_start"], p["char_end"])}
        assert all(p["piece"] == head + (c or "")[p["char_start"] : p["char_end"]] for p in carrying)
        assert all((c or "")[j].isspace() for j in set(range(len(c or ""))) - covered)
        rest = "".join(p["piece"] for p in pieces[len(carrying) :])
        assert rest == ("" if whole else t[1799:])


def test_nulls_repeats_and_empty(spark):
    got, df = rows(spark, [("T", None), (None, None), ("T", "")])
    assert [got[i][0]["piece"] for i in range(3)] == ["T\n", "", "T\n"]
    long, _ = rows(spark, [("T" * 3000, None), ("T" * 3000, "a b")])
    assert all(len(p["piece"]) <= 2000 and p["boundary"] == "none" for i in (0, 1) for p in long[i])
    twice = df.unionAll(df)
    assert split.split_chunks(twice).count() == 6 and split.split_chunks(df.limit(0)).count() == 0


def test_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    from ledgerloom.llm.queries import SQL, p2_found

    con = duckdb.connect()
    con.sql(f"create view chunks as select * from '{data}/chunks.parquet'")
    assert sorted(con.sql(SQL["p2_found"]).fetchall()) == sorted(tuple(r) for r in p2_found(spark, data).collect())
