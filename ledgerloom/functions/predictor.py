"""The boundary to external predictors: answers, judgements and embeddings come from a pluggable object.

Nothing here calls a network. The default answers by rules, so that everything before and after a call can run and be tested.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.workspace import in_workers, materialise


class Predictor(Protocol):
    """Answers one question on one text."""

    def answer(self, question: str, text: str) -> tuple[str | None, float]: ...


class RulePredictor:
    """The first sentence that shares most words with the question, and the share of them."""

    def answer(self, question: str, text: str) -> tuple[str | None, float]:
        wanted = set(re.findall(r"[a-z]{4,}", question.lower()))
        best, score = None, 0
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            hits = len(wanted & set(re.findall(r"[a-z]{4,}", sentence.lower())))
            if hits > score:
                best, score = sentence, hits
        return best, score / len(wanted) if wanted else 0.0


class LeadPredictor:
    """A summary by rule: the first sentence of each paragraph, whatever the question; none for a blank text."""

    def answer(self, question: str, text: str) -> tuple[str | None, float]:
        firsts = [re.split(r"(?<=[.!?])\s+", p.strip())[0] for p in re.split(r"\n\s*\n", text or "") if p.strip()]
        return (" ".join(firsts), 1.0) if firsts else (None, 0.0)


class Entailment(Protocol):
    """How far evidence entails a claim and how far it contradicts it, each from 0 to 1."""

    def scores(self, claim: str, evidence: str) -> tuple[float, float]: ...


class RuleEntailment:
    """The share of the claim's words and numbers that the evidence holds; it contradicts instead if just one of them negates."""

    def scores(self, claim: str, evidence: str) -> tuple[float, float]:
        words = lambda t: set(re.findall(r"[a-z]{4,}|\d[\d.,]*(?<=\d)", t.lower()))
        negates = lambda t: bool(re.search(r"\b(?:no|not|never|none|without)\b", t.lower()))
        wanted = words(claim)
        share = len(wanted & words(evidence)) / len(wanted) if wanted else 0.0
        return (0.0, share) if negates(claim) != negates(evidence) else (share, 0.0)


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """The share of the query's words that each text holds: relevance by rule."""
    wanted = set(re.findall(r"\w+", query.lower()))
    return [len(wanted & set(re.findall(r"\w+", t.lower()))) / len(wanted) if wanted else 0.0 for t in texts]


def predict(df: DataFrame, question: str, text: str, predictor: Predictor | None = None) -> DataFrame:
    """Adds answer and answer_score. Only the rows given are sent, so filter before it; rows stream in Arrow batches."""
    p = predictor or RulePredictor()
    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("answer_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [p.answer(q or "", t or "") for q, t in zip(b[question], b[text])]
            yield b.assign(answer=[a for a, _ in got], answer_score=[float(s) for _, s in got])

    return in_workers(df).mapInPandas(run, schema)


def hashed_embedding(text: str | None, size: int = 64) -> list[float]:
    """A unit vector of hashed words: deterministic, no model; zero for a text without words."""
    v = np.zeros(size)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % size] += 1 if h & 1 << 16 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Adds `embedding` by the hashed words of a text."""
    in_workers(df)

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hashed_embedding(t, size))

    return df.withColumn("embedding", run(F.col(text)))


def two_phase(df: DataFrame, exists: str, detail: str, text: str, least: float = 0.5, predictor: Predictor | None = None) -> DataFrame:
    """Details are asked only where the first question found something (LL-10, LL-15): adds found, answer, answer_score. Rows without it keep nulls."""
    first = predict(df.withColumn("__q", F.lit(exists)), "__q", text, predictor).withColumn("found", F.col("answer_score") >= least).drop("answer", "answer_score")
    asked = predict(first.where("found").withColumn("__q", F.lit(detail)), "__q", text, predictor)
    return asked.unionByName(first.where("not found"), allowMissingColumns=True).drop("__q")


def parse_blocks(df: DataFrame, keys: list[str], text: str, fields: dict[str, str], required: str) -> DataFrame:
    """Answers of blocks of `KEY: value` lines divided by `---` lines, as typed records (LL-12..14): keys, ord, fields. Blocks without the required key are left out."""
    blocks = df.select(*keys, F.posexplode(F.split(F.col(text), r"(?m)^\s*-{3,}\s*$")).alias("ord", "__b"))
    read = [F.nullif(F.trim(F.regexp_extract("__b", rf"(?im)^\s*{k}\s*:[ \t]*(.*?)[ \t\r]*$", 1)), F.lit("")).try_cast(t).alias(k.lower()) for k, t in fields.items()]
    return blocks.select(*keys, "ord", *read).where(F.col(required.lower()).isNotNull())


def bounded_rounds(open_items: DataFrame, act, key: str, rounds: int) -> DataFrame:
    """Rounds of an agent over what is still open (LL-22): `act(items, round)` returns items with `value`; those with one are done.

    Each round is one job over all open items and its result is written, so plans stay short and no item waits for another.
    """
    done = None
    for n in range(rounds):
        result = materialise(act(open_items, n).withColumn("round", F.lit(n)), "round")
        got = result.where("value is not null")
        done = got if done is None else done.unionByName(got)
        open_items = open_items.join(got.select(key), key, "left_anti")
        if open_items.isEmpty():
            break
    return done
