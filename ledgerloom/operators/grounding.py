"""Grounding: whether a value or a quote stands in a source text, and how sure that makes a value."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.once import computed_once
from ledgerloom.functions.predictor import Entailment, Predictor, RuleEntailment, hashed_embedding, predict
from ledgerloom.workspace import in_workers, materialise


def _flat(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def number_in_text(number: Column, text: Column) -> Column:
    """A number stands in the text as a number of its own, with or without decimals or thousands commas (GR-03). Null finds nothing."""
    n = number.cast("double")
    plain = F.regexp_replace(F.format_string("%.4f", n), r"\.?0+$", "")
    two = F.format_string("%.2f", n)
    commas = F.regexp_replace(F.format_number(n, 4), r"\.?0+$", "")
    low = F.lower(text)
    # A number of its own: no digit, and no point or comma that belongs to one, beside it.
    own = lambda f: F.rlike(low, F.concat(F.lit(r"(?<![0-9])(?<![0-9][.,])\Q"), f, F.lit(r"\E(?![0-9])(?![.,][0-9])")))
    return F.coalesce(own(plain) | own(two) | own(commas), F.lit(False))


def quote_in_text(quote: Column, text: Column, least: int = 20) -> Column:
    """A quote stands in the text whatever its case (GR-04): short ones as they are, others regardless of white space too."""
    return F.coalesce(F.when(F.char_length(quote) < least, F.contains(F.lower(text), F.lower(quote))).otherwise(F.contains(_flat(text), _flat(quote))), F.lit(False))


def _words(c: Column) -> Column:
    return F.split(_flat(c), " ")


def partial_quotes(df: DataFrame, quote: str, text: str, n: int = 5) -> DataFrame:
    """Any run of `n` words of the quote stands in the text, or the quote itself if it has fewer (GR-05): adds `found`. Both are flattened once per row."""
    held = computed_once(df, {"__t": _flat(F.col(text)), "__low": F.lower(quote), "__w": _words(F.col(quote))})
    starts = F.sequence(F.lit(1), F.size("__w") - n + 1)
    runs = F.exists(starts, lambda i: F.contains("__t", F.array_join(F.slice("__w", i, n), " ")))
    found = F.when(F.size("__w") < n, F.contains("__t", F.col("__low"))).otherwise(runs)
    return held.withColumn("found", F.coalesce(found, F.lit(False))).drop("__t", "__low", "__w")


def fuzzy_terms(df: DataFrame, term: str, text: str) -> DataFrame:
    """A term stands in the text, or at least half of its longer words do if it has two (GR-06): adds `found`. Both are flattened once per row."""
    held = computed_once(df, {"__t": _flat(F.col(text)), "__low": _flat(F.col(term)), "__w": F.filter(_words(F.col(term)), lambda w: F.char_length(w) > 3)})
    hits = F.size(F.filter("__w", lambda w: F.contains("__t", w)))
    found = F.contains("__t", F.col("__low")) | ((F.size("__w") >= 2) & (hits * 2 >= F.size("__w")))
    return held.withColumn("found", F.coalesce(found, F.lit(False))).drop("__t", "__low", "__w")


def grounding_score(verified: Column, failed: Column) -> Column:
    """Verified checks over all of them; one half where there was nothing to check (GR-02)."""
    return F.when(verified + failed > 0, verified / F.nullif(verified + failed, F.lit(0))).otherwise(0.5)


def weighted_confidence(signals: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the signals there are; null if there are none (GR-23, GR-29)."""
    total = sum((F.when(s.isNotNull(), s * w).otherwise(0.0) for s, w in signals), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in signals), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def level(confidence: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    """high, medium or low."""
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def _with(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(k, t) for k, t in kinds.items()]])


def sentence_similarity(df: DataFrame, claim: str, evidence: str, sources: str | None = None, threshold: float = 0.75, embedder: Callable[[str], list[float]] = hashed_embedding) -> DataFrame:
    """The sentence of over 20 characters nearest to a claim, by cosine (GR-15): adds similarity, best_sentence, grounded.

    Sentences are those of the evidence, then of the texts in `sources`, an array; the first of equal ones is taken. Without any
    the similarity is 0 and nothing is grounded; a zero vector is similar to nothing.
    """

    def nearest(c: str | None, texts: list[str | None]) -> tuple[float, str | None]:
        sentences = [s for t in texts for x in re.split(r"[.!?]+", t or "") if len(s := x.strip()) > 20]
        if not sentences:
            return 0.0, None
        a, m = np.array(embedder(c or "")), np.array([embedder(s) for s in sentences])
        norm = np.linalg.norm(a) * np.linalg.norm(m, axis=1)
        cosine = np.round(np.divide(m @ a, norm, out=np.zeros(len(m)), where=norm > 0), 9)
        return float(cosine.max()), sentences[int(cosine.argmax())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            more = b[sources] if sources else [None] * len(b)
            got = [nearest(c, [e, *(s if s is not None else [])]) for c, e, s in zip(b[claim], b[evidence], more)]
            yield b.assign(similarity=[s for s, _ in got], best_sentence=[t for _, t in got])

    return in_workers(df).mapInPandas(run, _with(df, similarity=T.DoubleType(), best_sentence=T.StringType())).withColumn("grounded", F.col("best_sentence").isNotNull() & (F.col("similarity") >= threshold))


def entailed(df: DataFrame, claim: str, evidence: str, model: Entailment | None = None, entail: float = 0.7, contradict: float = 0.7, longest: int = 2000) -> DataFrame:
    """Whether evidence entails a claim and does not contradict it (GR-16): adds entailment, contradiction, grounded, confidence = e · (1 − c)."""
    m = model or RuleEntailment()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [m.scores(c or "", e if len(e := t or "") <= longest else e[:longest] + "...") for c, t in zip(b[claim], b[evidence])]
            yield b.assign(entailment=[float(e) for e, _ in got], contradiction=[float(c) for _, c in got])

    e, c = F.col("entailment"), F.col("contradiction")
    scored = in_workers(df).mapInPandas(run, _with(df, entailment=T.DoubleType(), contradiction=T.DoubleType()))
    return scored.withColumns({"grounded": (e >= entail) & (c < contradict), "confidence": e * (1 - c)})


def cascade(df: DataFrame, claim: str, evidence: str, model: Entailment | None = None, judge: Predictor | None = None, high: float = 0.85, entail: float = 0.7, contradict: float = 0.7, least: float = 0.5, longest: int = 2000, ask: bool = True) -> DataFrame:
    """Entailment first, a judge for what it leaves open (GR-18): adds entailment, contradiction, grounded, confidence, strategy.

    From `high` on the entailment's verdict stands; else a contradiction rejects with confidence 0.1; only the rest are sent to the
    judge, whose score is the confidence, grounded from `least` on where it answers. Without `ask` the rest keep the first verdict.
    Scores are written once, so that no row is scored again for each branch.
    """
    first = materialise(entailed(df, claim, evidence, model, entail, contradict, longest), "cascade")
    strategy = F.when(F.col("entailment") >= high, "hybrid_nli_fast").when(F.col("contradiction") >= contradict, "hybrid_nli_reject").otherwise("hybrid_llm_fallback" if ask else "hybrid_nli_only")
    rejected = F.col("strategy") == "hybrid_nli_reject"
    first = first.withColumn("strategy", strategy).withColumns({"grounded": F.col("grounded") & ~rejected, "confidence": F.when(rejected, 0.1).otherwise(F.col("confidence"))})
    if not ask:
        return first
    shown = F.when(F.char_length(evidence) > longest, F.concat(F.substring(evidence, 1, longest), F.lit("..."))).otherwise(F.col(evidence))
    judged = predict(first.where("strategy = 'hybrid_llm_fallback'").withColumn("__shown", shown), claim, "__shown", judge)
    verdict = F.col("answer").isNotNull() & (F.col("answer_score") >= least)
    judged = judged.withColumns({"grounded": verdict, "confidence": F.col("answer_score")}).select(first.columns)
    return first.where("strategy <> 'hybrid_llm_fallback'").unionByName(judged)
