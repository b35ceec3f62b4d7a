"""Column functions on text: null spellings, quotes, keys, numbers in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that state nothing, in lower case.
NULL_SPELLINGS = (
    "", "na", "n/a", "n.a.", "none", "null", "nil", "nan", "not stated", "not available", "not applicable",
    "not found", "not specified", "not disclosed", "missing", "-", "--",
)

# Numbers in words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALE_WORDS = {"hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}

WORD = "(?:" + "|".join([*NUMBER_WORDS, *SCALE_WORDS]) + r")\b"
NUMBER_IN_WORDS = rf"{WORD}(?:(?:[ -]|\band\b)+{WORD})*"
NUMBER_IN_DIGITS = r"[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+"


def trimmed(c: Column) -> Column:
    """`c` without white space (also no-break spaces) at its ends."""
    return F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", "")


def unquoted(c: Column) -> Column:
    """`c` trimmed, without one pair of quotes around it, and trimmed again."""
    return trimmed(F.regexp_replace(trimmed(c), r"""(?s)^(["'])(.*)\1$|^“(.*)”$""", "$2$3"))


def states_nothing(c: Column) -> Column:
    """True for null and for every null spelling."""
    return c.isNull() | F.lower(trimmed(c)).isin(*NULL_SPELLINGS)


def stated(c: Column) -> Column:
    """`c`, null where it states nothing."""
    return F.when(~states_nothing(c), c)


def words_to_number(c: Column) -> Column:
    """A number in lower-case English words as BIGINT (`one hundred eighty` → 180); null if there is none."""
    values = F.create_map(*[F.lit(x) for kv in (NUMBER_WORDS | SCALE_WORDS).items() for x in kv])
    tokens = F.filter(F.split(c, r"[^a-z]+"), lambda w: w.rlike(f"^{WORD}$"))
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("part"))

    def step(acc: Column, w: Column) -> Column:
        n, part = values[w].cast("bigint"), acc["part"]
        times = F.greatest(part, F.lit(1).cast("bigint")) * n
        return F.when(n >= 1000, F.struct((acc["total"] + times).alias("total"), F.lit(0).cast("bigint").alias("part"))).otherwise(
            F.struct(acc["total"].alias("total"), F.when(w == "hundred", times).otherwise(part + n).alias("part"))
        )

    return F.when(F.size(tokens) > 0, F.aggregate(tokens, zero, step, lambda a: a["total"] + a["part"]))


def digits_to_decimal(c: Column) -> Column:
    """Digits with optional thousands commas as DECIMAL(20,6); null if they are none."""
    return F.regexp_replace(c, ",", "").try_cast("decimal(20,6)")


def cik_key(c: Column) -> Column:
    """The identifier a CIK text denotes: ten digits, or the upper-cased text if it is none; null if it states nothing."""
    s = F.upper(trimmed(stated(c)))
    digits = F.regexp_extract(s, r"^(?:CIK)?[\s#:_-]*0*([0-9]{1,10})(?:\.0*)?$", 1)
    return F.when(s.isNull(), None).when(digits != "", F.lpad(digits, 10, "0")).when(s.rlike(r"^(?:CIK)?[\s#:_-]*0+(?:\.0*)?$"), F.lit("0" * 10)).otherwise(s)


def accession_key(c: Column) -> Column:
    """The identifier an accession number denotes: eighteen digits, or the upper-cased text; null if it states nothing."""
    s = F.upper(trimmed(stated(c)))
    bare = F.regexp_replace(F.regexp_replace(s, r"\.(?:TXT|HTML?|XML|0+)$", ""), r"[\s_-]", "")
    return F.when(s.isNull(), None).when(bare.rlike(r"^[0-9]{1,18}$"), F.lpad(bare, 18, "0")).otherwise(s)


def quarter_label(c: Column) -> Column:
    """A quarter in any order of year and `Qn` as `2025q3`; null if it cannot be read."""
    s = F.lower(trimmed(c))
    year, q = F.regexp_extract(s, r"([12][0-9]{3})", 1), F.regexp_extract(s, r"q[\s-]*([1-4])(?![0-9])", 1)
    return F.when((year != "") & (q != ""), F.concat(year, F.lit("q"), q))


def token_of(c: Column) -> Column:
    """Lower case, with each run of blanks, hyphens and underscores as one underscore."""
    return F.regexp_replace(F.lower(trimmed(c)), r"[\s_-]+", "_")
