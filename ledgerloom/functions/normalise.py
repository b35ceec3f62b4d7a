"""Normalising and comparing extracted values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.synonyms import VALUES
from ledgerloom.functions.text import NUMBER_WORDS, SCALE_WORDS, stated, trimmed

# Single words and phrases that stand for a number, besides those of `text.NUMBER_WORDS` and `text.SCALE_WORDS`.
OTHER_NUMBER_WORDS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "half": 0.5, "quarter": 0.25}
NUMBER_PHRASES = {"a year": 1, "one year": 1, "two years": 2, "three years": 3}
# What a text multiplies its number by if it ends so.
MULTIPLIERS = {"million|mm|m": 1e6, "billion|b": 1e9, "thousand|k": 1e3}


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a column that is evaluated once, however often `f` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def constant_map(table: dict[str, str | float]) -> Column:
    """A fixed table as a map of texts or numbers, in one expression."""
    quoted = lambda x: f"{x}D" if isinstance(x, float) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def _lookup(table: dict[str, float], c: Column) -> Column:
    return constant_map({k: float(v) for k, v in table.items()})[c]


def word_number(c: Column) -> Column:
    """The number that a whole text is in words, as DOUBLE (SC-01): a word, tens and ones, a multiple, or hundreds and a word; else null."""
    words = NUMBER_WORDS | SCALE_WORDS | OTHER_NUMBER_WORDS
    low = F.lower(trimmed(c))
    parts = F.split(low, r"[\s-]+")
    a, b, last = (_lookup(words, F.get(parts, F.lit(i))) for i in range(3))
    two = F.when((a >= 20) & (a < 100) & (b < 10), a + b).when(b.isin(*[float(x) for x in SCALE_WORDS.values()]), a * b)
    three = F.when(F.get(parts, F.lit(1)) == "hundred", a * 100 + last)
    return F.coalesce(_lookup(words | NUMBER_PHRASES, low), F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three))


def numeric_text(c: Column) -> Column:
    """The number that a text states, as DOUBLE (SC-02): `$2.5 million`, `1,000`, `5%`, `10-15` (the first), `twenty-five`.

    Words count only if they are the whole text (`one month` is no number); digits count wherever they stand first.
    """
    ends = {rf"\s*({p})\s*$": f for p, f in MULTIPLIERS.items()}

    def of(s: Column) -> Column:
        anywhere = F.nullif(F.regexp_replace(F.regexp_extract(s, r"([0-9,]+\.?[0-9]*)", 1), ",", ""), F.lit("")).try_cast("double")
        unsigned = F.regexp_replace(F.regexp_replace(s, r"(?i)^(?:\$\s*)?(?:€\s*)?(?:£\s*)?(?:USD\s*)?(?:US\$\s*)?", ""), r"(?i)(?:\s*dollars?)?(?:\s*USD)?$", "")
        return F.coalesce(word_number(s), bound(unsigned, lambda bare: with_factor(bare, anywhere)))

    def with_factor(bare: Column, anywhere: Column) -> Column:
        factor = F.coalesce(*[F.when(bare.rlike(f"(?i){p}"), f) for p, f in ends.items()], F.lit(1.0))
        cut = F.coalesce(*[F.when(bare.rlike(f"(?i){p}"), F.regexp_replace(bare, p, "")) for p in ends], bare)
        return bound(F.trim(F.regexp_replace(cut, "[,%]", "")), lambda plain: F.coalesce(digits(plain), anywhere) * factor)

    def digits(plain: Column) -> Column:
        first = F.coalesce(F.nullif(F.regexp_extract(plain, r"(?i)^([0-9.]+)(?:\s*[-–—]\s*|\s+to\s+)[0-9.]+", 1), F.lit("")), plain)
        return bound(first, lambda x: F.when(x.rlike(r"^[+-]?(?:[0-9]+|(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"), x).try_cast("double"))

    return bound(trimmed(stated(c)), of)


def mapped(c: Column, synonyms: dict[str, str]) -> Column:
    """A canonical value: an exact synonym, else the first that the text contains, else the text (SC-20..23). Underscores count as blanks."""
    low = F.regexp_replace(F.lower(trimmed(c)), "_", " ")
    exact = constant_map(synonyms)[low]
    inside = F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in synonyms.items()])
    return F.coalesce(exact, inside, c)


def class_key(c: Column) -> Column:
    """A share class name in lower case without a trailing `shares` (SC-05)."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s?shares$", ""))


def class_label(c: Column) -> Column:
    """A share class name for display: `i shares` → `Class I` (SC-32)."""
    s = F.trim(F.regexp_replace(F.trim(c), r"(?i)\s*shares?$", ""))
    return F.when(s.rlike(r"^[A-Za-z]$"), F.concat(F.lit("Class "), F.upper(s))).otherwise(F.initcap(s))


def percent_text(c: Column) -> Column:
    """A percentage as text without its sign; null if nothing is stated (SC-29)."""
    return F.nullif(F.trim(F.regexp_replace(stated(c), "%", "")), F.lit(""))


def section_slug(c: Column) -> Column:
    """A section title as a name: lower-case letters and digits, blanks as underscores (SC-55)."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", "")), r"\s+", "_")


def frequency_rates(rate: Column, frequency: Column) -> Column:
    """struct(annual, quarterly) of a rate stated per quarter or per year; an unknown frequency is a year (SC-30)."""
    quarterly = F.lower(F.coalesce(frequency, F.lit(""))).rlike("quarter")
    return F.struct(F.round(F.when(quarterly, rate * 4).otherwise(rate), 4).alias("annual"), F.round(F.when(quarterly, rate).otherwise(rate / 4), 4).alias("quarterly"))


def comparable(c: Column) -> Column:
    """What a text is compared by (SC-04, SC-06): struct(text, number). A synonym's canonical value has no number; nothing stated has neither."""
    low = F.lower(trimmed(stated(c)))
    canonical = constant_map(VALUES)[low]
    return F.struct(F.coalesce(canonical, low).alias("text"), F.when(canonical.isNull(), numeric_text(c)).alias("number"))


def values_match(got: Column, want: Column, tolerance: Column | float = 0.01, held: tuple[Column, Column] | None = None) -> Column:
    """Whether two texts state the same (SC-06, SC-44): nothing against nothing or false, a wanted number within the tolerance, else the same letters.

    `held` are their `comparable`s, if the caller has computed them.
    """
    a, b = held or (comparable(got), comparable(want))
    limit = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    none = a["text"].isNull() | b["text"].isNull()
    lax = F.coalesce(a["text"], F.lit("false")) == F.coalesce(b["text"], F.lit("false"))
    near = F.coalesce(F.abs(a["number"] - b["number"]) <= limit + 1e-12, F.lit(False))
    return F.when(none, lax & F.coalesce(a["text"], b["text"], F.lit("false")).isin("false")).when(b["number"].isNotNull(), near).otherwise(a["number"].isNull() & (a["text"] == b["text"]))


def lists_match(got: Column, want: Column, mode: Column) -> Column:
    """Lists compared as sets of lower-case texts: exact, subset (of what is expected) or superset (SC-07)."""
    low = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))))
    a, b = low(got), low(want)
    return F.when(mode == "subset", F.size(F.array_except(a, b)) == 0).when(mode == "superset", F.size(F.array_except(b, a)) == 0).otherwise((a == b) & (F.size(got) == F.size(want)))


def glob(c: Column, pattern: str) -> Column:
    """A path matches a pattern, whatever the case (SC-41, SC-42): a star at an end stands for anything there, without one the path has to contain it.

    Stars elsewhere are characters like others.
    """
    low, p = F.lower(c), pattern.lower()
    head, tail = p.startswith("*"), p.endswith("*")
    core = F.lit(p[1 if head else 0 : len(p) - 1 if tail and len(p) > 1 else len(p)])
    if head == tail:
        return F.contains(low, core)
    return F.endswith(low, core) if head else F.startswith(low, core)


def focus(text: Column, value: Column, around: int = 400, head: int = 800) -> Column:
    """What stands around the first place of a value, or the head of the text if it does not occur (SC-50)."""
    at = F.instr(text, value)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at - start + F.char_length(value) + around)).otherwise(F.substring(text, 1, head))
