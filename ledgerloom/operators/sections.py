"""Sections and chunks: markup stripped, headings to intervals, merges, fixed windows, context, packing, entities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.once import computed_once
from ledgerloom.functions.section_table import STANDARD_SECTIONS, TITLE_PATTERNS
from ledgerloom.sources import taxonomy
from ledgerloom.workspace import in_workers

# What an entity looks like.
ENTITY_PATTERNS = {"amount": r"\$[0-9][0-9,]*(?:\.[0-9]+)?", "percent": r"[0-9]+(?:\.[0-9]+)?%", "share_class": r"Class [A-Z]\b"}


def strip_markup(c: Column) -> Column:
    """Text without scripts, styles and tags, runs of white space as one blank (XB-14)."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """At most one blank line and one blank in a row (SEG-27)."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " "))


def content_type(c: Column) -> Column:
    """`mixed`, `table`, `list` or `text` by what markup or layout occurs (SEG-17)."""
    table = c.rlike(r"(?i)<table|(?m)^[^\n|]*\|[^\n|]*\|")
    items = c.rlike(r"(?i)<[uo]l\b|(?m)^\s*(?:[-*•]|[0-9]+[.)]) ")
    return F.when(table & items, "mixed").when(table, "table").when(items, "list").otherwise("text")


def title_key(c: Column) -> Column:
    """The letters of a title in lower case; null if there are none, so that nothing matches it (SEG-04)."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z]+", ""), F.lit(""))


def titles_similar(a: Column, b: Column) -> Column:
    """One title's letters contain the other's (SEG-04)."""
    x, y = title_key(a), title_key(b)
    return F.coalesce(F.contains(x, y) | F.contains(y, x), F.lit(False))


def camel_words(c: Column) -> Column:
    """`FeeTableTextBlock` as `Fee Table Text Block` (SEG-08)."""
    return F.trim(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "))


#: A line of its own in capitals, or in title case without a full stop.
HEADING_LINE = r"(?md)^(?:[A-Z][A-Z &,-]{3,60}|(?:[A-Z][a-z]+)(?: (?:and|of|the|for|[A-Z][a-z]+)){1,6})$"


def heading_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 100) -> DataFrame:
    """Sections of a plain text: from each heading line to the next (SEG-09, SEG-15): key, ord, title, char_start, n_chars.

    A heading is a short line of its own, in capitals or title case without a full stop, after a line break or at the start.
    What is shorter than `least` characters is dropped. The text is cut at its headings within its row, so nothing is shuffled.
    """
    held = computed_once(docs.select(key, F.col(text).alias("__t")), {"__heads": F.regexp_extract_all("__t", F.lit(HEADING_LINE), F.lit(0)), "__between": F.transform(F.split("__t", HEADING_LINE), F.char_length)})
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    # The k-th heading starts after the k stretches and the k headings before it.
    pairs = F.zip_with("__heads", F.slice("__between", 1, F.size("__heads")), lambda h, n: F.struct(n.alias("n"), F.char_length(h).alias("h")))
    starts = F.aggregate(pairs, none, lambda a, x: F.struct((a["at"] + x["n"] + x["h"]).alias("at"), F.array_append(a["starts"], a["at"] + x["n"]).alias("starts")), lambda a: a["starts"])
    held = computed_once(held, {"__starts": starts, "__n": F.char_length("__t")})
    end = lambda i: F.coalesce(F.get("__starts", i + 1), F.col("__n"))
    rows = F.transform("__heads", lambda h, i: F.struct((i + 1).alias("ord"), h.alias("title"), F.get("__starts", i).alias("char_start"), (end(i) - F.get("__starts", i)).alias("n_chars")))
    return held.select(key, F.explode(F.filter(rows, lambda r: r["n_chars"] >= least)).alias("s")).select(key, "s.*")


def consolidate(sections: DataFrame, groups: list[str], title: str, order: str, text: str) -> DataFrame:
    """Sections of the same title letters as one: texts in order with a blank line between, first title, how many (SEG-06, SEG-07)."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    keyed = sections.withColumn("title_key", title_key(F.col(title))).where("title_key is not null")
    return keyed.groupBy(*groups, "title_key").agg(F.min_by(title, order).alias("title"), F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("text"), F.count("*").alias("n_parts"))


def by_priority(sources: list[DataFrame], groups: list[str], title: str) -> DataFrame:
    """A union in order of priority without sections whose title a section of higher priority has alike (SEG-01, SEG-03)."""
    out = sources[0]
    for df in sources[1:]:
        kept = out.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col(title).alias("__title"))
        same = F.lit(True)
        for g in groups:
            same = same & (F.col(g) == F.col(f"__{g}"))
        out = out.unionByName(df.join(kept, same & titles_similar(F.col(title), F.col("__title")), "left_anti"))
    return out


def fixed_windows(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of `size` characters that overlap by `overlap`, in closed form (CH-01): adds idx, char_start, window."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.char_length(text) - size) / F.lit(step))).cast("int")
    df = df.where(F.char_length(text) > 0).withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    return df.withColumn("char_start", F.col("idx") * step).withColumn("window", F.substring(F.col(text), F.col("char_start") + 1, F.lit(size)))


def with_context(df: DataFrame, groups: list[str], order: str, text: str, n: int) -> DataFrame:
    """The last `n` characters of the predecessor in the group as preceding_context (CH-09)."""
    return df.withColumn("preceding_context", F.right(F.lag(text).over(Window.partitionBy(*groups).orderBy(order)), F.lit(n)))


def chunk_ids(section: Column, index: Column, content: Column) -> tuple[Column, Column]:
    """(chunk_id, content_hash): the first sixteen characters of a digest of section, index and start, and one of the content (CH-25)."""
    return F.substring(F.md5(F.concat_ws(":", section, index.cast("string"), F.substring(content, 1, 50))), 1, 16), F.md5(content)


def pack_paragraphs(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Paragraphs, small ones joined to what follows (CH-14): key, group, n_paragraphs, text.

    A group ends with the first paragraph that is not small; what is left at the end is a group too. Folded within the row of the
    text, so nothing is shuffled.
    """
    paras = F.filter(F.transform(F.split(F.col(text), r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")
    group = "struct<n_paragraphs:bigint,text:array<string>>"
    start = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("open"))

    def step(a: Column, p: Column) -> Column:
        n, open_ = a["n"] + 1, F.array_append(a["open"], p)
        closed = F.array_append(a["done"], F.struct(n.alias("n_paragraphs"), open_.alias("text")))
        return F.when(F.char_length(p) >= least, F.struct(closed.alias("done"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("open"))).otherwise(F.struct(a["done"].alias("done"), n.alias("n"), open_.alias("open")))

    def finish(a: Column) -> Column:
        return F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["n"].alias("n_paragraphs"), a["open"].alias("text")))).otherwise(a["done"])

    groups = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.aggregate(paras, start, step, finish)).alias("group", "g"))
    return groups.select(key, F.col("group").cast("bigint").alias("group"), "g.n_paragraphs", F.array_join("g.text", "\n\n").alias("text"))


def entities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Amounts, percentages and share classes in a text as typed rows (CH-19): keys, kind, value."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[of(k, p) for k, p in ENTITY_PATTERNS.items()])
    return df.select(*keys, F.explode(found).alias("e")).select(*keys, "e.kind", "e.value")


def pattern_sections(docs: DataFrame, patterns: dict[str, str], key: str = "doc_id", text: str = "text", apart: int = 50, most: int = 50_000, least: int = 100) -> DataFrame:
    """Sections by the first match of each named pattern (SEG-02): key, section, char_start, char_end.

    A section ends where the nearest other one starts that begins over `apart` characters later, at most `most` on; shorter than
    `least` are dropped. The starts of a text are one small array, so finding the ends needs no join.
    """
    starts = F.array(*[F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(n).alias("section")) for n, p in patterns.items()])
    df = docs.select(key, F.char_length(text).alias("n"), F.filter(starts, lambda s: s["at"] > 0).alias("starts")).where(F.size("starts") > 0)
    df = df.withColumn("s", F.explode("starts"))
    later = F.array_min(F.transform(F.filter("starts", lambda o: o["at"] > F.col("s.at") + apart), lambda o: o["at"]))
    end = F.least(F.coalesce(later - 1, F.col("n")), F.col("s.at") - 1 + most, F.col("n"))
    return df.select(key, "s.section", (F.col("s.at") - 1).alias("char_start"), end.alias("char_end")).where(F.col("char_end") - F.col("char_start") >= least)


def keyword_passages(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", best: int = 5, before: int = 1, after: int = 2) -> DataFrame:
    """Passages around the paragraphs with most terms (SEG-23): key, first, last (paragraph numbers), score.

    The `best` paragraphs by the number of terms they hold, each with its neighbours, united where they touch.
    """
    paras = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"\n\n+")).alias("pos", "para"), F.size(F.split(F.col(text), r"\n\n+")).alias("n"))
    low = F.lower("para")
    paras = paras.withColumn("score", sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))).where("score > 0")
    paras = paras.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= best)
    around = F.sequence(F.greatest(F.lit(0), F.col("pos") - before), F.least(F.col("n") - 1, F.col("pos") + after))
    near = paras.select(key, F.explode(around).alias("p"), "pos", "score").groupBy(key, "p").agg(F.sum(F.when(F.col("p") == F.col("pos"), F.col("score")).otherwise(0)).alias("score"))
    run = F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p"))
    return near.withColumn("run", run).groupBy(key, "run").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.sum("score").alias("score")).drop("run")


def section_fields(df: DataFrame, patterns: dict[str, list[str]], title: str) -> DataFrame:
    """The fields whose patterns a title matches, as a sorted array (SEG-18): adds target_fields."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(F.col(title).rlike("(?i)" + "|".join(ps)), F.lit(False)), f) for f, ps in sorted(patterns.items())]))
    return df.withColumn("target_fields", hits)


def section_name(title: Column) -> Column:
    """The standard section that a title names, the first in the table's order (SEG-19, SEG-20); null if none."""
    return F.coalesce(*[F.when(title.rlike(p), name) for name, p in TITLE_PATTERNS.items()])


def target_fields(title: Column, tag: Column) -> Column:
    """The fields that a section can hold (SEG-18): those of its tag, of every standard section and every kind of heading that its title matches, sorted."""
    words = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    by_tag = F.create_map(*[x for t, names in taxonomy.BLOCK_FIELDS.items() for x in (F.lit(t), words(names))])[tag]
    by_title = [F.when(title.rlike(TITLE_PATTERNS[n]), words(fields)) for n, (_, fields, _) in STANDARD_SECTIONS.items() if fields]
    by_heading = [F.when(title.rlike("(?i)(?:" + "|".join(ps) + ")"), words(fields)) for ps, fields in taxonomy.HEADING_FIELDS.values()]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(by_tag, *by_title, *by_heading)))))


def standard_spans(text: str | None, apart: int = 50, most: int = 50_000, least: int = 100) -> list[tuple[str, str, int, int]]:
    """The standard sections of a text as (section, title, start, end), in order of their start (SEG-02, SEG-22).

    A section starts at the first match of its patterns, in their order, after which it has `least` characters: it ends at the next
    match of another section that begins over `apart` characters after its title, or `most` characters on. So the lines of a table of
    contents start none. Runs of white space count as one blank in matching; offsets are those of the text.
    """
    if not text:
        return []
    words = list(re.finditer(r"\S+", text))
    flat = " ".join(w.group() for w in words)
    starts = np.cumsum([0, *[len(w.group()) + 1 for w in words]])

    def place(p: int) -> int:
        i = int(np.searchsorted(starts, p, side="right")) - 1
        return words[i].start() + p - int(starts[i]) if i < len(words) else len(text)

    matches = [(name, [(m.start(), m.end()) for p in patterns for m in re.finditer(p, flat, re.I)]) for name, (patterns, _, _) in STANDARD_SECTIONS.items()]
    found = []
    for name, own in matches:
        others = np.array(sorted(s for n, ms in matches if n != name for s, _ in ms), np.int64)
        for s, e in own:
            i = int(np.searchsorted(others, e + apart))
            begin = place(s)
            end = min(place(int(others[i])) if i < len(others) else len(text), begin + most)
            if end - begin >= least:
                found.append((name, flat[s:e], begin, end))
                break
    return sorted(found, key=lambda f: f[2])


def standard_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The standard sections of texts (SEG-02): key, section, title, char_start, char_end. Null and empty texts have none."""
    columns = [key, "section", "title", "char_start", "char_end"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *s) for k, t in zip(b[key], b[text]) for s in standard_spans(t)], columns=columns)

    return in_workers(docs.select(key, text)).mapInPandas(run, f"`{key}` {kind}, section string, title string, char_start int, char_end int")
