"""Splitting oversized texts at natural boundaries, with overlap, by bounded-quantifier regular expressions.

One regular expression per amount of room is an ordered list of alternatives: as much text as fits before a
paragraph break, else before a line break, a sentence end, white space, else plain characters. Applied again and
again it cuts a whole text in one pass in the JVM; the pieces' offsets are sums over the array of its matches, and the
overlap is a lookback from each offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.once import computed_once

# White space and line breaks (CR LF is one).
WS, NOT_WS, BREAK = r"[ \t\r\n]", r"[^ \t\r\n]", r"(?>\r\n|\r|\n)"
KINDS = ("paragraph", "line", "sentence", "word")

#: What follows a piece that is cut at a boundary of each kind (all after the piece's last character).
_AHEAD = {
    "paragraph": rf"(?=[ \t]*+{BREAK}[ \t]*+{BREAK}|{WS}*+\z)",
    "line": rf"(?=[ \t]*+[\r\n])",
    "sentence": rf"(?<=[.!?])(?={WS})",
    "word": rf"(?={WS})",
}
#: The boundary runs themselves, of all at least as strong as each kind.
_RUN = {
    "paragraph": rf"(?<!{WS}){WS}*?{BREAK}[ \t]*+{BREAK}{WS}*+",
    "line": rf"(?<![ \t])[ \t]*+[\r\n]{WS}*+",
    "sentence": rf"(?<=[.!?]){WS}++|(?<![ \t])[ \t]*+[\r\n]{WS}*+",
    "word": rf"{WS}++",
}


def cutting_pattern(room: Column, overlap: int) -> Column:
    """The regular expression that consumes the next piece. At each strength it first leaves room for the overlap.

    `room` is the most that a piece can hold; with less than twice the overlap, half of the room goes to it.
    """
    spare = F.greatest(F.lit(1), F.when(room > 2 * overlap, room - overlap).otherwise(F.floor(room / 2))).cast("int").cast("string")
    full = room.cast("string")
    parts = []
    for kind in KINDS:
        for limit in (spare, full):
            parts += [F.lit("(?:.{1,"), limit, F.lit("}(?<=" + NOT_WS + ")" + _AHEAD[kind] + ")|")]
    return F.concat(F.lit(f"(?s){WS}*+(?:"), *parts, F.lit(".{1,"), spare, F.lit("})"))


def title_size(title: Column) -> Column:
    """Characters that the title and the line break after it take; 0 for a null title, 1 for an empty one."""
    return F.coalesce(F.char_length(title) + 1, F.lit(0))


def boundary_needed(content: Column, room: Column) -> Column:
    """The coarsest kind of boundary at which cutting everywhere leaves no stretch longer than `room`; else `none`.

    By extraction: matches of as few characters as possible, at most `room`, up to the next run of that kind or the end, each where
    its predecessor ended. A kind will do if they consume the whole content.
    """

    def consumed(kind: str) -> Column:
        stretch = F.concat(F.lit(r"(?s)\G.{0,"), F.greatest(room, F.lit(0)).cast("string"), F.lit("}?(?:" + _RUN[kind] + r"|\z)"))
        return F.aggregate(F.regexp_extract_all(content, stretch, F.lit(0)), F.lit(0), lambda n, x: n + F.char_length(x))

    return F.coalesce(*[F.when((room >= 0) & (consumed(k) == F.char_length(content)), k) for k in KINDS], F.lit("none"))


def split_chunks(chunks: DataFrame, limit: int = 2000, overlap: int = 200, key: str = "chunk_id", rest_of_title: bool = False) -> DataFrame:
    """Cut chunks (key, section_title, content) whose title and content exceed `limit` characters into pieces.

    A chunk's size is the length of its content, plus its title's length and 1 unless the title is null. One row per
    piece: the key, piece_index (from 0), n_pieces, boundary (null: the chunk fits; else the kind of boundary that its
    content needs, `none` if even words are too long), char_start and char_end in content, overlap with the
    predecessor, and piece, which is the title, a line break and content[char_start:char_end]. Pieces lose only white
    space at cuts. A chunk that fits is one piece, as stored; null content is one piece of the title alone; an oversized
    content of nothing but white space is one piece of none of it. A title that leaves
    no room for a character of content is carried cut to nine tenths of the limit; with `rest_of_title` the rest of it
    follows in pieces of its own, of at most `limit` characters, without a title, content or overlap. Repeated keys give rows each; extra columns are ignored. The overlap is `overlap`
    characters, or what room the piece leaves where that is less.
    """
    size = F.coalesce(F.char_length("content"), F.lit(0)) + title_size(F.col("section_title"))
    carried = limit - limit // 10 - 1
    too_long = title_size(F.col("section_title")) >= limit
    title = F.when(too_long, F.substring("section_title", 1, carried)).otherwise(F.col("section_title"))
    df = chunks.select(key, "section_title", "content", size.alias("size"), title.alias("head"))
    room = (F.lit(limit) - title_size(F.col("head"))).cast("int")
    over = F.col("size") > limit
    needed = boundary_needed(F.coalesce("content", F.lit("")), F.lit(limit) - title_size(F.col("section_title")))
    taken = F.regexp_extract_all(F.coalesce("content", F.lit("")), cutting_pattern(room, overlap), F.lit(0))
    df = computed_once(df, {"room": room, "boundary": F.when(over, needed), "taken": F.when(over, taken)})
    # A match begins with the white space after its predecessor; its end is the sum of the lengths so far.
    df = computed_once(df, {"lens": F.transform("taken", F.char_length), "lead": F.transform("taken", lambda x: F.char_length(x) - F.char_length(F.regexp_replace(x, rf"^{WS}+", "")))})
    none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("ends"))
    df = computed_once(df, {"ends": F.aggregate("lens", none, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["ends"], a["sum"] + x).alias("ends")), lambda a: a["ends"])})

    def cut(end: Column, i: Column) -> Column:
        own = F.get("lens", i) - F.get("lead", i)
        before = F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
        lap = F.when(i > 0, F.greatest(F.lit(0), F.least(F.lit(overlap), F.col("room") - (end - before), before))).otherwise(0)
        start = F.when(lap > 0, before - lap).otherwise(end - own)
        return F.struct(i.alias("piece_index"), start.alias("char_start"), end.alias("char_end"), lap.alias("overlap"))

    zero = F.lit(0)
    whole = F.array(F.struct(zero.alias("piece_index"), zero.alias("char_start"), F.coalesce(F.char_length("content"), zero).alias("char_end"), zero.alias("overlap")))
    blank = F.array(F.struct(zero.alias("piece_index"), zero.alias("char_start"), zero.alias("char_end"), zero.alias("overlap")))
    cuts = F.when(over, F.when(F.size("ends") > 0, F.transform("ends", cut)).otherwise(blank)).otherwise(whole)
    df = computed_once(df, {"cuts": cuts}).withColumn("n_cuts", F.size("cuts"))
    if rest_of_title:
        n_rest = F.ceil((F.char_length("section_title") - carried) / limit).cast("int")
        at = F.coalesce(F.char_length("content"), zero)
        rest = F.transform(F.sequence(zero, n_rest - 1), lambda j: F.struct((F.col("n_cuts") + j).alias("piece_index"), at.alias("char_start"), at.alias("char_end"), zero.alias("overlap")))
        df = df.withColumn("cuts", F.when(too_long, F.concat("cuts", rest)).otherwise(F.col("cuts")))
    df = df.select(key, "section_title", "head", "content", "boundary", "n_cuts", F.size("cuts").alias("n_pieces"), F.explode("cuts").alias("c"))
    body = F.substring(F.coalesce("content", F.lit("")), F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start"))
    piece = F.when(F.col("head").isNull(), body).otherwise(F.concat("head", F.lit("\n"), body))
    if rest_of_title:
        beyond = F.col("c.piece_index") - F.col("n_cuts")
        piece = F.when(beyond >= 0, F.substring(F.col("section_title"), carried + 1 + beyond * limit, F.lit(limit))).otherwise(piece)
    return df.select(key, "c.piece_index", "n_pieces", "boundary", "c.char_start", "c.char_end", "c.overlap", piece.alias("piece"))


def coverage(pieces: DataFrame, limit: int = 2000, key: str = "chunk_id") -> DataFrame:
    """What can be said of the pieces of every chunk: key, n_letters (characters of content that are no white space, each counted once), fits (all are
    within the limit), overlaps (all but the first begin where the predecessor ended, less the overlap, or after white space)."""
    own = F.right("piece", F.col("char_end") - F.col("char_start") - F.col("overlap"))
    before = F.lag("char_end").over(Window.partitionBy(key).orderBy("piece_index"))
    begins = F.when(F.col("overlap") > 0, F.col("char_start") + F.col("overlap") == before).otherwise(F.col("char_start") >= before)
    rows = pieces.select(key, F.char_length(F.regexp_replace(own, WS, "")).alias("n"), (F.char_length("piece") <= limit).alias("fit"), F.coalesce(begins, F.lit(True)).alias("lap"))
    return rows.groupBy(key).agg(F.sum("n").alias("n_letters"), F.min(F.coalesce("fit", F.lit(True))).alias("fits"), F.min("lap").alias("overlaps"))


def oversized(pieces: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The chunks that were too large, with the boundary that each needs."""
    return pieces.where("piece_index = 0 and boundary is not null").select(key, "boundary")
