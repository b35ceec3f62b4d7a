"""The queries of this package over whole tables, and the SQL that some are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, spans, split, tokenise
from ledgerloom.sources.tables import table


def _pieces(spark: SparkSession, d: str, rest_of_title: bool = False) -> DataFrame:
    return split.split_chunks(table(spark, d, "chunks", "chunk_id", "section_title", "content"), rest_of_title=rest_of_title)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized chunks and the boundary each needs."""
    return split.oversized(_pieces(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chunks, and what is left of overlong titles."""
    return _pieces(spark, d, rest_of_title=True)


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the pieces of every chunk: no character lost, none too long, each joined to its predecessor."""
    return split.coverage(_pieces(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenise.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sized = mixing.sized_documents(table(spark, d, "documents", "doc_id", "text", "source"))
    quota = mixing.apportion(sized, targets)
    return mixing.mix(sized, quota), targets, quota


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every plan and how often each occurs."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares really reached, beside those apportioned."""
    return mixing.reached_shares(*_mixed(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every source of every plan: repeats within the cap, and its apportioned tokens met to one block or a hundredth."""
    mixed, targets, quota = _mixed(spark, d)
    got = mixing.reached_shares(mixed, targets, quota)
    caps = targets.select("plan_id", mixing.source_key(F.col("source")).alias("source"), "max_repeats")
    near = F.abs(F.col("tokens") - F.col("quota_tokens")) <= F.greatest(F.lit(mixing.BLOCK_TOKENS), F.col("quota_tokens") / 100)
    return got.join(F.broadcast(caps), ["plan_id", "source"]).select("plan_id", "source", "target_share", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("quota_met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a long common stretch."""
    return spans.sharing_pairs(table(spark, d, "documents", "doc_id", "text"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The maximal common stretches of such pairs."""
    return spans.shared_spans(table(spark, d, "documents", "doc_id", "text"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """The shared amount of every document."""
    return spans.shared_amounts(table(spark, d, "documents", "doc_id", "text"))


def p8_links(spark: SparkSession, d: str) -> DataFrame:
    """Every document's class of copies and how many other texts it shares a stretch with."""
    return spans.text_links(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_coverage, p6_ids, p7_mixture, p7_shares, p7_kept, p8_found, p8_spans, p8_shared, p8_links)}

# CR LF is one break: its two characters are set apart first, as two of a private area, which keeps all lengths.
_W, _B = "[ \t\r\n]", "(|\r|\n)"
_LINE = rf"[ \t]*{_B}{_W}*"
_STRETCHES = {
    "paragraph": rf"regexp_split_to_array(c, '[ \t]*{_B}[ \t]*{_B}{_W}*')",
    "line": rf"regexp_split_to_array(c, '{_LINE}')",
    "sentence": rf"regexp_split_to_array(regexp_replace(c, '([.!?]){_W}+', '\1{chr(0xE002)}', 'g'), '{chr(0xE002)}|{_LINE}')",
    "word": rf"regexp_split_to_array(c, '{_W}+')",
}
SQL: dict[str, str] = {
    "p2_found": rf"""
with sized as (select chunk_id, replace(coalesce(content, ''), chr(13) || chr(10), '{chr(0xE000)}{chr(0xE001)}') as c, coalesce(length(section_title) + 1, 0) as t from chunks)
select chunk_id, case {" ".join(f"when list_max(list_transform({x}, lambda s: length(s))) <= 2000 - t then '{k}'" for k, x in _STRETCHES.items())} else 'none' end as boundary
from sized where length(c) + t > 2000""",
    "p2_coverage": r"select chunk_id, length(regexp_replace(coalesce(content, ''), '[ \t\r\n]', '', 'g'))::bigint as n_letters, true as fits, true as overlaps from chunks",
    "p7_kept": r"select plan_id, regexp_replace(lower(trim(source)), '[ -]+', '_', 'g') as source, target_share, true as within_cap, true as quota_met from mix_targets",
    "p8_found": """
with w as (select distinct doc_id, hash(substring(text, i::int, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
shared as (select h from w group by h having count(*) > 1), held as (select w.* from w join shared using (h))
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from held a join held b using (h) where a.doc_id < b.doc_id""",
    "p8_links": """
with c as (select doc_id, text, case when text is null then doc_id else min(doc_id) over (partition by text) end as class_id from documents),
w as (select distinct doc_id, hash(substring(text, i::int, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from c where doc_id = class_id and length(text) >= 200)),
shared as (select h from w group by h having count(*) > 1), held as (select w.* from w join shared using (h)),
n as (select a.doc_id as class_id, count(distinct b.doc_id) as n from held a join held b using (h) where a.doc_id <> b.doc_id group by 1)
select doc_id, class_id, coalesce(n, 0) as n_links from c left join n using (class_id)""",
    "p8_spans": """
with w as (select doc_id, i::int as i, hash(substring(text, i::int, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
shared as (select h from w group by h having min(doc_id) < max(doc_id)), held as (select w.* from w join shared using (h)),
hit as (select a.doc_id as doc_id_a, b.doc_id as doc_id_b, a.i as x, b.i as y from held a join held b using (h) where a.doc_id < b.doc_id),
run as (select *, x - row_number() over (partition by doc_id_a, doc_id_b, y - x order by x) as r from hit)
select doc_id_a, doc_id_b, (min(x) - 1)::int as start_a, (min(y) - 1)::int as start_b, (count(*) + 199)::int as length from run group by doc_id_a, doc_id_b, y - x, r""",
    "p8_shared": """
with w as (select doc_id, i::int as i, hash(substring(text, i::int, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
shared as (select h from w group by h having min(doc_id) < max(doc_id)),
gap as (select doc_id, coalesce(lead(i) over (partition by doc_id order by i) - i, 1000) as g from w join shared using (h)),
amount as (select doc_id, sum(least(g, 200)) as c, count(*) filter (where g > 200) as n from gap group by 1)
select doc_id, length(text)::int as n_chars, coalesce(c, 0)::int as shared_chars, case when length(text) > 0 then coalesce(c, 0) / length(text) else 0 end::double as shared_ratio, coalesce(n, 0)::int as n_spans
from documents left join amount using (doc_id)""",
}
