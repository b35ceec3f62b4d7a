"""From documents to facts, sections and chunks: the operators of tagged and rendered documents as one program."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import chunker
from ledgerloom.operators import sections as S
from ledgerloom.sources import html_sections, ixbrl
from ledgerloom.workspace import materialise


@dataclass(frozen=True)
class Parsed:
    """What is read of documents: facts, text blocks, mapped values, sections and chunks, each a table by filing_id."""

    facts: DataFrame
    blocks: DataFrame
    values: DataFrame
    sections: DataFrame
    chunks: DataFrame


def parse(filings: DataFrame, least: int = 100, max_tokens: int = 500, overlap_tokens: int = 50, context_chars: int = 200) -> Parsed:
    """Parse documents (filing_id, html).

    Sections are those of text blocks, then standard sections by their titles, then those of headings; one whose title another of
    higher priority has alike is left out. Each has its target fields. Chunks come by section, with the end of their predecessor. The stream
    of tags and the sections are written once, as several tables are made of them. Null documents give nothing.
    """
    stream = materialise(ixbrl.events(filings), "events")
    facts, blocks = ixbrl.numeric_facts(stream), ixbrl.text_blocks(stream)
    none = F.lit(None).cast("int")
    tagged = blocks.select("filing_id", S.camel_words(F.regexp_replace("name", "^.*:", "")).alias("title"), F.col("name").alias("tag"), F.lit("tagged").alias("source"), none.alias("char_start"), "content")
    texts = html_sections.plain_text(filings)
    spans = S.standard_sections(texts, "filing_id", "text")
    cut = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    standard = spans.join(texts, "filing_id").select("filing_id", "title", F.lit(None).cast("string").alias("tag"), F.lit("standard").alias("source"), "char_start", cut.alias("content"))
    headed = html_sections.heading_sections(filings, least=least).select("filing_id", "title", F.lit(None).cast("string").alias("tag"), F.lit("heading").alias("source"), "char_start", "content")
    rows = S.by_priority([tagged, standard, headed], ["filing_id"], "title").where(F.char_length("content") >= least)
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy(F.asc_nulls_first("char_start"), "title"))
    sections = rows.withColumns({"target_fields": S.target_fields(F.col("title"), F.col("tag")), "ord": place})
    sections = materialise(sections.withColumn("section_id", F.substring(F.md5(F.concat_ws("_", "filing_id", "title", F.col("ord").cast("string"))), 1, 12)), "sections")
    chunks = chunker.chunk_texts(sections, "section_id", "content", max_tokens, overlap_tokens)
    chunks = S.with_context(chunks, ["section_id"], "chunk_index", "content", context_chars)
    chunks = chunks.join(sections.select("section_id", "filing_id", F.col("title").alias("section_title"), "target_fields"), "section_id")
    return Parsed(facts, blocks, ixbrl.tagged_values(facts, blocks), sections, chunks)
