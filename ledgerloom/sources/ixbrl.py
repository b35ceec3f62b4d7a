"""Inline-tagged filings as facts: one pass of an event parser per document, then DataFrame operators.

The parser emits a tagged stream of rows (contexts, numeric facts, text blocks, footnotes, continuations, headings, flags);
everything relational about them (context lookup, duplicates, continuations, class and fund levels) is a join or an aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import words_to_number
from ledgerloom.sources import taxonomy
from ledgerloom.workspace import in_workers

EVENTS = "filing_id string, pos int, kind string, id string, name string, context_ref string, unit string, scale string, sign string, continued_at string, format string, text string"
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "wbr"}
_TAGGED = {"ix:nonfraction": "number", "ix:fraction": "number", "ix:nonnumeric": "block", "ix:footnote": "footnote", "ix:continuation": "continuation"}


class _Events(HTMLParser):
    """Collects tagged elements with their text, contexts and headings; text of scripts and styles is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.live: list[dict] = []
        self.hidden = 0
        self.context: dict | None = None
        self.pos = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k.lower(): v or "" for k, v in attrs}
        row = None
        self.pos += 1
        kind = _TAGGED.get(tag) or ("heading" if re.fullmatch("h[1-6]", tag) else None)
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "xbrli:context" or tag == "context":
            self.context = row = {"kind": "context", "id": a.get("id", ""), "parts": [], "pos": self.pos}
        elif kind:
            row = {"kind": kind, "id": a.get("id", ""), "name": a.get("name", tag if kind == "heading" else ""), "context_ref": a.get("contextref"), "unit": a.get("unitref"), "scale": a.get("scale"), "sign": a.get("sign"), "continued_at": a.get("continuedat"), "format": a.get("format"), "parts": [], "pos": self.pos}
        if row is not None:
            self.rows.append(row)
            self.live.append(row)
        if tag not in _VOID:
            self.open.append((tag, row))
        elif self.live:
            self._text(" ")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, row = self.open.pop()
            if row is not None:
                self.live.remove(row)
            if t in ("script", "style"):
                self.hidden -= 1
            if t == tag:
                break
        self._text(" ")

    def _text(self, data: str) -> None:
        if not self.hidden:
            for row in self.live:
                row["parts"].append(data)

    def handle_data(self, data: str) -> None:
        if self.context is not None and self.context in self.live and self.open:
            tag = self.open[-1][0].split(":")[-1]
            if data.strip():
                self.context["parts"].append(f"{tag}={data.strip()} ")
            return
        self._text(data)


def parse_events(html: str | None) -> list[dict]:
    """The events of one document; none for null."""
    p = _Events()
    p.feed(html or "")
    p.close()
    return [{**{k: r.get(k) for k in ("pos", "kind", "id", "name", "context_ref", "unit", "scale", "sign", "continued_at", "format")}, "text": re.sub(r"\s+", " ", "".join(r["parts"])).strip()} for r in p.rows]


def events(filings: DataFrame, key: str = "filing_id", html: str = "html") -> DataFrame:
    """The tagged stream of all documents (XB-01). Documents stream through in Arrow batches; nothing is shuffled."""
    columns = [c.split()[0] for c in EVENTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for filing, text in zip(b["filing_id"], b["html"]):
                rows += [(filing, *r.values()) for r in parse_events(text)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return in_workers(filings.select(F.col(key).cast("string").alias("filing_id"), F.col(html).alias("html"))).mapInPandas(run, EVENTS)


def share_class(c: Column) -> Column:
    """The share class that a context's id or a member names (XB-04..06): the first pattern that matches; null if none does or a word vetoes."""
    veto = F.greatest(*[F.contains(F.upper(c), F.lit(w.upper())) for w in taxonomy.NOT_A_CLASS])
    named = [F.when(c.rlike(f"(?i){p}"), F.concat(F.lit(before), F.regexp_extract(c, f"(?i){p}", 1), F.lit(after))) for p, before, after in taxonomy.CLASS_PATTERNS]
    return F.when(~veto, F.coalesce(*named))


def contexts(stream: DataFrame) -> DataFrame:
    """Contexts with period and share class (XB-02, XB-03): the id decides, else the first of its explicit members that names one."""
    part = lambda tag: F.nullif(F.regexp_extract("text", rf"(?i){tag}=(\S+)", 1), F.lit(""))
    members = F.regexp_extract_all("text", F.lit(r"(?i)explicitmember=(\S+)"), F.lit(1))
    by_member = F.get(F.array_compact(F.transform(members, share_class)), F.lit(0))
    return stream.where("kind = 'context'").select("filing_id", F.col("id").alias("context_ref"), part("startdate").alias("period_start"), part("enddate").alias("period_end"), part("instant").alias("instant"), F.coalesce(share_class(F.col("id")), by_member).alias("share_class"))


def fact_number(text: Column, scale: Column, sign: Column, fmt: Column) -> Column:
    """The value of a numeric fact as DECIMAL(38,10) (XB-08, XB-09): words by their format, dashes as zero, scaled by a power of ten; null if unreadable."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"[,\s$%]", "")
    number = F.when(s.isin("", "-", "—", "–", "none", "n/a", "nil"), F.lit(0).cast("decimal(28,10)")).when(F.coalesce(fmt, F.lit("")).rlike("(?i)word"), F.coalesce(words_to_number(F.lower(text)), F.lit(0)).cast("decimal(28,10)")).otherwise(F.when(s.rlike(r"^\(?[+-]?[0-9]*\.?[0-9]+\)?$"), F.regexp_replace(s, "[()]", "")).try_cast("decimal(28,10)"))
    power = F.coalesce(scale.try_cast("int"), F.lit(0))
    tens = {p: f"1{'0' * p}" if p >= 0 else f"0.{'0' * (-p - 1)}1" for p in range(-8, 13)}
    factor = F.coalesce(*[F.when(power == p, F.lit(v).cast("decimal(22,8)")) for p, v in tens.items()])
    return (number * factor * F.when(sign == "-", -1).otherwise(1)).cast("decimal(38,10)")


def numeric_facts(stream: DataFrame) -> DataFrame:
    """Numeric facts with their contexts (XB-07): one per id, the first; facts without an id all stay; unreadable ones are left out."""
    w = Window.partitionBy("filing_id", "id").orderBy("pos")
    facts = stream.where("kind = 'number'").withColumn("rn", F.row_number().over(w)).where("rn = 1 or id = ''")
    facts = facts.withColumn("value", fact_number(F.col("text"), F.col("scale"), F.col("sign"), F.col("format"))).where("value is not null")
    return facts.join(contexts(stream), ["filing_id", "context_ref"], "left").select("filing_id", "pos", "id", "name", "context_ref", "unit", "value", "share_class", "period_start", "period_end", "instant")


# What marks a footnote as one about fees, and the name of the block that is made of it.
FEE_FOOTNOTE_KEYWORDS = ("incentive fee", "performance fee", "hurdle rate", "catch-up", "high water mark", "expense cap", "fee waiver", "pre-incentive fee", "net investment income")
FEE_FOOTNOTE = "ix:footnote:FeeStructure"


def fee_footnotes(stream: DataFrame) -> DataFrame:
    """Footnotes about fees as text blocks (XB-12): all that hold a keyword in any case, repeated ids too; others are left out, as in the reference."""
    about = F.greatest(*[F.contains(F.lower("text"), F.lit(k)) for k in FEE_FOOTNOTE_KEYWORDS])
    return stream.where("kind = 'footnote'").where(about).select("filing_id", "pos", "id", F.lit(FEE_FOOTNOTE).alias("name"), F.col("text").alias("content"))


def text_blocks(stream: DataFrame) -> DataFrame:
    """Text blocks with the one element that continues them, and the footnotes about fees (XB-11..13): empty ones are left out."""
    cont = stream.where("kind = 'continuation'").select("filing_id", F.col("id").alias("continued_at"), F.col("text").alias("more"))
    w = Window.partitionBy("filing_id", "id").orderBy("pos")
    blocks = stream.where("kind = 'block' and contains(name, 'Text')").withColumn("rn", F.row_number().over(w)).where("rn = 1 or id = ''")
    text = F.trim(F.concat_ws(" ", F.nullif(F.col("text"), F.lit("")), "more"))
    return blocks.join(cont, ["filing_id", "continued_at"], "left").select("filing_id", "pos", "id", "name", text.alias("content")).where("content <> ''").unionByName(fee_footnotes(stream))


def _mapped(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("name")]


def tagged_values(facts: DataFrame, blocks: DataFrame, tags: dict[str, str] = taxonomy.TAG_FIELDS, texts: dict[str, str] = taxonomy.TEXT_BLOCKS) -> DataFrame:
    """Mapped facts and text blocks by field (XB-19, XB-24, XB-25): filing_id, field, share_class (null: fund level), value, content. The last of a field and class decides."""
    numbers = facts.withColumn("field", _mapped(tags)).where("field is not null").groupBy("filing_id", "field", "share_class").agg(F.max_by("value", "pos").alias("value"))
    parts = blocks.withColumn("field", _mapped(texts)).where("field is not null").groupBy("filing_id", "field").agg(F.max_by("content", "pos").alias("content"))
    return numbers.unionByName(parts, allowMissingColumns=True)


def fee_table(facts: DataFrame, tags: dict[str, str] = taxonomy.TAG_FIELDS, fields: tuple[str, ...] = taxonomy.CLASS_FEES) -> DataFrame:
    """Per filing, share class (null: fund level) and fee the last value (XB-20): filing_id, share_class, field, value; both levels are kept."""
    rows = facts.withColumn("field", _mapped(tags)).where(F.col("field").isin(*fields))
    return rows.groupBy("filing_id", "share_class", "field").agg(F.max_by("value", "pos").alias("value"))


def detected_classes(facts: DataFrame) -> DataFrame:
    """The share classes that a filing's fees speak of, sorted (XB-21): filing_id, share_classes."""
    return fee_table(facts).groupBy("filing_id").agg(F.array_sort(F.collect_set("share_class")).alias("share_classes"))


def extraction_summary(facts: DataFrame) -> DataFrame:
    """What was read of a filing's fees (XB-23): filing_id, n_values, n_by_class, n_fund_level, n_classes."""
    rows = facts.withColumn("field", _mapped(taxonomy.TAG_FIELDS)).where(F.col("field").isin(*taxonomy.CLASS_FEES))
    own = F.col("share_class").isNotNull()
    return rows.groupBy("filing_id").agg(F.count("*").alias("n_values"), F.count_if(own).alias("n_by_class"), F.count_if(~own).alias("n_fund_level"), F.countDistinct("share_class").alias("n_classes"))


def class_value(fees: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class's value of each field, else the fund's (XB-22). classes: filing_id, share_class."""
    fund = fees.where("share_class is null").select("filing_id", "field", F.col("value").alias("fund_value"))
    own = fees.where("share_class is not null")
    grid = classes.join(fees.select("filing_id", "field").distinct(), "filing_id")
    return grid.join(own, ["filing_id", "share_class", "field"], "left").join(fund, ["filing_id", "field"], "left").select("filing_id", "share_class", "field", F.coalesce("value", "fund_value").alias("value")).where("value is not null")


# The flags of a cover page, by element name.
FLAGS = {
    "RegisteredClosedEndFundFlag": "registered",
    "BusinessDevelopmentCompanyFlag": "bdc",
    "IntervalFundFlag": "interval",
    "PrimaryShelfFlag": "primary_shelf",
    "PrimaryShelfQualifiedFlag": "primary_shelf_qualified",
    "NewCefOrBdcRegistrantFlag": "new_registrant",
}


def fund_type_flags(stream: DataFrame) -> DataFrame:
    """Cover page flags (XB-16), one column each: the first element of each name decides; checked by a mark or by its format. Absent flags are false."""
    name = F.regexp_extract(F.lower("name"), r"(?:^|:)([a-z]+)$", 1)
    rows = stream.where("kind = 'block'").withColumn("flag", F.create_map(*[F.lit(x) for k, v in FLAGS.items() for x in (k.lower(), v)])[name]).where("flag is not null")
    checked = F.col("text").rlike(r"☒|☑|\[[Xx]\]") | F.coalesce(F.contains(F.lower("format"), F.lit("fixed-true")), F.lit(False))
    firsts = rows.groupBy("filing_id", "flag").agg(F.min_by(checked, "pos").alias("on"))
    return firsts.groupBy("filing_id").agg(*[F.coalesce(F.max(F.when(F.col("flag") == f, F.col("on"))), F.lit(False)).alias(f) for f in FLAGS.values()])


def fund_type(flags: DataFrame) -> DataFrame:
    """bdc, interval_fund, tender_offer_fund or other, in that order of priority (XB-17)."""
    kind = F.when(F.col("bdc"), "bdc").when(F.col("interval"), "interval_fund").when(F.col("registered"), "tender_offer_fund").otherwise("other")
    return flags.select("filing_id", kind.alias("fund_type"))


def tag_coverage(facts: DataFrame, mapped: list[str]) -> DataFrame:
    """Which tags are mapped, seen or both (XB-27): tag, is_mapped, is_seen, n."""
    seen = facts.groupBy(F.regexp_replace("name", "^.*:", "").alias("tag")).agg(F.count("*").alias("n"))
    known = facts.sparkSession.createDataFrame([(t,) for t in mapped], "tag string").withColumn("m", F.lit(True))
    return seen.join(known, "tag", "full").select("tag", F.coalesce("m", F.lit(False)).alias("is_mapped"), F.col("n").isNotNull().alias("is_seen"), F.coalesce("n", F.lit(0)).alias("n"))
