"""One query per operator of the reference's families, each over whole tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import normalise as N
from ledgerloom.functions import predictor
from ledgerloom.functions import synonyms as Y
from ledgerloom.functions import text as T
from ledgerloom.functions.section_table import STANDARD_SECTIONS, TITLE_PATTERNS
from ledgerloom.functions.text import cik_key, quarter_label, token_of
from ledgerloom.operators import chunker
from ledgerloom.operators import decisions as D
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import examples, field_checks
from ledgerloom.operators import grounding as G
from ledgerloom.operators import holdings as H
from ledgerloom.operators import retrieval as R
from ledgerloom.operators import sections as S
from ledgerloom.operators import star
from ledgerloom.operators import wide as W
from ledgerloom.plans import data_sql, filing_program
from ledgerloom.sources import html_sections, taxonomy
from ledgerloom.sources import ixbrl
from ledgerloom.sources import quarters as Q
from ledgerloom.sources.tables import table
from ledgerloom.streaming import events
from ledgerloom.workspace import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


DEC = "decimal(18,2)"
_ONE_WORD = "map {" + ", ".join(f"'{k}': {float(v)}::double" for k, v in (T.NUMBER_WORDS | T.SCALE_WORDS | N.OTHER_NUMBER_WORDS).items()) + "}"

# ---------------------------------------------------------------- holdings


@query("""
with items as (select l_orderkey, l_partkey, l_returnflag, cast(l_extendedprice as decimal(18,2)) as amount from lineitem)
select c_custkey, o_orderkey, o_orderpriority, count(distinct l_partkey) as n_items,
  cast(sum(case when l_returnflag = 'A' then amount else 0 end) as double) as total_a,
  cast(sum(case when l_returnflag = 'N' then amount else 0 end) as double) as total_n,
  cast(sum(case when l_returnflag = 'R' then amount else 0 end) as double) as total_r
from customer join orders on c_custkey = o_custkey left join items on o_orderkey = l_orderkey group by all""")
def rel_quarter_summary(spark: SparkSession, d: str) -> DataFrame:
    """REL-14 on customers, orders and line items."""
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice").withColumn("amount", F.col("l_extendedprice").cast(DEC))
    return H.quarter_summary(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority"), items, ("c_custkey", "o_custkey", "o_orderkey", "l_orderkey"), ["c_custkey", "o_orderkey", "o_orderpriority"], "l_partkey", "l_returnflag", ["A", "N", "R"], "amount").withColumns({f"total_{x}": F.col(f"total_{x}").cast("double") for x in "anr"})


@query("""
select l_returnflag, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in
  (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1))) group by 1""")
def rel_semi_cascade(spark: SparkSession, d: str) -> DataFrame:
    """REL-01..05: line items of the orders of the customers of one region's nations."""
    nations = table(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_regionkey = 1")
    customers = H.only_keys(table(spark, d, "customer", "c_custkey", "c_nationkey"), nations.select("n_nationkey"), "c_nationkey")
    orders = H.only_keys(table(spark, d, "orders", "o_orderkey", "o_custkey"), customers.select("c_custkey"), "o_custkey")
    return H.only_keys(table(spark, d, "lineitem", "l_orderkey", "l_returnflag"), orders.select("o_orderkey"), "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select row_id from submissions s where exists (select 1 from funds f where ltrim(trim(f.cik), '0') = ltrim(trim(s.cik), '0'))")
def rel_cik_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """REL-01: leading zeros stripped on both sides."""
    return H.only_keys(table(spark, d, "submissions", "row_id", "cik"), table(spark, d, "funds", "cik"), "cik", H.without_leading_zeros).select("row_id")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def rel_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """SNK-16: what remains after a delete by a list of keys."""
    gone = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders", "o_orderkey").join(gone, "o_orderkey", "left_anti")


_CIK = data_sql._cik("cik")


@query(f"""
select k as cik, row_id, filing_date::varchar as filing_date from (select {_CIK} as k, * from submissions) where k is not null
qualify row_number() over (partition by k order by filing_date desc nulls last, row_id) = 1""")
def rel_latest_filing(spark: SparkSession, d: str) -> DataFrame:
    """REL-21: the latest filing per CIK."""
    df = table(spark, d, "submissions", "row_id", "cik", "filing_date").withColumn("cik", cik_key(F.col("cik"))).where("cik is not null")
    return H.first_by(df, ["cik"], [F.desc_nulls_last("filing_date"), F.col("row_id")]).withColumn("filing_date", F.col("filing_date").cast("string"))


@query(f"""
with n as (select {_CIK} as k, name, lei, created_at from funds),
o as (select k, name, lei from n where k is not null qualify row_number() over (partition by k order by created_at, name, lei nulls first) = 1),
l as (select k, name, lei from n where k is not null qualify row_number() over (partition by k order by created_at desc, name, lei nulls first) = 1)
select k as cik, l.name, coalesce(l.lei, o.lei) as lei from o join l using (k)""")
def rel_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SNK-18: first deliveries as the table, all deliveries merged in."""
    new = table(spark, d, "funds", "cik", "name", "lei", "created_at").withColumn("cik", cik_key(F.col("cik")))
    old = H.first_by(new.where("cik is not null"), ["cik"], [F.col("created_at"), F.col("name"), F.asc_nulls_first("lei")]).drop("created_at")
    return H.upsert(old, new, "cik", ["name"], ["lei"], [F.desc("created_at"), F.col("name"), F.asc_nulls_first("lei")])


@query("""
with c as (select o_custkey, max(o_orderdate) as have from orders where o_orderstatus = 'F' group by 1)
select case when have is null then 'new' when o_orderdate > have then 'updated' else 'skipped' end as status, count(*) as n
from orders left join c using (o_custkey) where o_orderstatus <> 'F' group by 1""")
def rel_incremental(spark: SparkSession, d: str) -> DataFrame:
    """REL-23: incoming rows as new, updated or skipped."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return H.newer_rows(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderdate").groupBy("status").agg(F.count("*").alias("n"))


@query("""
select row_id, cast(s as double) as gross_sales, cast(r as double) as gross_redemptions, cast(s - r as double) as net_flows from (select row_id,
  coalesce(sales_flow_mon1, 0) + coalesce(sales_flow_mon2, 0) + coalesce(sales_flow_mon3, 0) as s,
  coalesce(redemption_flow_mon1, 0) + coalesce(redemption_flow_mon2, 0) + coalesce(redemption_flow_mon3, 0) as r from fund_periods)""")
def rel_net_flows(spark: SparkSession, d: str) -> DataFrame:
    """REL-09."""
    cols = [f"{p}_flow_mon{i}" for p in ("sales", "redemption") for i in (1, 2, 3)]
    return H.net_flows(table(spark, d, "fund_periods", "row_id", *cols)).select("row_id", *[F.col(c).cast("double").alias(c) for c in ("gross_sales", "gross_redemptions", "net_flows")])


@query("select l_suppkey, count(*) as n from lineitem where l_suppkey is not null group by 1 order by n desc, 1 limit 10")
def rel_top_groups(spark: SparkSession, d: str) -> DataFrame:
    """REL-06: the ten largest groups."""
    return H.value_counts(table(spark, d, "lineitem", "l_suppkey"), "l_suppkey", 10)


@query("select fund_type, count(*) as n, count(distinct cik) as n_ciks, sum(case when lei is null then 1 else 0 end)::bigint as no_lei from funds group by 1")
def rel_null_groups(spark: SparkSession, d: str) -> DataFrame:
    """REL-15: groups with the null one kept, distinct and conditional counts."""
    return table(spark, d, "funds", "fund_type", "cik", "lei").groupBy("fund_type").agg(F.count("*").alias("n"), F.countDistinct("cik").alias("n_ciks"), F.count_if(F.col("lei").isNull()).alias("no_lei"))


@query("select extraction_id as id, try_cast(trim(lock_up_period_days) as double) as days from repurchase_terms")
def rel_coerced(spark: SparkSession, d: str) -> DataFrame:
    """REL-10, REL-11: rename what exists, bad numbers as null."""
    df = H.rename_existing(table(spark, d, "repurchase_terms"), {"extraction_id": "id", "lock_up_period_days": "days", "no_such_column": "x"})
    return H.coerced(df, ["days"])


@query(f"""
select {data_sql._QUARTER} as quarter, count(*) as n, min(report_date)::varchar as first_report, max(report_date)::varchar as last_report, cast(sum(net_assets) as double) as net_assets
from fund_periods group by 1""")
def rel_quarter_counts(spark: SparkSession, d: str) -> DataFrame:
    """REL-15: rows, range and sum per quarter, in whatever spelling."""
    df = table(spark, d, "fund_periods", "quarter", "report_date", "net_assets").withColumn("quarter", F.coalesce(quarter_label(F.col("quarter")), F.lit("unknown")))
    return df.groupBy("quarter").agg(F.count("*").alias("n"), F.min("report_date").cast("string").alias("first_report"), F.max("report_date").cast("string").alias("last_report"), F.sum("net_assets").cast("double").alias("net_assets"))


@query("select fund_type as kind, array_to_string(list_sort(list(distinct cik)), ',') as ciks from funds where fund_type is not null and cik is not null group by 1")
def rel_inverted_lists(spark: SparkSession, d: str) -> DataFrame:
    """REL-26: keys by type."""
    df = table(spark, d, "funds", "fund_type", "cik").where("fund_type is not null and cik is not null")
    return df.groupBy(F.col("fund_type").alias("kind")).agg(F.array_join(F.array_sort(F.collect_set("cik")), ",").alias("ciks"))


@query("select strftime(q, '%Y') || 'q' || quarter(q) as quarter from (select unnest(generate_series(date '2019-10-01', date '2025-04-01', interval 3 month))::date as q)")
def src_quarters(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07: quarters up to the last complete one at a date."""
    return Q.available_quarters(spark, date(2025, 8, 15))


def _holdings(spark: SparkSession, d: str) -> DataFrame:
    """Holdings made of fund_periods: up to four a filing, of three levels, every other one restricted, the first of them twice."""
    rows = table(spark, d, "fund_periods", "row_id", "accession_number").select("row_id", "accession_number", F.explode(F.expr("sequence(0, cast(row_id % 4 as int))")).alias("i"))
    held = rows.select("accession_number", (F.col("row_id") * 10 + F.greatest("i", F.lit(1))).alias("holding_id"), (F.col("row_id") + F.col("i")).cast("decimal(18,2)").alias("currency_value"), (F.col("i") % 3 + 1).cast("string").alias("fair_value_level"), F.when(F.col("i") % 2 == 1, "Y").otherwise("N").alias("is_restricted_security"))
    return held


@query("""
with f as (select cik, min(name) as fund_name, arg_min(fund_type, coalesce(name, '')) as fund_type from funds where cik is not null and name is not null group by 1 having count(distinct coalesce(fund_type, '')) = 1),
p as (select cik, quarter, report_date, net_assets, accession_number, (coalesce(sales_flow_mon1, 0) + coalesce(sales_flow_mon2, 0) + coalesce(sales_flow_mon3, 0))::decimal(18,2) as gross_sales, (coalesce(redemption_flow_mon1, 0) + coalesce(redemption_flow_mon2, 0) + coalesce(redemption_flow_mon3, 0))::decimal(18,2) as gross_redemptions from fund_periods),
h as (select accession_number, row_id * 10 + greatest(i, 1) as holding_id, (row_id + i)::decimal(18,2) as v, i % 3 + 1 as l, i % 2 = 1 as restricted from (select row_id, accession_number, unnest(range(0, (row_id % 4 + 1)::bigint)) as i from fund_periods))
select p.cik, fund_name, fund_type, quarter, report_date, net_assets, gross_sales, gross_redemptions, (gross_sales - gross_redemptions)::decimal(18,2) as net_flows, count(distinct holding_id) as holdings_count,
  coalesce(sum(v) filter (where l = 1), 0)::decimal(28,2) as level1_value, coalesce(sum(v) filter (where l = 2), 0)::decimal(28,2) as level2_value, coalesce(sum(v) filter (where l = 3), 0)::decimal(28,2) as level3_value, coalesce(sum(v) filter (where restricted), 0)::decimal(28,2) as restricted_value
from p join f on f.cik = p.cik left join h on h.accession_number = p.accession_number group by all""")
def rel_fund_quarters(spark: SparkSession, d: str) -> DataFrame:
    """REL-14: the quarterly summary of funds (those of one type), periods and holdings."""
    funds = table(spark, d, "funds", "cik", "name", "fund_type").where("name is not null and cik is not null")
    one_type = funds.groupBy("cik").agg(F.countDistinct(F.coalesce("fund_type", F.lit(""))).alias("n")).where("n = 1").select("cik")
    periods = H.net_flows(table(spark, d, "fund_periods")).withColumns({c: F.col(c).cast(DEC) for c in ("gross_sales", "gross_redemptions", "net_flows")})
    return star.fund_quarter_summary(funds.join(one_type, "cik", "left_semi"), periods, _holdings(spark, d))


# ---------------------------------------------------------------- retrieval


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "chunk_id", "filing_id", "section_id", "chunk_index", "section_title", "content")


def _score_sql(field: str) -> str:
    terms = R.LEXICON[field]
    hit = " + ".join(f"case when contains(t, '{x}') then {w} else 0 end" for w, ts in terms.items() for x in ts)
    title = " or ".join(f"contains(h, '{x}')" for w, ts in terms.items() if w > 1 for x in ts)
    return f"({hit} + case when {title} then 5 else 0 end - case when length(content) > 50000 then 10 else 0 end)"


_SCORED = "(select chunk_id, filing_id, chunk_index, unnest([" + ", ".join(f"{{'field': '{f}', 'score': {_score_sql(f)}}}" for f in R.LEXICON) + "], recursive := true) from (select *, lower(coalesce(content, '')) as t, lower(coalesce(section_title, '')) as h from chunks))"


@query(f"select chunk_id, field, score::int as score from {_SCORED}")
def rt_scores(spark: SparkSession, d: str) -> DataFrame:
    """RT-01, RT-07."""
    return R.score_sections(_chunks(spark, d), R.LEXICON).select("chunk_id", "field", F.col("score").cast("int").alias("score"))


_ORDER = "score desc, chunk_index, chunk_id"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return R.score_sections(_chunks(spark, d), R.LEXICON).select("chunk_id", "filing_id", "chunk_index", "field", "score")


@query(f"select filing_id, field, chunk_id, row_number() over (partition by filing_id, field order by {_ORDER})::int as rank from {_SCORED} where score > 0 qualify rank <= 3")
def rt_top_chunks(spark: SparkSession, d: str) -> DataFrame:
    """RT-02, RT-08: the three best chunks per filing and field."""
    return R.top_k(_scored(spark, d).where("score > 0"), ["filing_id", "field"], [F.desc("score"), F.col("chunk_index"), F.col("chunk_id")], 3).select("filing_id", "field", "chunk_id", "rank")


@query(f"""
select filing_id, field, chunk_id, rank from (select *, row_number() over (partition by filing_id, field order by {_ORDER})::int as rank,
  sum(case when score > 0 then 1 else 0 end) over (partition by filing_id, field) as hits from {_SCORED})
where rank <= case when hits < 2 then 4 else least(hits, 4) end""")
def rt_padded(spark: SparkSession, d: str) -> DataFrame:
    """RT-03: the best chunks, filled up where too few match."""
    return R.padded_top(_scored(spark, d).withColumn("pos", F.struct("chunk_index", "chunk_id")), ["filing_id", "field"], "score", F.col("pos"), 4, 2).select("filing_id", "field", "chunk_id", "rank")


@query("""
select cik, n, case when n > 2000 then 20 when n > 1000 then 15 when n > 500 then 10 else 5 end::int as top_k, case when n > 2000 then 15 when n > 1000 then 12 else 10 end::int as chunks_per_section,
  case when n > 2000 then 400 when n > 1000 then 300 when n > 500 then 200 else 50 end::int as first_pass, case when n > 2000 then 25 when n > 1000 then 20 when n > 500 then 15 else 10 end::int as reranked
from (select cik, count(*) as n from documents group by 1)""")
def rt_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """RT-04."""
    n = table(spark, d, "documents", "cik").groupBy("cik").agg(F.count("*").alias("n"))
    return n.select("cik", "n", R.adaptive_settings(F.col("n")).alias("s")).select("cik", "n", "s.*")


_RANKED = f"(select filing_id, field, chunk_id, row_number() over (partition by filing_id, field order by {_ORDER}) as rank from {_SCORED} where score > 0 qualify rank <= 10)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(_scored(spark, d).where("score > 0"), ["filing_id", "field"], [F.desc("score"), F.col("chunk_index"), F.col("chunk_id")], 10)


@query(f"""
with k as ({_RANKED}), a as (select * from k where field = 'repurchase'), b as (select * from k where field = 'fees')
select filing_id, chunk_id, round(1.0 / (60 + coalesce(a.rank, 1000)) + 1.0 / (60 + coalesce(b.rank, 1000)), 9)::double as rrf,
  case when a.rank is null then 'right_only' when b.rank is null then 'left_only' else 'both' end as found_by
from a full join b using (filing_id, chunk_id)""".replace("1.0 /", "1.0::double /"))
def rt_fuse_two(spark: SparkSession, d: str) -> DataFrame:
    """RT-10: two ranked lists fused with a penalty for what one lacks."""
    ranked = _ranked(spark, d)
    return R.fuse_two(ranked.where("field = 'repurchase'"), ranked.where("field = 'fees'"), ["filing_id", "chunk_id"]).select("filing_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "found_by")


@query(f"select filing_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as rrf, count(*) as n_queries, min(rank)::int as best_rank from {_RANKED} group by 1, 2")
def rt_fuse_many(spark: SparkSession, d: str) -> DataFrame:
    """RT-24, RT-28: fusion over any number of queries."""
    return R.fuse_many(_ranked(spark, d), ["filing_id", "chunk_id"], "field").withColumn("rrf", F.round("rrf", 9))


@query("""
with v as (select vec_id, embedding::double[] as e from embeddings where len(embedding) > 0),
s as (select q.vec_id as query_id, r.vec_id, round(list_inner_product(q.e, r.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(r.e, r.e)), 6) as score
  from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s qualify rank <= 10""")
def rt_dense_top(spark: SparkSession, d: str) -> DataFrame:
    """RT-15, RT-32: the ten nearest of all rows for every query row (ids divisible by 20)."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return R.dense_top_k(v, v.where("vec_id % 20 = 0"), 10)


_DENSE = SQL["rt_dense_top"]


@query(f"""
with t as (select doc_id, label, (contains(x, 'repurchase')::int + contains(x, 'offer')::int) * case when contains(x, 'repurchase offer') then 5 else 1 end as score from (select doc_id, lower(coalesce(text, '')) as x from documents) join embeddings on vec_id = doc_id),
k as (select label, doc_id, row_number() over (partition by label order by score desc, doc_id) as rank from t where score > 0 qualify rank <= 10),
a as (select vec_id as query_id, k.doc_id, k.rank from embeddings join k using (label) where vec_id % 20 = 0),
b as (select query_id, vec_id as doc_id, rank from ({_DENSE}))
select query_id, doc_id, round(1.0::double / (60 + coalesce(a.rank, 1000)) + 1.0::double / (60 + coalesce(b.rank, 1000)), 9) as rrf, case when a.rank is null then 'right_only' when b.rank is null then 'left_only' else 'both' end as found_by
from a full join b using (query_id, doc_id)""")
def rt_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """RT-12, RT-27: a keyword list of the query's label and the dense list of every query row, fused."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    scored = _docs(spark, d).withColumn("score", R.query_score(F.col("text"), "repurchase offer")).join(v.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").where("score > 0")
    best = R.top_k(scored.select("label", "doc_id", "score"), ["label"], [F.desc("score"), F.col("doc_id")], 10)
    queries = v.where("vec_id % 20 = 0")
    keyword = queries.select(F.col("vec_id").alias("query_id"), "label").join(best, "label").select("query_id", "doc_id", "rank")
    dense = R.dense_top_k(v.select("vec_id", "embedding"), queries.select("vec_id", "embedding"), 10).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return R.fuse_two(keyword, dense, ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "found_by")


@query("""
with c as (select label, list_transform(range(1, 65), lambda i: avg_at[i]) as m from (select label, [""" + ", ".join(f"round(avg(embedding[{i}]::double), 4)" for i in range(1, 65)) + """] as avg_at from embeddings group by label)),
d as (select vec_id, c.label as cluster, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - m[i]) * (embedding[i]::double - m[i]))), 6) as distance from embeddings, c)
select vec_id, cluster::int as cluster, distance from d qualify row_number() over (partition by vec_id order by distance, cluster) = 1""")
def rt_centroids(spark: SparkSession, d: str) -> DataFrame:
    """CH-22: each vector's nearest of all labels' means."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    means = v.groupBy("label").agg(F.array(*[F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 4) for i in range(64)]).alias("m"))
    return R.nearest_mean(v, materialise(means, "means"), "label", "m").select("vec_id", "cluster", "distance")


@query("""
select chunk_id, running from (select chunk_id, sum(coalesce(length(content), 0)) over (partition by filing_id order by section_id, chunk_index, chunk_id rows unbounded preceding)::bigint as running from chunks)
where running <= 4000""")
def rt_pack(spark: SparkSession, d: str) -> DataFrame:
    """RT-43, RT-45: the leading chunks within a budget."""
    df = _chunks(spark, d).withColumn("n", F.coalesce(F.char_length("content"), F.lit(0)).cast("bigint"))
    return R.pack_within(df, ["filing_id"], [F.col("section_id"), F.col("chunk_index"), F.col("chunk_id")], "n", 4000).select("chunk_id", "running")


@query("""
select chunk_id from (select chunk_id, max(case when contains(lower(coalesce(content, '')), 'borrow') then 1 else 0 end)
  over (partition by section_id order by chunk_index range between 2 preceding and 1 following) as near from chunks) where near = 1""")
def rt_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """RT-33: chunks with a wanted one, one before and two after it."""
    wanted = F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit("borrow"))
    return R.neighbours(_chunks(spark, d), ["section_id"], "chunk_index", wanted, 1, 2).select("chunk_id")


@query("""
select section_id, min(i)::int as first, max(i)::int as last, count(*) as n from (select section_id, i, i - row_number() over (partition by section_id order by i) as run
  from (select distinct section_id, chunk_index as i from chunks where content is not null)) group by section_id, run""")
def rt_islands(spark: SparkSession, d: str) -> DataFrame:
    """SEG-23: runs of neighbouring chunks that have content."""
    df = _chunks(spark, d).where("content is not null").select("section_id", "chunk_index").distinct()
    return R.islands(df, ["section_id"], "chunk_index")


@query(r"""
select chunk_id, len(h)::int as n_hits, array_to_string(h[1:5], ';') as shown from (select chunk_id, regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?%') as h from chunks) where len(h) > 0""")
def rt_regex(spark: SparkSession, d: str) -> DataFrame:
    """RT-31."""
    return R.regex_hits(_chunks(spark, d), r"[0-9]+(?:\.[0-9]+)?%").select("chunk_id", "n_hits", F.array_join("shown", ";").alias("shown"))


@query("select filing_id, section_id, count(*) as n_chunks, min(chunk_index) as first, max(chunk_index) as last from chunks group by 1, 2")
def rt_structure(spark: SparkSession, d: str) -> DataFrame:
    """RT-34."""
    return R.structure(_chunks(spark, d), ["filing_id", "section_id"], "chunk_index")


# ---------------------------------------------------------------- sections and chunks


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", *more)


_SP = r"[ \t\n\x0b\f\r]"


@query(rf"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '{_SP}+', ' ', 'g'), ' ')) as h from documents""")
def seg_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """XB-14."""
    return _docs(spark, d).select("doc_id", F.md5(S.strip_markup(F.col("text"))).alias("h"))


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ')) as h from documents")
def seg_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """SEG-27."""
    return _docs(spark, d).select("doc_id", F.md5(S.clean_text(F.col("text"))).alias("h"))


_HEADING = r"^(?:[A-Z][A-Z &,-]{3,60}|(?:[A-Z][a-z]+)(?: (?:and|of|the|for|[A-Z][a-z]+)){1,6})$"


@query(rf"""
with lines as (select doc_id, length(text) as n, unnest(string_split(text, chr(10))) as title, unnest(range(len(string_split(text, chr(10))))) as line from documents where text is not null),
placed as (select *, coalesce(sum(length(title) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as s from lines),
h as (select *, row_number() over (partition by doc_id order by line) as ord, coalesce(lead(s) over (partition by doc_id order by line), n) as e from placed where regexp_full_match(title, '{_HEADING[1:-1]}'))
select doc_id, ord::int as ord, title, s::int as char_start, (e - s)::int as n_chars from h where e - s >= 100""")
def seg_headings(spark: SparkSession, d: str) -> DataFrame:
    """SEG-09, SEG-15: from heading to heading."""
    return S.heading_sections(_docs(spark, d))


@query("""
with k as (select *, nullif(regexp_replace(lower(section_title), '[^a-z]+', '', 'g'), '') as title_key from chunks)
select filing_id, title_key, arg_min(section_title, chunk_id) as title, md5(coalesce(string_agg(content, chr(10) || chr(10) order by chunk_id), '')) as h, count(*) as n_parts
from k where title_key is not null group by 1, 2""")
def seg_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """SEG-06, SEG-07."""
    out = S.consolidate(_chunks(spark, d), ["filing_id"], "section_title", "chunk_id", "content")
    return out.select("filing_id", "title_key", "title", F.md5("text").alias("h"), "n_parts")


_KEY = "nullif(regexp_replace(lower(section_title), '[^a-z]+', '', 'g'), '')"


@query(f"""
with k as (select chunk_id, filing_id, chunk_index, {_KEY} as t from chunks), a as (select * from k where chunk_index = 0), b as (select * from k where chunk_index > 0)
select chunk_id from a union all select chunk_id from b where not exists (select 1 from a where a.filing_id = b.filing_id and (contains(a.t, b.t) or contains(b.t, a.t)))""")
def seg_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """SEG-01, SEG-03: sections of a lower source only where no higher one has the title."""
    df = _chunks(spark, d).select("chunk_id", "filing_id", "chunk_index", "section_title")
    return S.by_priority([df.where("chunk_index = 0"), df.where("chunk_index > 0")], ["filing_id"], "section_title").select("chunk_id")


@query("""
select doc_id, idx::int as idx, (idx * 800)::int as char_start, md5(substring(text, idx * 800 + 1, 1000)) as h
from (select *, unnest(range(greatest(0, ceil((length(text) - 1000) / 800.0)::bigint) + 1)) as idx from documents where length(text) > 0)""")
def ch_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    """CH-01 in closed form."""
    return S.fixed_windows(_docs(spark, d), 1000, 200).select("doc_id", F.col("idx").cast("int").alias("idx"), F.col("char_start").cast("int").alias("char_start"), F.md5("window").alias("h"))


@query("select chunk_id, right(lag(content) over (partition by section_id order by chunk_index nulls first, chunk_id), 100) as preceding_context from chunks")
def ch_context(spark: SparkSession, d: str) -> DataFrame:
    """CH-09."""
    df = _chunks(spark, d).withColumn("ord", F.struct("chunk_index", "chunk_id"))
    return S.with_context(df, ["section_id"], "ord", "content", 100).select("chunk_id", "preceding_context")


@query("select chunk_id, substring(md5(concat_ws(':', section_id, chunk_index::varchar, substring(content, 1, 50))), 1, 16) as own_id, md5(content) as content_hash from chunks")
def ch_ids(spark: SparkSession, d: str) -> DataFrame:
    """CH-09, CH-25."""
    own, h = S.chunk_ids(F.col("section_id"), F.col("chunk_index"), F.col("content"))
    return _chunks(spark, d).select("chunk_id", own.alias("own_id"), h.alias("content_hash"))


@query(r"""
with p as (select doc_id, unnest(range(len(l))) as pos, trim(unnest(l), ' ') as para from (select doc_id, regexp_split_to_array(text, '\n\n+') as l from documents where text is not null)),
g as (select *, coalesce(sum(case when length(para) >= 300 then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as grp from p where para <> '')
select doc_id, grp::bigint as "group", count(*) as n_paragraphs, md5(string_agg(para, chr(10) || chr(10) order by pos)) as h from g group by 1, 2""")
def ch_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """CH-14."""
    return S.pack_paragraphs(_docs(spark, d), "doc_id", "text", 300).select("doc_id", "group", "n_paragraphs", F.md5("text").alias("h"))


@query("\nunion all\n".join(rf"select '{k}' as kind, v as value, count(*) as n from (select unnest(regexp_extract_all(text, '{p}')) as v from documents) group by all" for k, p in S.ENTITY_PATTERNS.items()))
def ch_entities(spark: SparkSession, d: str) -> DataFrame:
    """CH-19, counted."""
    return S.entities(_docs(spark, d), ["doc_id"], "text").groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("select md5(text) as h, min(doc_id) as doc_id, count(*) as n from documents where text is not null group by 1")
def ch_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies by content hash, each class with its first document."""
    return _docs(spark, d).where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


# ---------------------------------------------------------------- scalars


@query(r"""
select extraction_id, try_cast(trim(regexp_replace(case when lower(trim(max_leverage_pct)) in """ + data_sql._NULLS + r""" then null else max_leverage_pct end, '%', '', 'g')) as double) as pct from leverage_limits""")
def sc_percent(spark: SparkSession, d: str) -> DataFrame:
    """SC-29."""
    return table(spark, d, "leverage_limits", "extraction_id", "max_leverage_pct").select("extraction_id", N.percent_text(F.col("max_leverage_pct")).try_cast("double").alias("pct"))


def _mapped_sql(c: str, synonyms: dict[str, str]) -> str:
    low = f"replace(lower(trim({c})), '_', ' ')"
    return f"coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in synonyms.items())}}}[{low}], case " + " ".join(f"when contains({low}, '{k}') then '{v}'" for k, v in synonyms.items()) + f" else {c} end)"


@query(f"select extraction_id, {_mapped_sql('repurchase_frequency', Y.REPURCHASE_FREQUENCY)} as repurchase, {_mapped_sql('repurchase_frequency', Y.DISTRIBUTION_FREQUENCY)} as distribution, {_mapped_sql('repurchase_frequency', Y.HURDLE_FREQUENCY)} as hurdle from repurchase_terms")
def sc_frequency(spark: SparkSession, d: str) -> DataFrame:
    """SC-22: a frequency as each kind of field has it."""
    c = F.col("repurchase_frequency")
    return table(spark, d, "repurchase_terms", "extraction_id", "repurchase_frequency").select("extraction_id", N.mapped(c, Y.REPURCHASE_FREQUENCY).alias("repurchase"), N.mapped(c, Y.DISTRIBUTION_FREQUENCY).alias("distribution"), N.mapped(c, Y.HURDLE_FREQUENCY).alias("hurdle"))


@query(f"select extraction_id, {_mapped_sql('leverage_basis', Y.LEVERAGE_BASIS)} as leverage, {_mapped_sql('leverage_basis', Y.REPURCHASE_BASIS)} as repurchase from leverage_limits")
def sc_basis(spark: SparkSession, d: str) -> DataFrame:
    """SC-20, SC-21: a basis as each kind of field has it."""
    c = F.col("leverage_basis")
    return table(spark, d, "leverage_limits", "extraction_id", "leverage_basis").select("extraction_id", N.mapped(c, Y.LEVERAGE_BASIS).alias("leverage"), N.mapped(c, Y.REPURCHASE_BASIS).alias("repurchase"))


@query(r"""
select extraction_id, round(case when q then 4 * p else p end, 4) as annual, round(case when q then p else p / 4 end, 4) as quarterly
from (select extraction_id, repurchase_percentage_max as p, contains(lower(coalesce(repurchase_frequency, '')), 'quarter') as q from repurchase_terms)""")
def sc_rates(spark: SparkSession, d: str) -> DataFrame:
    """SC-30."""
    r = N.frequency_rates(F.col("repurchase_percentage_max"), F.col("repurchase_frequency"))
    return table(spark, d, "repurchase_terms", "extraction_id", "repurchase_percentage_max", "repurchase_frequency").select("extraction_id", r["annual"].alias("annual"), r["quarterly"].alias("quarterly"))


@query(rf"select chunk_id, regexp_replace(trim(regexp_replace(lower(section_title), '[^a-z0-9 \t\n\x0b\f\r]', '', 'g')), '{_SP}+', '_', 'g') as slug from chunks")
def sc_slug(spark: SparkSession, d: str) -> DataFrame:
    """SC-55."""
    return _chunks(spark, d).select("chunk_id", N.section_slug(F.col("section_title")).alias("slug"))


@query("select event_id, json_extract_string(props, '$.k')::int as k from events")
def sc_json_path(spark: SparkSession, d: str) -> DataFrame:
    """SC-11."""
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("select cik, name, regexp_replace(lower(trim(fund_type)), '[ _-]+', '_', 'g') as fund_type from funds")
def sc_token(spark: SparkSession, d: str) -> DataFrame:
    """SC-03: spellings of a category as one token."""
    return table(spark, d, "funds", "cik", "name", "fund_type").withColumn("fund_type", token_of(F.col("fund_type")))


# ---------------------------------------------------------------- grounding


@query(r"""
with t as (select extraction_id, '  ' || lower(citation) || '  ' as c, repurchase_percentage_max as x from repurchase_terms),
f as (select *, regexp_replace(printf('%.4f', x), '\.?0+$', '') as p, printf('%.2f', x) as two from t)
select extraction_id, coalesce(regexp_matches(c, '(?:[^0-9.,]|[^0-9][.,])(?:' || replace(p, '.', '\.') || '|' || replace(two, '.', '\.') || ')(?:[^0-9.,]|[.,][^0-9])'), false) as found from f""")
def gr_number(spark: SparkSession, d: str) -> DataFrame:
    """GR-03: a percentage in its citation, as a number of its own."""
    return table(spark, d, "repurchase_terms", "extraction_id", "citation", "repurchase_percentage_max").select("extraction_id", G.number_in_text(F.col("repurchase_percentage_max"), F.col("citation")).alias("found"))


_FLAT = lambda c: rf"lower(trim(regexp_replace({c}, '{_SP}+', ' ', 'g')))"


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Citations beside the chunks of their filing."""
    quotes = table(spark, d, "repurchase_terms", "extraction_id", "filing_id", "citation").where("citation is not null")
    return quotes.join(table(spark, d, "chunks", "filing_id", "chunk_id", "content"), "filing_id")


@query(f"""
select extraction_id, chunk_id, coalesce(case when length(citation) < 20 then contains(lower(content), lower(citation)) else contains({_FLAT("content")}, {_FLAT("citation")}) end, false) as found
from repurchase_terms join chunks using (filing_id) where citation is not null""")
def gr_quote(spark: SparkSession, d: str) -> DataFrame:
    """GR-04: a citation in the chunks of its filing."""
    return _cited(spark, d).select("extraction_id", "chunk_id", G.quote_in_text(F.col("citation"), F.col("content")).alias("found"))


@query(f"""
with q as (select extraction_id, filing_id, lower(citation) as low, string_split({_FLAT("citation")}, ' ') as w from repurchase_terms where citation is not null)
select extraction_id, chunk_id, coalesce(case when len(w) < 3 then contains({_FLAT("content")}, low) else list_bool_or(list_transform(range(1, len(w) - 1), lambda i: contains({_FLAT("content")}, array_to_string(w[i : i + 2], ' ')))) end, false) as found
from q join chunks using (filing_id)""")
def gr_partial_quote(spark: SparkSession, d: str) -> DataFrame:
    """GR-05 with runs of three words."""
    return G.partial_quotes(_cited(spark, d), "citation", "content", 3).select("extraction_id", "chunk_id", "found")


@query(f"""
with q as (select extraction_id, filing_id, {_FLAT("citation")} as t, list_filter(string_split({_FLAT("citation")}, ' '), lambda x: length(x) > 3) as w from repurchase_terms where citation is not null)
select extraction_id, chunk_id, coalesce(contains({_FLAT("content")}, t) or (len(w) >= 2 and 2 * len(list_filter(w, lambda x: contains({_FLAT("content")}, x))) >= len(w)), false) as found
from q join chunks using (filing_id)""")
def gr_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """GR-06."""
    return G.fuzzy_terms(_cited(spark, d), "citation", "content").select("extraction_id", "chunk_id", "found")


@query("""
with s as (select extraction_id, case lower(confidence) when 'explicit' then 1.0 when 'inferred' then 0.4 when 'not_found' then 0.0 end::double as a, case when citation is null then null when length(citation) > 60 then 1.0 else 0.5 end::double as b from leverage_limits),
c as (select *, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0)) / nullif(case when a is not null then 0.5 else 0 end + case when b is not null then 0.3 else 0 end, 0), 6)::double as confidence from s)
select extraction_id, confidence, case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as level from c""")
def gr_confidence(spark: SparkSession, d: str) -> DataFrame:
    """GR-23, GR-29: the weighted mean of the signals there are."""
    said = F.lower("confidence")
    a = F.when(said == "explicit", 1.0).when(said == "inferred", 0.4).when(said == "not_found", 0.0)
    b = F.when(F.char_length("citation") > 60, 1.0).when(F.col("citation").isNotNull(), 0.5)
    c = F.round(G.weighted_confidence([(a, 0.5), (b, 0.3)]), 6)
    return table(spark, d, "leverage_limits", "extraction_id", "confidence", "citation").select("extraction_id", c.alias("confidence")).withColumn("level", G.level(F.col("confidence")))


@query("""
select extraction_id, case when s = 'interval_fund' then case when contains(c, 'interval') then 'verified' else 'unverified' end when s = 'tender_offer_fund' then case when contains(c, 'tender') then 'verified' else 'unverified' end end as status
from (select extraction_id, lower(trim(fund_structure)) as s, lower(coalesce(citation, '')) as c from repurchase_terms)""")
def gr_structure(spark: SparkSession, d: str) -> DataFrame:
    """GR-07: the structure of a fund against the words of its citation."""
    rows = table(spark, d, "repurchase_terms", "extraction_id", "fund_structure", "citation")
    values = rows.select("extraction_id", F.lit("repurchase_terms").alias("field_group"), F.lit("fund_structure").alias("field"), F.col("fund_structure").alias("value"), F.col("citation").alias("source"))
    return field_checks.check_fields(values).select("extraction_id", "status")


@query("""
select doc_id, case when contains(t, 'interval fund') or contains(t, 'rule 23c-3') then 'interval_fund' when contains(t, 'tender offer') then 'tender_offer_fund' else 'unknown' end as fund_structure,
  contains(t, 'underlying fund') or contains(t, 'acquired fund') or contains(t, 'affe') as is_fund_of_funds, contains(t, 'no limit') or contains(t, 'no restriction') or contains(t, 'unlimited') as has_no_limit_language,
  regexp_matches(t, '[1-9]%|[1-9][0-9]%') as has_explicit_percentages from (select doc_id, lower(coalesce(text, '')) as t from documents)""")
def rt_characteristics(spark: SparkSession, d: str) -> DataFrame:
    """RT-49."""
    return _docs(spark, d).select("doc_id", examples.characteristics(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"""
select method, count(*) filter (where c = 'explicit') as n_explicit, count(*) filter (where c = 'inferred') as n_inferred, count(*) filter (where c = 'not_found') as n_not_found
from (select method, case when confidence is null or lower(trim(confidence)) in {data_sql._NULLS} then 'not_found' else lower(trim(confidence)) end as c from leverage_limits) group by 1""")
def sc_confidence(spark: SparkSession, d: str) -> DataFrame:
    """SC-19."""
    return D.count_confidence(table(spark, d, "leverage_limits", "method", "confidence"), ["method"])


@query(rf"""
with v as (select extraction_id, trim(max_leverage_pct) as v from leverage_limits where max_leverage_pct is not null and lower(trim(max_leverage_pct)) not in {data_sql._NULLS}),
w as (select *, string_split_regex(lower(v), '[ -]+') as p, regexp_replace(regexp_replace(v, '^[$€£] *', ''), ' *dollars?$', '', 'i') as b from v),
x as (select *, case when regexp_matches(b, '(million|mm|m)$', 'i') then 1e6 when regexp_matches(b, '(billion|b)$', 'i') then 1e9 when regexp_matches(b, '(thousand|k)$', 'i') then 1e3 else 1 end as f,
  trim(replace(replace(regexp_replace(b, ' *(million|mm|m|billion|b|thousand|k)$', ''), ',', ''), '%', '')) as c from w),
y as (select *, coalesce(nullif(regexp_extract(c, '^([0-9.]+)( *[-–—] *| +to +)[0-9.]+', 1), ''), c) as n from x)
select extraction_id, coalesce({_ONE_WORD}[lower(v)], case when len(p) = 2 and {_ONE_WORD}[p[1]] between 20 and 99 and {_ONE_WORD}[p[2]] < 10 then {_ONE_WORD}[p[1]] + {_ONE_WORD}[p[2]] when len(p) = 2 and {_ONE_WORD}[p[2]] in (100, 1000, 1e6, 1e9) then {_ONE_WORD}[p[1]] * {_ONE_WORD}[p[2]] end,
  case when regexp_full_match(n, '[+-]?([0-9]+|[0-9]+[.][0-9]*|[.][0-9]+)') then n::double end * f, try_cast(replace(nullif(regexp_extract(v, '([0-9,]+[.]?[0-9]*)', 1), ''), ',', '') as double) * f) as number from y
union all select extraction_id, null from leverage_limits where max_leverage_pct is null or lower(trim(max_leverage_pct)) in {data_sql._NULLS}""")
def sc_numeric(spark: SparkSession, d: str) -> DataFrame:
    """SC-01, SC-02 on limits as extracted."""
    return table(spark, d, "leverage_limits", "extraction_id", "max_leverage_pct").select("extraction_id", N.numeric_text(F.col("max_leverage_pct")).alias("number"))


# ---------------------------------------------------------------- decisions, rules, logs

_FIELDS = ["repurchase_percentage_min", "repurchase_percentage_max", "notice_period_days", "early_repurchase_fee_pct"]


def _method(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = table(spark, d, "repurchase_terms", "extraction_id", "filing_id", "method", "loaded_at", *_FIELDS).where(F.col("method") == name)
    last = H.first_by(df, ["filing_id"], [F.desc("loaded_at"), F.col("extraction_id")])
    return D.to_fields(last, ["filing_id"], _FIELDS)


def _method_sql(name: str) -> str:
    cells = ", ".join(f"{{'field_path': '{f}', 'value': {f}::double}}" for f in _FIELDS)
    return f"(select filing_id, unnest([{cells}], recursive := true) from (select * from repurchase_terms where method = '{name}' qualify row_number() over (partition by filing_id order by loaded_at desc, extraction_id) = 1))"


@query(f"""
select filing_id, field_path, case when a.value is null and b.value is null then 'both_null' when b.value is null then 'left_only' when a.value is null then 'right_only' when abs(a.value - b.value) <= 0.001 then 'agree' else 'disagree' end as reason,
  coalesce(a.value, b.value) as final_value
from {_method_sql("tier3_docvqa")} a full join {_method_sql("tier4_agentic")} b using (filing_id, field_path)""")
def en_decide(spark: SparkSession, d: str) -> DataFrame:
    """EN-01, EN-02: two methods side by side."""
    both = D.decide(D.align(_method(spark, d, "tier3_docvqa"), _method(spark, d, "tier4_agentic"), ["filing_id", "field_path"]))
    return both.select("filing_id", "field_path", "reason", F.col("final_value").cast("double").alias("final_value"))


@query("""
select gt_row_id, case when starts_with(f, 'has_') or ends_with(f, '_policy') or ends_with(f, '_basis') or contains(f, 'fund_type') or starts_with(f, 'default_') then 't3_k10'
  when starts_with(f, 'share_classes.*minimum') or ends_with(f, 'expense_cap_pct') or contains(f, 'distribution_frequency') or contains(f, 'leverage_basis') then 'reranker' else 't3_k10' end as method,
  case when field_path in """ + str(D.FIRST_PREFERRED) + """ or contains(field_path, 'distribution_fee_pct') then 'left' when field_path in """ + str(D.SECOND_PREFERRED) + """ then 'right' end as side
from (select gt_row_id, field_path, lower(field_path) as f from expected_fields)""")
def en_methods(spark: SparkSession, d: str) -> DataFrame:
    """EN-05, EN-06, EN-18: which method reads a field best."""
    f = F.col("field_path")
    return table(spark, d, "expected_fields", "gt_row_id", "field_path").select("gt_row_id", D.method_for(f).alias("method"), D.preferred_side(f).alias("side"))


@query("""
select extraction_id, unnest([{'field_path': 'leverage_basis', 'value': case when uses_leverage is false then null else leverage_basis end, 'gated': uses_leverage is false and leverage_basis is not null},
  {'field_path': 'max_leverage_pct', 'value': case when uses_leverage is false then null else max_leverage_pct end, 'gated': uses_leverage is false and max_leverage_pct is not null},
  {'field_path': 'uses_leverage', 'value': uses_leverage::varchar, 'gated': false}], recursive := true) from leverage_limits""")
def en_gate(spark: SparkSession, d: str) -> DataFrame:
    """EN-01: children of a false flag are nulled."""
    cols = ["uses_leverage", "max_leverage_pct", "leverage_basis"]
    rows = D.to_fields(table(spark, d, "leverage_limits", "extraction_id", *cols), ["extraction_id"], cols)
    return D.gate(rows, ["extraction_id"], {"max_leverage_pct": "uses_leverage", "leverage_basis": "uses_leverage"}).select("extraction_id", "field_path", "value", "gated")


@query("select filing_id, max(case when field_path = 'fund_type' then expected end) as fund_type, max(case when field_path = 'incentive_fee.fee_basis' then expected end) as fee_basis from expected_fields group by 1")
def en_record(spark: SparkSession, d: str) -> DataFrame:
    """XT-17..23: rows to a record."""
    rows = table(spark, d, "expected_fields", "filing_id", "field_path", "expected").withColumnRenamed("expected", "value")
    return D.to_record(rows, ["filing_id"], ["fund_type", "incentive_fee.fee_basis"]).withColumnRenamed("incentive_fee.fee_basis", "fee_basis")


@query("""
with a as (select extraction_id, repurchase_percentage_min is null and repurchase_percentage_max is not null as filled, coalesce(repurchase_percentage_min, repurchase_percentage_max) as mn, repurchase_percentage_max as mx, early_repurchase_fee_pct as fee from repurchase_terms),
e as (select extraction_id, list_filter([case when filled then {'r': 'fill_min', 'c': 'repurchase_percentage_min'} end, case when mn = mx and fee is not null then {'r': 'one_size', 'c': 'early_repurchase_fee_pct'} end], lambda x: x is not null) as l from a)
select extraction_id, (generate_subscripts(l, 1) - 1)::int as seq, unnest(l).r as rule, unnest(l).c as "column" from e""")
def ru_audit(spark: SparkSession, d: str) -> DataFrame:
    """RU-01, RU-14: ordered passes, the second on what the first left, with a log of what changed."""
    low, high = F.col("repurchase_percentage_min"), F.col("repurchase_percentage_max")
    rules = [D.Rule("fill_min", "repurchase_percentage_min", low.isNull(), high), D.Rule("one_size", "early_repurchase_fee_pct", low == high, F.lit(None))]
    df = table(spark, d, "repurchase_terms", "extraction_id", "repurchase_percentage_min", "repurchase_percentage_max", "early_repurchase_fee_pct")
    return D.audit_log(D.apply_rules(df, rules), ["extraction_id"]).select("extraction_id", "seq", "rule", "column")


@query("""
select user_id, arg_max(value, event_id) filter (where event_type <> 'error') as final_value, max(event_id) as last_seq, count(*) as n_entries from events group by 1""")
def lg_fold(spark: SparkSession, d: str) -> DataFrame:
    """EN-36: the last value that is no error per user."""
    log = table(spark, d, "events", "user_id", "event_id", "event_type", "value").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return D.fold_log(log, ["user_id"], "event_id", "value")


@query("""
select event_id, last_value(case when event_type <> 'error' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as previous from events""")
def lg_carried(spark: SparkSession, d: str) -> DataFrame:
    """XT-42: the last value before each entry."""
    log = table(spark, d, "events", "user_id", "event_id", "event_type", "value").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return D.carried(log, ["user_id"], "event_id", "value").select("event_id", "previous")


# ---------------------------------------------------------------- evaluation


def _cells(spark: SparkSession, d: str, where: str | None = None, latest: bool = True) -> DataFrame:
    rows = table(spark, d, "expected_fields", "gt_row_id", "filing_id", "field_path", "expected", "updated_at", "expected_type", "match_mode")
    catalog = W.catalog_of(table(spark, d, "field_catalog"))
    return W.cells_of(W.widen(rows.where(where) if where else rows, catalog, latest=latest), catalog).withColumnRenamed("cell", "value")


def _judged(spark: SparkSession, d: str, where: str = "expected_type is not null") -> DataFrame:
    """The first versions of the typed rows held against the last of all rows: corrections are wrong values, withdrawn ones hallucinated."""
    return E.judge(_cells(spark, d, where, latest=False), _cells(spark, d), ["filing_id", "field_path"])


def _cells_sql(where: str) -> str:
    return data_sql._P5.replace("from expected_fields x", f"from (select * from expected_fields where {where}) x")


def _first_cells_sql(where: str) -> str:
    return _cells_sql(where).replace("order by updated_at desc nulls last, gt_row_id desc", "order by updated_at nulls first, gt_row_id")


_SAME = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in Y.VALUES.items()) + "}"


def _judged_sql(where: str = "expected_type is not null") -> str:
    """Cells are words without blanks, plain numbers or booleans, so of the rules for numbers only those for these are here."""
    factor = "case when regexp_matches({0}, '(million|mm|m)$') then 1e6 when regexp_matches({0}, '(billion|b)$') then 1e9 when regexp_matches({0}, '(thousand|k)$') then 1e3 else 1 end"
    digits = "coalesce(try_cast(nullif(regexp_extract({0}, '^([+-]?[0-9]+[.]?[0-9]*)$', 1), '') as double), try_cast(replace(nullif(regexp_extract({0}, '([0-9,]+[.]?[0-9]*)', 1), ''), ',', '') as double) * " + factor + ")"
    number = lambda c: f"case when {_SAME}[{c}] is null then coalesce({_ONE_WORD}[{c}], {digits.format(c)}) end"
    return f"""(select *, case when correct then 'correct' when extracted is not null and expected is not null then 'wrong_value' when expected is not null then 'missed' else 'hallucinated' end as error_type from
  (select filing_id, field_path, expected, extracted, case when expected is null or extracted is null then coalesce(expected, extracted, 'false') = 'false'
    when ne is not null then coalesce(abs(nx - ne) <= 0.01 + 1e-12, false) else nx is null and coalesce({_SAME}[expected], expected) = coalesce({_SAME}[extracted], extracted) end as correct
   from (select filing_id, field_path, e.cell as expected, p.cell as extracted, {number("e.cell")} as ne, {number("p.cell")} as nx from ({_cells_sql("true")}) e full join ({_first_cells_sql(where)}) p using (filing_id, field_path))))"""


def _metrics_sql(by: str, where: str = "expected_type is not null") -> str:
    key = f"{by}, " if by else ""
    counts = ", ".join(f"count(*) filter (where error_type = '{o}') as n_{o}_type" for o in E.OUTCOMES)
    return f"""select {key}n, n_correct, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6)::double as f1, round(n_correct::double / n, 6) as accuracy, {", ".join(f"n_{o}_type" for o in E.OUTCOMES)}
from (select *, case when ne > 0 then oe::double / ne else 0 end as p, case when nt > 0 then ot::double / nt else 1 end as r from
  (select {key}count(*) as n, count(*) filter (where correct) as n_correct, count(extracted) as ne, count(*) filter (where correct and extracted is not null) as oe, count(expected) as nt, count(*) filter (where correct and expected is not null) as ot, {counts}
   from {_judged_sql(where)} {"group by " + by if by else ""}))"""


@query(_metrics_sql(""))
def ev_overall(spark: SparkSession, d: str) -> DataFrame:
    """EV-11..14."""
    return E.metrics(_judged(spark, d), [])


@query(_metrics_sql("filing_id"))
def ev_by_filing(spark: SparkSession, d: str) -> DataFrame:
    """EV-05..10."""
    return E.metrics(_judged(spark, d), ["filing_id"])


@query(f"select field_path, error_type, grouping(field_path, error_type)::bigint as grouping_level, count(*) as n, count(*) filter (where correct) as n_correct from {_judged_sql()} group by grouping sets ((), (field_path), (error_type), (field_path, error_type))")
def ev_sets(spark: SparkSession, d: str) -> DataFrame:
    """EV-20: totals over grouping sets in one pass."""
    return E.metric_sets(_judged(spark, d), "field_path", "error_type")


_REPORT = f"select field_path, count(*) as total, count(*) filter (where correct) as n_correct, count(distinct filing_id) filter (where correct) as entities_correct, count(distinct filing_id) filter (where not correct) as entities_incorrect, round(count(*) filter (where correct) / count(*), 6) as accuracy from {_judged_sql()} group by 1"


@query(_REPORT)
def ev_fields(spark: SparkSession, d: str) -> DataFrame:
    """EV-15."""
    return E.field_report(_judged(spark, d), "field_path", "filing_id")


@query(f"{_REPORT} order by accuracy, field_path limit 5")
def ev_worst(spark: SparkSession, d: str) -> DataFrame:
    """EV-22."""
    return E.extremes(E.field_report(_judged(spark, d), "field_path", "filing_id"), 5)


@query(f"""
with b as ({_metrics_sql("field_path")}), v as ({_metrics_sql("field_path", "match_mode is not null")}),
j as (select field_path, coalesce(b.accuracy, 0)::double as baseline, coalesce(v.accuracy, 0)::double as variant from b full join v using (field_path))
select *, round(variant - baseline, 6) as delta, case when round(variant - baseline, 6) > 0 then 'improved' when round(variant - baseline, 6) < 0 then 'regressed' else 'same' end as verdict from j""")
def ev_compare(spark: SparkSession, d: str) -> DataFrame:
    """EV-24, EV-26: two runs by field."""
    return E.compare_runs(E.metrics(_judged(spark, d), ["field_path"]), E.metrics(_judged(spark, d, "match_mode is not null"), ["field_path"]), "field_path")


# ---------------------------------------------------------------- tagged documents, streams


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents made of the amounts of fund_periods: tagged numbers at several scales, one duplicate id, one text block."""
    amount = lambda c: F.regexp_replace(F.format_number(F.abs(c), 2), r"\.00$", "")
    sign = F.when(F.col("net_assets") < 0, " sign='-'").otherwise("")
    number = lambda name, c, extra, ident: F.concat(F.lit(f"<td><ix:nonFraction name='f:{name}' contextRef='c1' unitRef='USD' id='{ident}'"), F.coalesce(extra, F.lit("")), F.lit(">"), amount(c), F.lit("</ix:nonFraction></td>"))
    html = F.concat(
        F.lit("<html><head><style>td {color: red}</style></head><body><xbrli:context id='c1'><xbrli:entity><xbrli:identifier>x</xbrli:identifier><xbrldi:explicitMember>f:ClassISharesMember</xbrldi:explicitMember></xbrli:entity><xbrli:period><xbrli:instant>"),
        F.coalesce(F.col("report_date").cast("string"), F.lit("none")),
        F.lit("</xbrli:instant></xbrli:period></xbrli:context><table><tr>"),
        F.when(F.col("total_assets").isNotNull(), number("TotalAssets", F.col("total_assets"), F.lit(" scale='3'"), "n1")).otherwise(""),
        F.when(F.col("net_assets").isNotNull(), number("NetAssets", F.col("net_assets"), sign, "n2")).otherwise(""),
        F.when(F.col("net_assets").isNotNull(), number("NetAssets", F.lit(1.0), F.lit(""), "n2")).otherwise(""),
        F.lit("</tr></table><ix:nonNumeric name='f:SeriesTextBlock' id='b1' contextRef='c1'><b>"),
        F.coalesce("series_id", F.lit("none")),
        F.lit("</b><br>&amp; more</ix:nonNumeric></body></html>"),
    )
    return table(spark, d, "fund_periods", "row_id", "report_date", "total_assets", "net_assets", "series_id").select(F.col("row_id").cast("string").alias("filing_id"), html.alias("html"))


@query("""
select row_id::varchar as filing_id, 'TotalAssets' as tag, cast(abs(total_assets) * 1000 as double) as value, 'Class I' as share_class, report_date::varchar as instant from fund_periods where total_assets is not null
union all select row_id::varchar, 'NetAssets', cast(net_assets as double), 'Class I', report_date::varchar from fund_periods where net_assets is not null""")
def xb_facts(spark: SparkSession, d: str) -> DataFrame:
    """XB-01..09: tagged numbers read back with scale, sign, context and one per id."""
    stream = materialise(ixbrl.events(_tagged(spark, d)), "events")  # parsed once, read for contexts and for numbers
    facts = ixbrl.numeric_facts(stream)
    return facts.select("filing_id", F.regexp_replace("name", "^f:", "").alias("tag"), F.col("value").cast("double").alias("value"), "share_class", F.nullif("instant", F.lit("none")).alias("instant"))


@query("select row_id::varchar as filing_id, coalesce(series_id, 'none') || ' & more' as content from fund_periods")
def xb_blocks(spark: SparkSession, d: str) -> DataFrame:
    """XB-11, XB-13."""
    return ixbrl.text_blocks(materialise(ixbrl.events(_tagged(spark, d)), "events")).select("filing_id", "content")


@query("""
select row_id::varchar as filing_id, 'b1' as id, 'f:NotesTextBlock' as name, 'Notes ' || coalesce(series_id, 'none') as content from fund_periods
union all select row_id::varchar, 'n' || (row_id % 9)::varchar, 'ix:footnote:FeeStructure', coalesce(series_id, 'none') || ' ' || ['Incentive Fee', 'performance fee', 'Hurdle Rate', 'catch-up', 'high water mark', 'Expense Cap', 'fee waiver', 'Pre-Incentive Fee', 'NET INVESTMENT INCOME'][(row_id % 9 + 1)::int] || ' applies' from fund_periods""")
def xb_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """XB-11..13: a continued block, a footnote about fees, whose keyword the row's number picks, and one about something else."""
    words = F.array(*[F.lit(w) for w in ("Incentive Fee", "performance fee", "Hurdle Rate", "catch-up", "high water mark", "Expense Cap", "fee waiver", "Pre-Incentive Fee", "NET INVESTMENT INCOME")])
    place, series = (F.col("row_id") % 9).cast("int"), F.coalesce("series_id", F.lit("none"))
    html = F.concat(
        F.lit("<html><body><ix:header><ix:footnote id='n"),
        place.cast("string"),
        F.lit("'><p>"),
        series,
        F.lit("</p><b>"),
        F.get(words, place),
        F.lit("</b>\n applies</ix:footnote><ix:footnote id='o'>Audited.</ix:footnote></ix:header><ix:nonNumeric name='f:NotesTextBlock' id='b1' continuedAt='k1'>Notes</ix:nonNumeric><p>between</p><ix:continuation id='k1'>"),
        series,
        F.lit("</ix:continuation></body></html>"),
    )
    noted = table(spark, d, "fund_periods", "row_id", "series_id").select(F.col("row_id").cast("string").alias("filing_id"), html.alias("html"))
    return ixbrl.text_blocks(materialise(ixbrl.events(noted), "events")).select("filing_id", "id", "name", "content")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, cast(round(sum(cast(value as decimal(18,6))), 6) as double) as total from events group by 1, 2")
def st_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the event stream."""
    out = events.run_available(events.windowed_counts(events.event_stream(spark, d, "events")), ["window_start", "event_type"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def st_latest(spark: SparkSession, d: str) -> DataFrame:
    """REL-23 on a stream: the last event per user."""
    return events.run_available(events.event_stream(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


# ---------------------------------------------------------------- documents with share classes, HTML sections


def _classed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with facts of several share classes: by id and by member, a vetoed member, dashes, words, scales, negatives, unmapped tags, a block and an empty one."""
    context = lambda ident, member: f"<xbrli:context id='{ident}'><xbrli:entity><xbrli:identifier>x</xbrli:identifier><xbrli:segment>{member}</xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>"
    member = lambda name: f"<xbrldi:explicitMember dimension='a'>{name}</xbrldi:explicitMember>"
    fact = lambda name, ctx, rest="": f"<ix:nonFraction name='{name}' contextRef='{ctx}' {rest}>"
    head = context("c0", "") + context("c1", member("f:SomeRiskMember") + member("f:ClassISharesMember")) + context("P1_ClassSAdvisorySharesMember", "") + context("c3", member("f:InstitutionalSharesMember")) + context("c4", member("f:ClassISharesRepurchasedMember"))
    x = F.format_string("%.2f", (F.col("row_id") % 300) / 100)
    parts = [
        head, fact("cef:ManagementFeesPercent", "c1", "scale='-2' id='a'"), x, "</ix:nonFraction>", fact("cef:ManagementFeesPercent", "P1_ClassSAdvisorySharesMember", "scale='-2' id=''"), "<b>—</b></ix:nonFraction>",
        fact("cef:ManagementFeesPercent", "c0", "format='ixt:numwordsen'"), "one</ix:nonFraction>", fact("cef:SalesLoadPercent", "c3", "sign='-'"), "1.5</ix:nonFraction>", fact("cef:Unmapped", "c0"), "7</ix:nonFraction>",
        fact("us-gaap:NetAssetValuePerShare", "c4"), F.format_string("%d", F.col("row_id") % 7 + 10), "</ix:nonFraction>", fact("cef:SeniorSecuritiesAmt", "nowhere", "scale='3'"), "1,000</ix:nonFraction>", fact("cef:AnnualCoverageReturnRatePercent", "c0"), "about 5</ix:nonFraction>",
        "<ix:nonNumeric name='cef:RiskTextBlock' id='b1'><p>Risks of", F.coalesce(F.regexp_replace("series_id", "&", "&amp;"), F.lit("none")), "</p></ix:nonNumeric><ix:nonNumeric name='cef:SecurityTitleTextBlock' id='b2'> </ix:nonNumeric>",
    ]
    html = F.concat(F.lit("<html><body>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</body></html>"))
    return table(spark, d, "fund_periods", "row_id", "series_id").select(F.col("row_id").cast("string").alias("filing_id"), html.alias("html"))


_CLASSED = """
f as (select row_id::varchar as filing_id, row_id, series_id from fund_periods),
v as (select filing_id, 'management_fee_pct' as field, 'Class I' as share_class, (round((row_id % 300) / 100, 2) / 100)::decimal(38,10)::double as value from f
  union all select filing_id, 'management_fee_pct', 'Class S Advisory', 0 from f union all select filing_id, 'management_fee_pct', null, 1 from f
  union all select filing_id, 'sales_load_pct', 'Institutional', -1.5 from f union all select filing_id, 'nav_per_share', null, row_id % 7 + 10 from f)"""


@query(f"with {_CLASSED} select *, null::varchar as content from v union all select filing_id, 'leverage_amount', null, 1000000, null from f union all select filing_id, 'risk_factors', null, null, 'Risks of' || coalesce(series_id, 'none') from f")
def xb_values(spark: SparkSession, d: str) -> DataFrame:
    """XB-03..08, XB-19, XB-24, XB-25: mapped facts and blocks by field and share class."""
    stream = materialise(ixbrl.events(_classed(spark, d)), "events")
    return ixbrl.tagged_values(ixbrl.numeric_facts(stream), ixbrl.text_blocks(stream)).withColumn("value", F.col("value").cast("double"))


@query(f"with {_CLASSED} select filing_id, share_class, field, value from v")
def xb_fee_table(spark: SparkSession, d: str) -> DataFrame:
    """XB-20: fees by share class and at fund level."""
    return ixbrl.fee_table(ixbrl.numeric_facts(materialise(ixbrl.events(_classed(spark, d)), "events"))).withColumn("value", F.col("value").cast("double"))


@query(f"""with {_CLASSED}, c as (select filing_id, unnest(['Class I', 'Class S Advisory', 'Institutional']) as share_class from f),
g as (select c.filing_id, share_class, field from c, (select distinct field from v))
select g.filing_id, g.share_class, g.field, coalesce(v.value, w.value) as value from g left join v on v.filing_id = g.filing_id and v.share_class = g.share_class and v.field = g.field
left join v w on w.filing_id = g.filing_id and w.field = g.field and w.share_class is null where coalesce(v.value, w.value) is not null""")
def xb_class_values(spark: SparkSession, d: str) -> DataFrame:
    """XB-21, XB-22: each detected class's value of each fee, else the fund's."""
    facts = ixbrl.numeric_facts(materialise(ixbrl.events(_classed(spark, d)), "events"))
    classes = ixbrl.detected_classes(facts).select("filing_id", F.explode("share_classes").alias("share_class"))
    return ixbrl.class_value(ixbrl.fee_table(facts), classes).withColumn("value", F.col("value").cast("double"))


@query("select row_id::varchar as filing_id, 5::bigint as n_values, 3::bigint as n_by_class, 2::bigint as n_fund_level, 3::bigint as n_classes from fund_periods")
def xb_summary(spark: SparkSession, d: str) -> DataFrame:
    """XB-23."""
    return ixbrl.extraction_summary(ixbrl.numeric_facts(materialise(ixbrl.events(_classed(spark, d)), "events")))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents: a cover line, a table of contents with the headings' words, styled headings, a question in a table, a list."""
    text = F.regexp_replace(F.concat_ws(" ", F.lit("of"), F.coalesce("series_name", F.lit("none"))), "&", "&amp;")
    toc = "".join(f"<tr><td><b>{t}</b></td><td>{n}</td></tr>" for n, t in enumerate(("Risk Factors", "Fees", "Taxes", "Custodian", "Experts"), 3))
    parts = [
        f"<html><head><style>p {{}}</style></head><body><p>FORM N-2</p><p style='font-weight: bold; font-size: 14pt'>PROSPECTUS</p><table>{toc}</table><div>",
        "<p style='font-weight:bold;font-size:12pt'>Risk Factors</p><p>The risks ", F.repeat(F.concat(text, F.lit(", ")), 9), "end.<p style='font-size:9pt'>More.</p>",
        "<p><b>Fees and Expenses</b></p><ul><li>Fees ", F.repeat(text, 8), "<li>last</ul><h2>Short</h2>few words",
        "<table><tr><td style='font-weight:700'>What is the minimum?</td></tr></table><p>A thousand ", F.repeat(text, 8), "</p></div></body></html>",
    ]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, d, "fund_periods", "row_id", "series_name").select(F.col("row_id").cast("string").alias("filing_id"), html.alias("html"))


_RENDERED = r"(select row_id::varchar as filing_id, 'of ' || coalesce(series_name, 'none') as x from fund_periods)"


@query(rf"""
with p as (select filing_id, unnest([
  {{'title': 'Risk Factors', 'tag': 'p', 'level': 3, 'content_type': 'text', 'c': 'Risk Factors The risks ' || repeat(x || ', ', 9) || 'end. More.'}},
  {{'title': 'Fees and Expenses', 'tag': 'p', 'level': 3, 'content_type': 'list', 'c': 'Fees and Expenses Fees ' || repeat(x, 8) || ' last'}},
  {{'title': 'What is the minimum?', 'tag': 'td', 'level': 4, 'content_type': 'table', 'c': 'What is the minimum? A thousand ' || repeat(x, 8)}}], recursive := true) from {_RENDERED}),
q as (select * exclude c, trim(regexp_replace(c, '\s+', ' ', 'g')) as content from p)
select filing_id, title, tag, level::int as level, content_type, content from q where length(content) >= 100""")
def seg_html(spark: SparkSession, d: str) -> DataFrame:
    """SEG-09..17: sections of rendered documents by styled headings, without contents entries and cover lines."""
    return html_sections.heading_sections(_rendered(spark, d)).select("filing_id", "title", "tag", "level", "content_type", "content")


def _case_sql(c: str) -> str:
    return "case " + " ".join(f"when regexp_matches({c}, '{p.removeprefix('(?i)')}', 'i') then '{n}'" for n, p in TITLE_PATTERNS.items()) + " end"


@query(f"select chunk_id, {_case_sql('section_title')} as section from chunks")
def seg_names(spark: SparkSession, d: str) -> DataFrame:
    """SEG-19, SEG-20: the standard section of a title."""
    return _chunks(spark, d).select("chunk_id", S.section_name(F.col("section_title")).alias("section"))


def _fields_sql(c: str) -> str:
    tests = [(p.removeprefix("(?i)"), STANDARD_SECTIONS[n][1]) for n, p in TITLE_PATTERNS.items()] + [("(?:" + "|".join(ps) + ")", fields) for ps, fields in taxonomy.HEADING_FIELDS.values()]
    return "list_concat([]::varchar[], " + ", ".join(f"case when regexp_matches({c}, '{p}', 'i') then {list(fields)} else []::varchar[] end" for p, fields in tests if fields) + ")"


@query(f"select chunk_id, array_to_string(list_sort(list_distinct({_fields_sql('section_title')})), ',') as fields from chunks")
def seg_title_fields(spark: SparkSession, d: str) -> DataFrame:
    """SEG-18 with the table of standard sections and headings."""
    return _chunks(spark, d).select("chunk_id", F.array_join(S.target_fields(F.col("section_title"), F.lit(None).cast("string")), ",").alias("fields"))


@query(None)
def seg_standard(spark: SparkSession, d: str) -> DataFrame:
    """SEG-02, SEG-22: the standard sections of every document."""
    return S.standard_sections(_docs(spark, d))


@query(r"select filing_id, 'Risk Text Block' as title, 'tagged' as source from (select row_id::varchar as filing_id, 'Risks of' || coalesce(series_id, 'none') as c from fund_periods) where length(c) >= 10")
def pl_sections(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02, SEG-01: tagged documents through the whole program, to sections."""
    return filing_program.parse(_classed(spark, d), least=10).sections.where("source = 'tagged'").select("filing_id", "title", "source")


@query(None)
def pl_chunks(spark: SparkSession, d: str) -> DataFrame:
    """CH-08, CH-10, CH-12, CH-13: rendered documents through the whole program, to chunks with context."""
    return filing_program.parse(_rendered(spark, d)).chunks


# ---------------------------------------------------------------- more sections, retrieval, records

PATTERNS = {"fees": r"(?i)fees and expenses", "risks": r"(?i)risk factors", "repurchase": r"(?i)repurchase", "distribution": r"(?i)distribution policy"}


@query("""
with s as (select doc_id, length(text) as n, unnest([""" + ", ".join(f"{{'section': '{k}', 'pos': length(regexp_extract(text, '^(?s)(.*?){p[4:]}', 1, 'i')) + case when regexp_matches(text, '{p[4:]}', 'i') then 1 else null end}}" for k, p in PATTERNS.items()) + """], recursive := true) from documents where text is not null),
k as (select * from s where pos is not null),
e as (select a.doc_id, a.section, a.pos - 1 as char_start, least(coalesce((select min(b.pos) - 1 from k b where b.doc_id = a.doc_id and b.pos > a.pos + 50), n), a.pos - 1 + 50000, n) as char_end from k a)
select doc_id, section, char_start::int as char_start, char_end::int as char_end from e where char_end - char_start >= 100""")
def seg_patterns(spark: SparkSession, d: str) -> DataFrame:
    """SEG-02: named sections to the next start of another."""
    return S.pattern_sections(_docs(spark, d), PATTERNS)


_TERMS = ["repurchase", "leverage", "fee", "distribution"]


@query(r"""
with p as (select doc_id, unnest(range(len(l))) as pos, lower(unnest(l)) as para, len(l) as n from (select doc_id, regexp_split_to_array(text, '\n\n+') as l from documents where text is not null)),
s as (select *, """ + " + ".join(f"contains(para, '{t}')::int" for t in _TERMS) + """ as score from p),
b as (select * from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, pos) <= 5),
a as (select doc_id, q, sum(case when q = pos then score else 0 end) as score from (select doc_id, pos, score, unnest(range(greatest(0, pos - 1), least(n - 1, pos + 2) + 1)) as q from b) group by 1, 2),
i as (select *, q - row_number() over (partition by doc_id order by q) as run from a)
select doc_id, min(q)::int as first, max(q)::int as last, sum(score)::bigint as score from i group by doc_id, run""")
def seg_passages(spark: SparkSession, d: str) -> DataFrame:
    """SEG-23: passages around the paragraphs with most terms."""
    return S.keyword_passages(_docs(spark, d), _TERMS)


@query("select chunk_id, array_to_string(list_filter([case when regexp_matches(section_title, 'fee|expense', 'i') then 'fees' end, case when regexp_matches(section_title, 'leverage|borrow', 'i') then 'leverage' end, case when regexp_matches(section_title, 'repurchase|tender', 'i') then 'repurchase' end], lambda x: x is not null), ',') as fields from chunks")
def seg_fields(spark: SparkSession, d: str) -> DataFrame:
    """SEG-18: fields that a title stands for."""
    df = S.section_fields(_chunks(spark, d), {"fees": ["fee", "expense"], "leverage": ["leverage", "borrow"], "repurchase": ["repurchase", "tender"]}, "section_title")
    return df.select("chunk_id", F.array_join("target_fields", ",").alias("fields"))


@query("""
select chunk_id, ((contains(t, 'annual')::int + contains(t, 'fee')::int) * case when contains(t, 'annual fee') then 5 else 1 end)::int as score from (select chunk_id, lower(coalesce(content, '')) as t from chunks)""")
def rt_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """RT-25: terms of a query, more if the phrase stands whole."""
    return _chunks(spark, d).select("chunk_id", R.query_score(F.col("content"), "annual fee").cast("int").alias("score"))


@query(f"""
with k as (select chunk_id, filing_id, field, score, row_number() over (partition by field, filing_id order by score desc, chunk_id) > 1 as extra from {_SCORED} where score > 0)
select field, chunk_id, row_number() over (partition by field order by extra, score desc, chunk_id)::int as rank from k qualify rank <= 20""")
def rt_diverse(spark: SparkSession, d: str) -> DataFrame:
    """RT-48: the best twenty per field, one per filing before any second."""
    return R.diverse_top(_scored(spark, d).where("score > 0"), ["field"], "filing_id", [F.desc("score"), F.col("chunk_id")], 20).select("field", "chunk_id", "rank")


@query(f"""
with r as (select filing_id, field, count(*) as n, round(count(*) filter (where score > 3) / count(*), 6) as ratio from {_SCORED} group by 1, 2)
select *, case when ratio >= 0.5 then 'correct' when ratio > 0 then 'ambiguous' else 'incorrect' end as verdict from r""")
def rt_verdict(spark: SparkSession, d: str) -> DataFrame:
    """RT-35."""
    return R.retrieval_verdict(_scored(spark, d), ["filing_id", "field"], F.col("score") > 3)


@query("""
with r as (select filing_id, lower(trim(repurchase_frequency)) as name, method, repurchase_percentage_max as a, notice_period_days::double as b from repurchase_terms),
t as (select filing_id, name, method, unnest([{'attribute': 'repurchase_percentage_max', 'x': a}, {'attribute': 'notice_period_days', 'x': b}], recursive := true) from r),
w as (select filing_id, name, attribute, min(x::varchar) as expected from t where method = 'manual_review' group by 1, 2, 3),
g as (select filing_id, name, attribute, min(x::varchar) as extracted from t where method <> 'manual_review' group by 1, 2, 3)
select w.filing_id, w.name, w.attribute, expected::double as expected, extracted::double as extracted, coalesce(abs(expected::double - extracted::double) <= 0.01 + 1e-12, false) as correct
from w left join g on w.filing_id = g.filing_id and w.name = g.name and w.attribute = g.attribute where expected is not null""")
def ev_records(spark: SparkSession, d: str) -> DataFrame:
    """EV-02, EV-03, SC-08: records matched by name, compared by attribute."""
    df = table(spark, d, "repurchase_terms", "filing_id", "method", "repurchase_frequency", "repurchase_percentage_max", "notice_period_days").withColumn("notice_period_days", F.col("notice_period_days").cast("double"))
    manual = F.col("method") == "manual_review"
    out = E.judge_records(df.where(~manual), df.where(manual), ["filing_id"], "repurchase_frequency", ["repurchase_percentage_max", "notice_period_days"])
    return out.select("filing_id", "name", "attribute", F.col("expected").cast("double").alias("expected"), F.col("extracted").cast("double").alias("extracted"), "correct")


@query(None)
def ch_sequential(spark: SparkSession, d: str) -> DataFrame:
    """CH-01..04: chunks with back-overlap and exact offsets; sequential, so held against properties in tests."""
    return chunker.chunk_texts(_docs(spark, d), "doc_id", "text")


# ---------------------------------------------------------------- more merging


@query("""
with r as (select filing_id, repurchase_percentage_min as lo, repurchase_percentage_max as hi, extraction_id as i, coalesce(case lower(trim(confidence)) when 'explicit' then 0 when 'inferred' then 1 when 'not_found' then 2 end, 3) as c from repurchase_terms)
select filing_id, arg_min(lo, {'c': c, 'i': i}) filter (where lo is not null) as repurchase_percentage_min, arg_min(hi, {'c': c, 'i': i}) filter (where hi is not null) as repurchase_percentage_max from r group by 1""")
def en_merge_confident(spark: SparkSession, d: str) -> DataFrame:
    """EN-19, EN-20: the surest stated value of each attribute."""
    cols = ["repurchase_percentage_min", "repurchase_percentage_max"]
    return D.merge_confident(table(spark, d, "repurchase_terms", "filing_id", "extraction_id", "confidence", *cols), ["filing_id"], cols, "confidence", "extraction_id")


def _latest(method: str) -> str:
    return f"(select * from repurchase_terms where method = '{method}' qualify row_number() over (partition by filing_id order by loaded_at desc, extraction_id) = 1)"


@query(f"""
select a.filing_id, coalesce(b.notice_period_days, a.notice_period_days) as notice_period_days, coalesce(a.early_repurchase_fee_pct, b.early_repurchase_fee_pct) as early_repurchase_fee_pct
from {_latest("tier3_docvqa")} a left join {_latest("tier4_agentic")} b using (filing_id)""")
def en_overlay(spark: SparkSession, d: str) -> DataFrame:
    """EN-23..33: one column replaced where the second method states it, one filled where the first doesn't."""
    df = table(spark, d, "repurchase_terms", "filing_id", "extraction_id", "method", "loaded_at", "notice_period_days", "early_repurchase_fee_pct")
    last = lambda m: H.first_by(df.where(F.col("method") == m), ["filing_id"], [F.desc("loaded_at"), F.col("extraction_id")]).select("filing_id", "notice_period_days", "early_repurchase_fee_pct")
    return D.overlay(last("tier3_docvqa"), last("tier4_agentic"), ["filing_id"], ["notice_period_days"], ["early_repurchase_fee_pct"])


_TIERS = ("keyword_rules", "tier3_docvqa", "tier4_agentic", "manual_review")


@query("\nunion all\n".join(f"select filing_id, {i} as i, '{m}' as tier, min(repurchase_frequency) as value from repurchase_terms where method = '{m}' and repurchase_frequency is not null and lower(trim(repurchase_frequency)) not in {data_sql._NULLS} group by 1" for i, m in enumerate(_TIERS)).join(["with t as (", ") select filing_id, arg_min(value, i) as value, arg_min(tier, i) as tier from t group by 1"]))
def en_tiers(spark: SparkSession, d: str) -> DataFrame:
    """EN-21: the first method that states a frequency."""
    df = table(spark, d, "repurchase_terms", "filing_id", "method", F.col("repurchase_frequency").alias("value"))
    return D.first_of_tiers([(m, df.where(F.col("method") == m)) for m in _TIERS], ["filing_id"])


@query("select event_type, user_id, count(*) as n, grouping(event_type, user_id)::bigint as grouping_level from events group by cube (event_type, user_id)")
def lg_summary(spark: SparkSession, d: str) -> DataFrame:
    """EN-14, EN-37."""
    return D.log_summary(table(spark, d, "events", "event_type", "user_id"), "event_type", "user_id")


@query("select extraction_id, 0 as ord, method as name, repurchase_percentage_max as pct from repurchase_terms where method is not null")
def ll_blocks(spark: SparkSession, d: str) -> DataFrame:
    """LL-12..14: answers in blocks read back as records."""
    answer = F.concat(F.lit("Name:  "), F.coalesce("method", F.lit("")), F.lit(" \nPCT: "), F.coalesce(F.col("repurchase_percentage_max").cast("string"), F.lit("unknown")), F.lit("\n---\nNAME:\nPCT: 1"))
    df = table(spark, d, "repurchase_terms", "extraction_id", "method", "repurchase_percentage_max").select("extraction_id", answer.alias("answer"))
    return predictor.parse_blocks(df, ["extraction_id"], "answer", {"NAME": "string", "PCT": "double"}, "NAME")
