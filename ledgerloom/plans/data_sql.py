"""SQL for DuckDB that the queries of the general data problems are held against."""

from __future__ import annotations

_NULLS = "('', 'na', 'n/a', 'n.a.', 'none', 'null', 'nil', 'nan', 'not stated', 'not available', 'not applicable', 'not found', 'not specified', 'not disclosed', 'missing', '-', '--')"


def _cik(c: str) -> str:
    s = f"upper(trim({c}))"
    return f"case when {c} is null or lower(trim({c})) in {_NULLS} then null when regexp_full_match({s}, '(CIK)?[0-9]+([.]0*)?') then lpad(ltrim(regexp_extract({s}, '([0-9]+)', 1), '0'), 10, '0') else {s} end"


def _accession(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(upper(trim({c})), '[.](TXT|HTML?|XML|0+)$', ''), '[-_ ]', '', 'g')"
    return f"case when {c} is null or lower(trim({c})) in {_NULLS} then null when regexp_full_match({bare}, '[0-9]{{1,18}}') then lpad({bare}, 18, '0') else upper(trim({c})) end"


_QUARTER = "coalesce(nullif(regexp_extract(lower(quarter), '([12][0-9]{3})', 1) || 'q' || regexp_extract(lower(quarter), 'q[ -]*([1-4])', 1), 'q'), 'unknown')"

_P4 = f"""
with parent as (
  select 'cik' as space, {_cik("cik")} as k, created_at as s, deleted_at as e from funds
  union all select 'acc', {_accession("accession_number")}, loaded_at, deleted_at from submissions),
ref as (
  select 'cik' as space, {_cik("cik")} as k, loaded_at as t, 'submissions' as table_name, row_id, {_QUARTER} as period from submissions
  union all select 'acc', {_accession("accession_number")}, loaded_at, 'fund_periods', row_id, {_QUARTER} from fund_periods
  union all select 'acc', {_accession("accession_number")}, loaded_at, 'monthly_returns', row_id, {_QUARTER} from monthly_returns),
held as (
  select table_name, row_id, period, count(p.k) as n, coalesce(bool_or(p.s <= t and (p.e is null or t < p.e)), false) as there, coalesce(bool_or(p.s > t), false) as later
  from ref r left join parent p on p.space = r.space and p.k = r.k where r.k is not null group by table_name, row_id, period)
select table_name, row_id, period, case when n = 0 then 'missing' when later then 'late' else 'deleted' end as orphan_kind from held where not there"""

_PATH = "regexp_replace(regexp_replace(lower(trim({0})), '^fields[./]', ''), '[^a-z0-9]+', '', 'g')"
_P5 = f"""
with names as (
  select field_path as path, value_type, {_PATH.format("field_path")} as k from field_catalog
  union all select field_path, value_type, {_PATH.format("former_path")} from field_catalog where former_path is not null),
last as (
  select filing_id, path, value_type, trim(expected) as e
  from expected_fields x join names n on {_PATH.format("x.field_path")} = n.k where value_type <> 'records'
  qualify row_number() over (partition by filing_id, path order by updated_at desc nulls last, gt_row_id desc) = 1),
plain as (select filing_id, path, value_type, trim(case when regexp_full_match(e, '"(.|\\n)*"') then e[2:-2] else e end) as v from last where e is not null),
valued as (select *, lower(v) as l, regexp_replace(lower(v), ' *(%|per ?cent)$', '') as n from plain where lower(v) not in {_NULLS}),
read as (select filing_id, path, case value_type
  when 'boolean' then case when l in ('true', 't', 'yes', 'y', '1', '☒', '☑', '[x]', 'x') then 'true' when l in ('false', 'f', 'no', 'n', '0', '☐', '[ ]', '[]') then 'false' end
  when 'number' then case when regexp_full_match(n, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?') or regexp_full_match(n, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?') then
    regexp_replace(regexp_replace(cast(cast(replace(n, ',', '') as decimal(38, 15)) as varchar), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') end
  else regexp_replace(l, '[ _-]+', '_', 'g') end as cell from valued)
select filing_id, path as field_path, cell from read where cell is not null"""

# All cells with what they were read from, also those of records; and the rows of attributes outside the catalog.
_P5_ALL = _P5[: _P5.index("select filing_id, path as field_path, cell from read")].replace(" where value_type <> 'records'", "").replace("select filing_id, path, value_type, trim(expected) as e\n", "select filing_id, path, value_type, trim(expected) as e, expected as raw\n").replace(
    "select filing_id, path, value_type, trim(case", "select filing_id, path, value_type, raw, trim(case").replace("read as (select filing_id, path,", "read as (select filing_id, path, raw,").replace(
    "else regexp_replace(l, '[ _-]+', '_', 'g') end as cell", "when 'records' then case when json_valid(v) and regexp_matches(v, '^[ \t\n]*[\\[{{]') then v end else regexp_replace(l, '[ _-]+', '_', 'g') end as cell")
_UNKNOWN = f"select * from expected_fields x where {_PATH.format('x.field_path')} not in (select k from names) or field_path is null"
_OTHERS = f"{_P5_ALL}, rest as ({_UNKNOWN}) select filing_id, field_path, expected as value from rest qualify row_number() over (partition by filing_id, field_path order by updated_at desc nulls last, gt_row_id desc) = 1"
_FAILURES = f"""{_P5_ALL}, rest as (select filing_id, count(distinct coalesce(field_path, chr(1))) as n from ({_UNKNOWN}) group by 1),
bad as (select filing_id, string_agg(path || '=' || raw, ';' order by path || '=' || raw) as f from read where cell is null group by 1)
select filing_id, coalesce(f, '') as cast_failures, coalesce(n, 0) as n_unknown from (select distinct filing_id from expected_fields) left join bad using (filing_id) left join rest using (filing_id)"""

_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_MAP = "map {" + ", ".join(f"'{w}': {n}" for w, n in _WORDS.items()) + "}"


def _sum(c: str) -> str:
    return f"coalesce(list_sum(list_transform(string_split_regex({c}, '[^a-z]+'), lambda w: coalesce({_MAP}[w], 0))), 0)"


def _amount(c: str) -> str:
    words = f"(case when contains({c}, 'hundred') then greatest({_sum(f"split_part({c}, 'hundred', 1)")}, 1) * 100 + {_sum(f"split_part({c}, 'hundred', 2)")} else {_sum(c)} end)"
    return f"coalesce(try_cast(nullif(regexp_extract({c}, '[(]([0-9.]+)[)]', 1), '') as double), try_cast(replace(nullif(regexp_extract({c}, '([0-9][0-9,]*[.]?[0-9]*)', 1), ''), ',', '') as double), nullif({words}, 0)::double)"


# Days of one unit, in twelfths; the unit is the last word or letter.
_SPELLED = {4380: "years?|yrs?|y", 1095: "quarters?|qtrs?|q", 365: "months?|mths?|mos?|m", 84: "weeks?|wks?|w", 12: "days?|dys?|d"}
_UNIT = "case " + " ".join(f"when regexp_matches({{0}}, '(^|[^a-z])({p})[.]?$') then {n}" for n, p in _SPELLED.items()) + " end"
_NUMBER = "'[+]?([0-9][0-9,]*([.][0-9]+)?|[.][0-9]+)'"
_CITED = r"nullif(regexp_extract(cit, '(?:lock-?up(?: period)?(?: of|:)?|held for|during the first|repurchase after) (.*?(?:years?|quarters?|months?|weeks?|days?))\b', 1), '')"
_PCT = "(?:%| ?per ?cent| ?percent)"
_P1 = rf"""
with vals as (
  select extraction_id, 'lock_up_period_years' as field_name, lock_up_period_years as raw, method, citation, null as basis from repurchase_terms
  union all select extraction_id, 'lock_up_period_days', lock_up_period_days, method, citation, null from repurchase_terms
  union all select extraction_id, 'max_leverage_pct', max_leverage_pct, method, citation, leverage_basis from leverage_limits),
v as (select *, lower(trim(raw)) as v, lower(citation) as cit, replace(lower(basis), '_', ' ') as bas, field_name = 'max_leverage_pct' as lim from vals where raw is not null and lower(trim(raw)) not in {_NULLS}),
n as (select v.*, lower(unit_note) as note, regexp_full_match(v, {_NUMBER}) as bare, try_cast(replace(v, ',', '') as double) as x from v left join unit_conventions u on u.method = lower(trim(v.method)) and u.field_name = v.field_name),
dur as (select extraction_id, field_name, bare, x,
  case when field_name = 'lock_up_period_years' then 4380 else 12 end as own,
  case when not bare then {_amount("v")} when {_CITED} is not null then {_amount(_CITED)} else x end as amt,
  case when not bare then {_UNIT.format("v")} when {_CITED} is not null then {_UNIT.format(_CITED)} else
    case when contains(note, 'quarter') then 1095 when contains(note, 'week') then 84 when contains(note, 'month') then 365 when contains(note, 'year') then 4380 when contains(note, 'day') then 12 end end as twelfths,
  bare and {_CITED} is not null as cited from n where not lim),
d as (select extraction_id, field_name, floor(amt * twelfths / 12 + 0.5)::bigint as common_value from dur where amt is not null and twelfths is not null
  and case when cited then abs(amt * twelfths - x * own) > 1e-6 * x * own else twelfths <> own end),
kind as (select *, case when contains(bas, 'coverage') then 'cov' when contains(bas, 'equity') or contains(bas, 'net asset') then 'eq' end as base,
  nullif(regexp_extract(cit, '(?:borrow up to|borrowings will not exceed|leverage is capped at) ([0-9.]+){_PCT} of (?:its )?total assets', 1), '')::double as c_ta,
  nullif(regexp_extract(cit, 'borrowings may not exceed ([0-9.]+){_PCT} of the fund.s net assets', 1), '')::double as c_eq,
  nullif(regexp_extract(cit, 'debt-to-equity ratio of no more than ([0-9.]+) to 1', 1), '')::double as c_de,
  nullif(regexp_extract(cit, 'asset coverage of (?:at least )?([0-9.]+)%', 1), '')::double as c_cov, {_amount("v")} as a from n where lim),
lev as (select extraction_id, field_name, bare, x, c_ta, case
  when not bare then case
    when contains(v, 'debt') then ['de', a::varchar] when contains(v, 'coverage') then ['cov', a::varchar] when regexp_matches(v, 'basis points|bps?$') then ['bps', a::varchar]
    when contains(v, 'net assets') then ['eq', a::varchar] when regexp_matches(v, '%|percent') then [coalesce(case when contains(v, 'total assets') then 'ta' end, base, 'ta'), a::varchar]
    when contains(v, 'half') then ['part', '0.5'] when contains(v, 'third') then ['part', (1.0::double / 3)::varchar] when contains(v, 'quarter') then ['part', '0.25'] when contains(v, 'fifth') then ['part', '0.2'] end
  when c_ta is not null then ['ta', c_ta::varchar] when c_eq is not null then ['eq', c_eq::varchar] when c_de is not null then ['de', c_de::varchar] when c_cov is not null then ['cov', c_cov::varchar]
  when base is not null then [base, x::varchar]
  when contains(note, 'coverage') then ['cov', x::varchar] when contains(note, 'hundredths') then ['bps', x::varchar] when contains(note, 'multiple of equity') then ['de', x::varchar] when contains(note, 'decimal share') then ['part', x::varchar]
  end as q from kind),
l as (select extraction_id, field_name, case q[1] when 'de' then q[2]::double / (1 + q[2]::double) * 10000 when 'eq' then q[2]::double / (100 + q[2]::double) * 10000 when 'cov' then 1e6 / q[2]::double
  when 'bps' then q[2]::double when 'part' then q[2]::double * 10000 when 'ta' then q[2]::double * 100 end as y from lev where q is not null and not (q[1] = 'ta' and (not bare or abs(c_ta - x) < 1e-9)))
select * from d union all select extraction_id, field_name, floor(y + 0.5 + 1e-9)::bigint from l"""

_P3 = """
with b as (select record_id, case when json_valid(replace(body, chr(65279), '')) then replace(body, chr(65279), '')::json end as j from raw_nested),
s as (select record_id, case when json_type(j) = 'VARCHAR' and json_valid(replace(j->>'$', chr(65279), '')) then replace(j->>'$', chr(65279), '')::json else j end as j from b),
a as (select record_id, case when json_type(j) = 'ARRAY' then j->0 else j end as j from s),
u as (select record_id, case when json_type(j) = 'OBJECT' then case when len(list_intersect(json_keys(j), ['fields', 'per_fund', 'per_field'])) > 0 then j else coalesce(j->'ground_truth', j->'evaluation', j) end end as j from a),
part as (select record_id, unnest([{'t': 'fields', 'x': j->'fields'}, {'t': 'per_fund', 'x': j->'per_fund'}, {'t': 'per_field', 'x': j->'per_field'}], recursive := true) from u where j is not null),
e as (select record_id, t, k, json_extract(x, '/' || replace(replace(k, '~', '~0'), '/', '~1')) as v from (select *, unnest(json_keys(x)) as k from part where json_type(x) = 'OBJECT')
  union all select record_id, t, coalesce(v->>'field_path', v->>'fund_name', ''), v from (select *, unnest(x::json[]) as v from part where json_type(x) = 'ARRAY')),
top as (select record_id, t as child_table, '' as parent_key, 0::bigint as child_ord, k as child_key from e),
sc as (select record_id, k, case when json_type(v) = 'OBJECT' and list_contains(json_keys(v), 'expected') then v->'expected' else v end as x from e where t = 'fields' and k = 'share_classes.share_classes'),
sct as (select record_id, k, case when json_type(x) = 'VARCHAR' and json_valid(x->>'$') then (x->>'$')::json else x end as x from sc),
scl as (select record_id, k, case json_type(x) when 'ARRAY' then x::json[] when 'OBJECT' then [x] else [] end as l from sct),
sce as (select record_id, k, unnest(l) as r, generate_subscripts(l, 1) as i from scl where len(l) > 0),
errs as (select record_id, k, unnest(json_keys(v->'error_breakdown')) as err from e where t = 'per_fund' and json_type(v->'error_breakdown') = 'OBJECT'),
fl as (select record_id, k, unnest([{'t': 'funds_correct', 'l': v->'funds_correct'}, {'t': 'funds_incorrect', 'l': v->'funds_incorrect'}], recursive := true) from e where t = 'per_field'),
fle as (select record_id, t, k, unnest(l::json[]) as f, generate_subscripts(l::json[], 1) as i from fl where json_type(l) = 'ARRAY' and json_array_length(l) > 0)
select * from top
union all select record_id, 'share_classes', k, i::bigint, coalesce(r->>'class_name', '') from sce where json_type(r) = 'OBJECT'
union all select record_id, 'error_breakdown', k, 0, err from errs
union all select record_id, t, k, i::bigint, f->>'$' from fle"""

_ENTRIES = _P3[: _P3.index("top as (")].rstrip().rstrip(",")


def _casts(x: str, **columns: str) -> str:
    return ", ".join(f"try_cast({x}->>'{c}' as {t}) as {c}" for c, t in columns.items())


_FUNDS = f"{_ENTRIES} select record_id, k as fund_name, {_casts('v', accuracy='double', precision='double', recall='double', f1_score='double', total_fields='int', correct_fields='int')} from e where t = 'per_fund'"
_BODIES = f"{_ENTRIES} select record_id, 0::int as body_ord, {_casts('j', fund_name='varchar', cik='varchar', filing_date='date', form_type='varchar', verified_by='varchar', notes='varchar', run_id='varchar', ground_truth_version='varchar')} from u where json_type(j) = 'OBJECT' "
_FIELDS = f"""{_ENTRIES}
select record_id, k as field_path, case when json_type(v) = 'OBJECT' then case when json_type(v->'expected') not in ('OBJECT', 'ARRAY') then v->>'expected' end else v->>'$' end as given,
  {_casts("v", nullable="boolean", tolerance="double", match_mode="varchar", source_section="varchar", source_quote="varchar")} from e where t = 'fields'"""
_CLASSES = f"""{_P3[: _P3.index("errs as (")].rstrip().rstrip(",")}
select record_id, k as field_path, i::bigint as ord, coalesce(r->>'class_name', '') as class_name, {_casts("r", minimum_initial_investment="bigint", minimum_additional_investment="bigint", sales_load_pct="double", distribution_fee_pct="double")} from sce where json_type(r) = 'OBJECT'"""
_ERRORS = f"{_ENTRIES}, x as (select record_id, k, v->'error_breakdown' as b from e where t = 'per_fund' and json_type(v->'error_breakdown') = 'OBJECT') select record_id, k as fund_name, err as error_type, try_cast(b->>err as bigint) as n from (select *, unnest(json_keys(b)) as err from x)"
_FIELD_RESULTS = f"{_ENTRIES} select record_id, k as field_path, {_casts('v', total='int', correct='int')} from e where t = 'per_field'"
_FUND_LISTS = f"{_P3[: _P3.index('select * from top')]} select record_id, t as list_name, k as field_path, i::bigint as ord, f->>'$' as fund_name from fle"

_MEMBERS = f"""{_P3[: _P3.index("errs as (")].rstrip().rstrip(",")},
lists as (select record_id, k, unnest([{{'t': 'funds_correct', 'l': v->'funds_correct'}}, {{'t': 'funds_incorrect', 'l': v->'funds_incorrect'}}], recursive := true) from e where t = 'per_field'),
held as (select s.*, case when json_type(e.v) = 'OBJECT' and list_contains(json_keys(e.v), 'expected') then 'expected' else '' end as p from sct s join e on e.record_id = s.record_id and e.k = s.k and e.t = 'fields')
select record_id, 'bodies' as parent_table, '' as parent_key, 'overall.' || o as member_path, (j->'overall')->>o as value from (select record_id, j, unnest(json_keys(j->'overall')) as o from u where json_type(j->'overall') = 'OBJECT')
union all select record_id, 'bodies', '', t, x::varchar from part where x::varchar in ('{{}}', '[]')
union all select record_id, 'per_field', k, t, '[]' from lists where json_type(l) = 'ARRAY' and json_array_length(l) = 0
union all select record_id, 'fields', k, p, '[]' from held where json_type(x) = 'ARRAY' and json_array_length(x) = 0
union all select record_id, 'fields', k, p || '[' || i || ']', r->>'$' from (select *, unnest(x::json[]) as r, generate_subscripts(x::json[], 1) as i from held where json_type(x) = 'ARRAY' and json_array_length(x) > 0) where coalesce(json_type(r), 'NULL') <> 'OBJECT'"""

SQL: dict[str, str] = {
    "p3_funds": _FUNDS,
    "p3_bodies": _BODIES,
    "p3_fields": _FIELDS,
    "p3_share_classes": _CLASSES,
    "p3_errors": _ERRORS,
    "p3_field_results": _FIELD_RESULTS,
    "p3_fund_lists": _FUND_LISTS,
    "p3_members": _MEMBERS,
    "p1_found": _P1,
    "p3_found": _P3,
    "p4_found": _P4,
    "p4_report": f"select table_name, period, orphan_kind, count(*) as n from ({_P4}) group by all",
    "p5_found": _P5,
    "p5_others": _OTHERS,
    "p5_failures": _FAILURES,
}
