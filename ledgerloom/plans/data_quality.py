"""Queries of the core data problems: nested records (1), units (2), orphan references (3)."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.nested import INVOICE, flatten_records
from ledgerloom.operators import units
from ledgerloom.operators.orphans import orphan_counts, orphan_references
from ledgerloom.operators.units import normalise_quantities
from ledgerloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = flatten_records(read_table(spark, sf_dir, "approved_batch"))

    def rows(df: DataFrame, line_pos: int, tax_pos: object, tax_type: object) -> DataFrame:
        text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        return df.select(
            "record_id",
            text("document_id"),
            F.element_at("positions", line_pos).alias("line_pos"),
            text("line_id"),
            tax_pos.cast("int").alias("tax_pos"),
            F.coalesce(tax_type, F.lit("")).alias("tax_type"),
            text("region_pack_id"),
            text("source_family"),
        )

    taxes = rows(tables["taxes"], 2, F.element_at("positions", 3), F.col("tax_type"))
    return taxes.unionByName(rows(tables["lines"].where("n_taxes = 0"), 2, F.lit(0), F.lit("")))


def _flat(tag: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the detail of a reject is the reader's own message
        return flatten_records(read_table(spark, sf_dir, "approved_batch"))[tag].drop("positions", "detail")

    return query


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise_quantities(read_table(spark, sf_dir, "line_items"))
    return rows.where(F.col("quantity_milli").isNotNull() & ~F.col("is_common")).select("row_id", "common_unit", "quantity_milli")


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise_quantities(read_table(spark, sf_dir, "line_items"))
    return rows.select("row_id", "unit_source", "unit", "common_unit", "quantity_milli", F.round("price_per_common_unit", 6).alias("price_per_common_unit"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices, lines, taxes = (read_table(spark, sf_dir, t) for t in ("invoices", "line_items", "tax_breakdowns"))
    doc = ["document_id"]
    found = [
        orphan_references(read_table(spark, sf_dir, t), invoices, doc, doc, deleted_at="deleted_at").withColumns({"child_table": F.lit(t), "ref_field": F.lit("document_id")})
        for t in ("parties", "line_items", "tax_breakdowns")
    ]
    both = ["document_id", "line_id"]
    found.append(orphan_references(taxes, lines, both, both).withColumns({"child_table": F.lit("tax_breakdowns"), "ref_field": F.lit("line_id")}))
    return reduce(DataFrame.unionByName, found).withColumn("ref_month", F.date_format("received_at", "yyyy-MM"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("child_table", "row_id", "ref_field", "reason", "ref_month")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_references(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_invoices": _flat("invoices"),
    "p1_lines": _flat("lines"),
    "p1_taxes": _flat("taxes"),
    "p1_rejects": _flat("rejects"),
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
}

_KEY = "nullif(regexp_replace(lower({}), '^[\\s ]+|[\\s ]+$', '', 'g'), '')"
_P3 = f"""
with inv as (
  select {_KEY.format('document_id')} as k, received_at, deleted_at from invoices),
inv_k as (
  select k, count(*) as n, count(received_at) as nr, min(received_at) as first_at, count(deleted_at) as nd, max(deleted_at) as gone_at
  from inv where k is not null group by k),
child as (
  select 'parties' as child_table, row_id, {_KEY.format('document_id')} as k, received_at from parties
  union all select 'line_items', row_id, {_KEY.format('document_id')}, received_at from line_items
  union all select 'tax_breakdowns', row_id, {_KEY.format('document_id')}, received_at from tax_breakdowns),
doc_refs as (
  select child_table, row_id, 'document_id' as ref_field,
    case when n is null then 'missing' when nr = n and child.received_at < first_at then 'late'
         when nd = n and child.received_at >= gone_at then 'deleted' end as reason, received_at
  from child left join inv_k using (k) where k is not null),
line_k as (
  select {_KEY.format('document_id')} as k, {_KEY.format('line_id')} as l, count(*) as n, count(received_at) as nr, min(received_at) as first_at
  from line_items group by 1, 2),
line_refs as (
  select 'tax_breakdowns' as child_table, row_id, 'line_id' as ref_field,
    case when n is null then 'missing' when nr = n and t.received_at < first_at then 'late' end as reason, received_at
  from (select row_id, {_KEY.format('document_id')} as k, {_KEY.format('line_id')} as l, received_at from tax_breakdowns) t
  left join line_k using (k, l) where t.k is not null and t.l is not null),
refs as (
  select child_table, row_id, ref_field, reason, strftime(received_at at time zone 'UTC', '%Y-%m') as ref_month from (select * from doc_refs union all select * from line_refs) where reason is not null)
"""
SQL = {
    "p3_found": _P3 + "select child_table, row_id, ref_field, reason, ref_month from refs",
    "p3_counts": _P3 + "select child_table, ref_field, ref_month, reason, count(*) as n_rows from refs group by all",
}

_LEVELS = {"lines": INVOICE.children[1], "taxes": INVOICE.children[0], "invoices": INVOICE}


def _walk(name, base, marks, texts):
    """CTE `name`: objects with any of the marks below the values `j` of `base` (columns k, path, j), in order."""
    ms=", ".join(f"'{m}'" for m in sorted(marks))
    child = "true" if texts else "json_type(v) in ('OBJECT','ARRAY')"
    return f"""{name}_w(k, path, j) as (select k, path, j from ({base}) where j is not null union all
      select k, list_append(path, i), v from (
        select k, path, generate_subscripts(vs, 1) as i, unnest(vs) as v, json_type(j) = 'OBJECT' as o from (
          select k, path, j, case json_type(j) when 'ARRAY' then cast(j as json[]) when 'OBJECT' then list_transform(json_keys(j), lambda x: json_extract(j, '$."' || x || '"'))
            else case when regexp_matches(json_extract_string(j, '$'), '^\\s*[\\[{{]') and json_valid(json_extract_string(j, '$')) then [cast(json_extract_string(j, '$') as json)] else [] end end as vs
          from {name}_w where json_type(j) in ('ARRAY', 'VARCHAR') or json_type(j) = 'OBJECT' and not list_has_any(json_keys(j), [{ms}])))
      where not o or {child}),
    {name} as (select *, cast(row_number() over (partition by k order by path) as int) as pos from {name}_w where json_type(j) = 'OBJECT' and list_has_any(json_keys(j), [{ms}]))"""


def _text(j,*paths):
    one=lambda p: f"case when json_type(json_extract({j}, '$.{p}')) not in ('OBJECT','ARRAY','NULL') then json_extract_string({j}, '$.{p}') end"
    return "coalesce(" + ", ".join(map(one,paths)) + ")"


def _columns(tag: str, j: str = "j") -> str:
    return ", ".join(f"{_text(j, *('.'.join(p) for p in paths))} as {c}" for c, paths in _LEVELS[tag].columns.items())


_P1 = f"""with recursive {_walk('r', "select struct_pack(record_id := record_id, n := row_number() over ()) as k, [0::bigint] as path, case when json_valid(ltrim(payload, chr(65279))) then cast(ltrim(payload, chr(65279)) as json) end as j from approved_batch", INVOICE.marks, True)},
inv as (select k.record_id as record_id, struct_pack(k := k, pos := pos) as k, {_columns('invoices')}, j from r),
lists as (select k, [list_position(json_keys(j), 'line_items')::bigint] as path, json_extract(j, '$.line_items') as j from inv where list_contains(json_keys(j), 'line_items')
  union all select k, [list_position(json_keys(j), 'sections')::bigint, i], json_extract(s, '$.line_items') from (select k, j, unnest(ss) as s, generate_subscripts(ss, 1) as i from (select k, j, case json_type(json_extract(j, '$.sections')) when 'ARRAY' then cast(json_extract(j, '$.sections') as json[]) when 'OBJECT' then [json_extract(j, '$.sections')] else [] end as ss from inv)) where json_type(s) = 'OBJECT'),
{_walk('l', "select * from lists", _LEVELS["lines"].marks, False)},
lines as (select k, pos, {_columns('lines')}, j from l),
{_walk('d', "select k, [0::bigint] as path, json_extract(j, '$.tax_breakdowns') as j from inv", _LEVELS["taxes"].marks, False)},
{_walk('t', "select struct_pack(k := k, pos := pos) as k, [0::bigint] as path, json_extract(j, '$.tax_breakdowns') as j from lines", _LEVELS["taxes"].marks, False)},
taxes as (select k, 0 as line_pos, cast(null as varchar) as line_id, pos as tax_pos, {_columns('taxes')} from d
 union all select l.k, l.pos, l.line_id, t.pos, {_columns('taxes', 't.j')} from t join lines l on t.k.k = l.k and t.k.pos = l.pos)
"""
_HEAD = "document_id, region_pack_id, source_family"
_P1_SQL = {
    "p1_found": """select record_id, coalesce(document_id, '') as document_id, line_pos, coalesce(line_id, '') as line_id, tax_pos, coalesce(tax_type, '') as tax_type, coalesce(region_pack_id, '') as region_pack_id, coalesce(source_family, '') as source_family
from (select k, line_pos, line_id, tax_pos, tax_type from taxes union all select k, pos, line_id, 0, '' from lines l where not exists (select 1 from t where t.k.k = l.k and t.k.pos = l.pos)) join inv using (k)""",
    "p1_invoices": f"""select record_id, cast(k.pos as varchar) as row_key, cast(null as varchar) as parent_key, {", ".join(INVOICE.columns)}, coalesce(nt, 0) as n_taxes, coalesce(nl, 0) as n_lines
from inv left join (select k, cast(count(*) as int) as nt from d group by k) using (k) left join (select k, cast(count(*) as int) as nl from l group by k) using (k)""",
    "p1_lines": f"""select record_id, k.pos || '.' || lines.pos as row_key, cast(k.pos as varchar) as parent_key, {_HEAD}, {", ".join("lines." + c for c in _LEVELS["lines"].columns)}, coalesce(nt, 0) as n_taxes
from lines join inv using (k) left join (select k.k as k, k.pos as pos, cast(count(*) as int) as nt from t group by all) n using (k, pos)""",
    "p1_taxes": f"""select record_id, k.pos || '.' || line_pos || '.' || tax_pos as row_key, k.pos || case when line_pos > 0 then '.' || line_pos else '' end as parent_key, {_HEAD}, line_id, {", ".join("taxes." + c for c in _LEVELS["taxes"].columns)} from taxes join inv using (k)""",
}
SQL |= {name: _P1 + sql for name, sql in _P1_SQL.items()}
SQL["p1_rejects"] = f"""with recursive {_walk('r', "select record_id as k, [0::bigint] as path, case when json_valid(ltrim(payload, chr(65279))) then cast(ltrim(payload, chr(65279)) as json) end as j from approved_batch", INVOICE.marks, True)},
p as (select record_id, payload, case when json_valid(ltrim(payload, chr(65279))) then json_type(ltrim(payload, chr(65279))) end as kind from approved_batch)
select record_id, '0' as row_key, cast(null as varchar) as parent_key, case when payload is null or kind = 'NULL' then 'empty' when kind is null then 'unreadable' else 'no record' end as reason
from p where record_id not in (select k from r)"""

# Units in SQL: the names, exact or within a fifth of the letters by an edit distance with swaps; one unit only.
_NAMES = ", ".join(f"('{name}', '{unit}')" for name, unit in units._names())
_FACTS = ", ".join(f"('{u}', '{c}', {Fraction(f).numerator}::hugeint, {Fraction(f).denominator}::hugeint)" for u, (c, f, _) in units._UNITS.items())
_plain = lambda c: f"regexp_replace(translate(lower({c}), '²³', '23'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_NUM = "'^\\s*([-+−]?\\s*\\d[\\d.,''’\\s]*)'"
_SAID = [
    "\\[\\s*([^\\]\\d][^\\]]*?)\\s*\\]\\s*$", "(?:\\bUOM\\s*:|\\bunit of measure\\s*:?|\\bbilled (?:by|in|per)(?:\\s+the)?)\\s+(.+?)\\s*$",
    "\\b(?:quantity|qty|menge|quantité|qté|cantidad)\\s+(?:given\\s+)?(?:in|en)\\s+([^:()]+(?:\\(US\\))?)\\s*(?:\\)\\s*$|:|$)",
]
_UNIT_ROWS = f"""with names(name, unit) as (values {_NAMES}), facts(unit, common, num, den) as (values {_FACTS}),
li as (select row_id, quantity, trim(unit_code) as s0, case when not regexp_matches(quantity, '^-?\\d+(\\.\\d+)?$') then nullif(trim(regexp_replace(quantity, {_NUM}, '')), '') end as s1,
  coalesce({", ".join(f"nullif(trim(regexp_extract(description, '(?i){p}', 1)), '')" for p in _SAID)}) as s2 from line_items),
spelled as (select distinct s as spelling, {_plain('s')} as plain from (select s0 as s from li union all select s1 from li union all select s2 from li) where s is not null and {_plain('s')} not in ('', 'na', 'zz', 'none', 'null', 'unknown', 'tbd', 'xx')),
near as (select plain, unit, min(cost) as cost from (select distinct p.plain, n.unit, damerau_levenshtein(p.plain, n.name) as cost, least(length(p.plain), length(n.name)) as short from (select distinct plain from spelled) p join names n on p.plain = n.name or length(p.plain) > 3 and length(n.name) > 3 and abs(length(p.plain) - length(n.name)) <= 4) where cost = 0 or cost <= 0.2 * short group by 1, 2),
best as (select plain, min_by(unit, cost) as unit from near n where cost = (select min(cost) from near m where m.plain = n.plain) group by plain having count(*) = 1),
alias as (select spelling, unit, common, num, den from spelled join best using (plain) join facts using (unit)),
u as (select li.row_id, quantity, coalesce(a0.unit, a1.unit, a2.unit) as unit from li left join alias a0 on a0.spelling = s0 left join alias a1 on a1.spelling = s1 left join alias a2 on a2.spelling = s2),
q as (select row_id, unit, regexp_replace(replace(regexp_replace(regexp_extract(quantity, {_NUM}, 1), '[\\s''’]', '', 'g'), '−', '-'), '[.,]$', '') as d from u),
v as (select row_id, unit, case when regexp_matches(d, ',\\d{{1,2}}$') then replace(regexp_replace(regexp_replace(d, ',(\\d{{1,2}})$', '#\\1'), '[.,]', '', 'g'), '#', '.') else replace(d, ',', '') end as t from q)
select row_id, common as common_unit, cast(case when m < 0 then -1 else 1 end * ((2 * abs(m) * num + 1000 * den) // (2000 * den)) as bigint) as quantity_milli
from (select row_id, unit, cast(try_cast(t as decimal(24,6)) * 1000000 as hugeint) as m from v where regexp_matches(t, '^[-+]?\\d+(\\.\\d+)?$')) join facts using (unit) where m is not null and num <> den"""
SQL["p2_found"] = _UNIT_ROWS
