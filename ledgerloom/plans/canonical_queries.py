"""Queries of canonical documents over whole tables: the export tables and the rules, each with SQL written from their definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.operators import canonical as C
from ledgerloom.operators.validate import MONEY
from ledgerloom.plans.invoice_queries import TODAY, _txt, _values
from ledgerloom.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = "ground_truth"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.documents(read_table(spark, sf_dir, "canonical_records"))


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "manifest").where("ground_truth is not null").groupBy(KEY).agg(F.min("expected_status").alias("review_status"))


def _at(path: str, j: str = "record_json") -> str:
    return f"json_extract_string({j}, '$.{path}')"


def _elements(path: str, j: str = "record_json", keep: str = "") -> str:
    """Rows of an array: its elements x and their positions i from one."""
    return f"(select ground_truth, record_json{keep}, unnest(cast(json_extract({j}, '$.{path}') as json[])) as x, generate_subscripts(cast(json_extract({j}, '$.{path}') as json[]), 1) as i from {{source}})"


_INVOICE = {
    "document_id": "document_id", "schema_version": "schema_version", "document_type": "document_type", "source_family": "source.family", "source_profile": "source.profile", "language_tag": "locale.document_language",
    "supplier_country": "locale.supplier_country", "buyer_country": "locale.buyer_country", "supplier_name": "supplier.display_name", "buyer_name": "buyer.display_name", "invoice_number": "invoice.number", "issue_date": "invoice.issue_date",
    "due_date": "invoice.due_date", "currency": "invoice.currency", **{m: f"totals.{m}" for m in MONEY}, "region_pack": "locale.applied_region_pack.id",
}
_STATUS = "(select ground_truth, min(expected_status) as review_status from manifest where ground_truth is not null group by 1)"
_columns = lambda names, j="x": ", ".join(f"{_at(n, j)} as {n}" for n in names)
_ROLE_ROWS = " union all ".join(f"select ground_truth, record_json, '{r}' as role, 'party_{r}_1' as party_id, {_at('document_id')} as document_id, json_extract(record_json, '$.{r}') as p from canonical_records where json_type(json_extract(record_json, '$.{r}')) = 'OBJECT'" for r in C.ROLES)

SQL["export_invoices"] = f"select ground_truth, {', '.join(f'{_at(p)} as {n}' for n, p in _INVOICE.items())}, review_status from canonical_records left join {_STATUS} using (ground_truth)"
SQL["export_parties"] = f"""select ground_truth, party_id, document_id, role, {_columns(['display_name', 'legal_name', 'trading_name'], 'p')}, {_at('address.lines[0]', 'p')} as address_line_1, {', '.join(f"{_at('address.' + c, 'p')} as {c}" for c in ('city', 'subdivision', 'postal_code', 'country_code'))} from ({_ROLE_ROWS})"""
SQL["export_identifiers"] = f"""with r as ({_ROLE_ROWS}) select ground_truth, party_id, document_id, role, cast(i as int) as ordinal, {_columns(['scheme', 'value', 'issuing_country', 'purpose'])}
from {_elements('identifiers', 'p', ', party_id, document_id, role').format(source='r')}"""
SQL["export_lines"] = f"select ground_truth, {_at('document_id')} as document_id, cast(i as int) as ordinal, {_columns(C.LINE_COLUMNS)} from {_elements('line_items').format(source='canonical_records')}"
SQL["export_taxes"] = f"""with l as (select ground_truth, record_json, x as l, i as n from {_elements('line_items').format(source='canonical_records')})
select ground_truth, 'tax_doc_' || i as tax_id, {_at('document_id')} as document_id, cast(null as varchar) as line_id, {_columns(C.TAX_COLUMNS)} from {_elements('tax_breakdowns').format(source='canonical_records')}
union all select ground_truth, 'tax_line_' || coalesce({_at('line_no', 'l')}, '') || '_' || i, {_at('document_id')}, {_at('line_id', 'l')}, {_columns(C.TAX_COLUMNS)} from {_elements('tax_breakdowns', 'l', ', l').format(source='l')}"""


def export_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.invoice_table(_docs(spark, sf_dir), KEY, _statuses(spark, sf_dir))


QUERIES["export_invoices"] = export_invoices
for _name, _table in (("parties", C.party_table), ("identifiers", C.identifier_table), ("lines", C.line_table), ("taxes", C.tax_table)):
    QUERIES[f"export_{_name}"] = lambda spark, sf_dir, table=_table: table(_docs(spark, sf_dir), KEY)


# One query per rule. SQL: amounts are text of the document; D(x) its decimal, Z(x) zero for what is none.
_PAT = r"'^-?\d{1,20}(\.\d{1,8})?$'"
_D = lambda e: f"case when regexp_matches({e}, {_PAT}) then try_cast({e} as decimal(28,8)) end"
_Z = lambda e: f"coalesce({_D(e)}, cast(0 as decimal(28,8)))"
_T = lambda c: _at(f"totals.{c}")
_CUR = f"upper(trim({_at('invoice.currency')}))"
_TOL = f"case {_CUR} " + " ".join(f"when '{c}' then cast('{ {0: '1', 2: '0.01', 3: '0.001'}[n] }' as decimal(28,8))" for c, n in D.MINOR_UNITS.items()) + " end"
_UNITS = f"case {_CUR} " + " ".join(f"when '{c}' then {n}" for c, n in D.MINOR_UNITS.items()) + " end"
_DATE = f"case when regexp_matches({_at('invoice.issue_date')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_cast({_at('invoice.issue_date')} as date) end"
_scale = lambda e: f"case when regexp_matches({e}, {_PAT}) then length(regexp_extract(regexp_replace({e}, '(\\.\\d*?)0+$', '\\1'), '\\.(\\d+)$', 1)) end"
_imprecise = lambda e: f"({_UNITS}) is not null and {e} <> '' and coalesce(({_scale(e)}) > ({_UNITS}), true)"


def _rule(code: str, severity: str, behavior: str | None, paths: str, where: str, observed: str = "null", calculated: str = "null", source: str = "canonical_records") -> str:
    return f"select ground_truth, '{code}' as code, '{severity}' as severity, {'null' if behavior is None else repr(behavior)}::varchar as behavior, {paths} as field_paths, cast({observed} as varchar) as observed, cast({calculated} as varchar) as calculated from {source} where {where}"


_SUMS = {
    "HEADER_TOTAL_MISMATCH": ("tax_exclusive_amount", f"({_Z(_T('line_extension_amount'))} - {_Z(_T('allowance_total_amount'))} + {_Z(_T('charge_total_amount'))})"),
    "TAX_INCLUSIVE_TOTAL_MISMATCH": ("tax_inclusive_amount", f"({_Z(_T('tax_exclusive_amount'))} + {_Z(_T('total_tax_amount'))})"),
    "PAYABLE_TOTAL_MISMATCH": ("payable_amount", f"({_Z(_T('tax_inclusive_amount'))} - {_Z(_T('prepaid_amount'))} - {_Z(_T('withholding_total_amount'))} + {_Z(_T('rounding_amount'))})"),
}
_LINES = _elements("line_items").format(source="canonical_records")
_TAXES = f"(select ground_truth, any_value(record_json) as record_json, sum({_Z(_at('tax_amount', 'x'))}) as s from {_elements('tax_breakdowns').format(source='canonical_records')} group by 1)"
_L = lambda c: f"cast({_D(_at(c, 'x'))} as decimal(28,8))"
_CHARGES = lambda flag: f"coalesce(list_sum(list_transform(list_filter(cast(json_extract(x, '$.allowances_charges') as json[]), lambda c: json_extract_string(c, '$.charge_indicator') = '{flag}'), lambda c: cast({_Z(_at('amount', 'c'))} as decimal(38,8)))), 0)"
_DUPLICATES = f"(select {_at('document_id')} as k, count(*) - 1 as n_matches from canonical_records group by 1 having count(*) > 1)"
_EVIDENCE = "[" + ", ".join(f"'{p}'" for p in C.EVIDENCE) + "]"
_RULES = {
    "DOCUMENT_TYPE_AMBIGUOUS": _rule("DOCUMENT_TYPE_AMBIGUOUS", "CRITICAL", "block_export", "'/document_type'", f"{_at('document_type')} = 'unknown'"),
    "CURRENCY_MISSING_OR_AMBIGUOUS": _rule("CURRENCY_MISSING_OR_AMBIGUOUS", "CRITICAL", "block_export", "'/invoice/currency'", f"coalesce({_at('invoice.currency')}, '') = ''"),
    "PAYABLE_AMOUNT_MISSING": _rule("PAYABLE_AMOUNT_MISSING", "CRITICAL", "block_export", "'/totals/payable_amount'", f"coalesce({_T('payable_amount')}, '') = ''"),
    "HIGH_RISK_EVIDENCE_MISSING": _rule("HIGH_RISK_EVIDENCE_MISSING", "HIGH", "block_export", "array_to_string(missing, ',')", "len(missing) > 0", source=f"(select ground_truth, list_filter({_EVIDENCE}, lambda p: not list_contains(list_transform(coalesce(cast(json_extract(record_json, '$.evidence') as json[]), []), lambda e: json_extract_string(e, '$.field_path')), p)) as missing from canonical_records)"),
    "AMBIGUOUS_DOCUMENT_DATE": _rule("AMBIGUOUS_DOCUMENT_DATE", "HIGH", None, "'/invoice/issue_date'", f"{_at('invoice.issue_date')} <> '' and ({_DATE}) is null"),
    "FUTURE_ISSUE_DATE": _rule("FUTURE_ISSUE_DATE", "HIGH", None, "'/invoice/issue_date'", f"({_DATE}) > date '{TODAY}'"),
    **{code: _rule(code, "CRITICAL", None, f"'/totals/{c}'", f"abs(({_D(_T(c))}) - {total}) > {_TOL}", _txt(_D(_T(c))), _txt(total)) for code, (c, total) in _SUMS.items()},
    "TAX_BREAKDOWN_CONFLICT": _rule("TAX_BREAKDOWN_CONFLICT", "HIGH", "require_confirmation", "'/tax_breakdowns,/totals/total_tax_amount'", f"abs(({_D(_T('total_tax_amount'))}) - s) > {_TOL}", _txt(_D(_T("total_tax_amount"))), _txt("cast(s as decimal(38,8))"), _TAXES),
    "CURRENCY_PRECISION_MISMATCH": " union all ".join(
        [_rule("CURRENCY_PRECISION_MISMATCH", "HIGH", None, f"'/totals/{m}'", _imprecise(_T(m)), _T(m)) for m in MONEY]
        + [_rule("CURRENCY_PRECISION_MISMATCH", "HIGH", None, f"'/line_items/' || (i - 1) || '/{c}'", _imprecise(_at(c, "x")), _at(c, "x"), source=_LINES) for c in C.LINE_MONEY]
    ),
    "LINE_ITEM_RECONCILIATION_FAILED": _rule("LINE_ITEM_RECONCILIATION_FAILED", "HIGH", "require_confirmation", f"'/line_items/' || coalesce({_at('line_no', 'x')}, '') || '/line_net_amount'", f"({_L('price_base_quantity')}) <> 0 and abs(({_L('line_net_amount')})::double + {_CHARGES('false')}::double - {_CHARGES('true')}::double - ({_L('quantity')})::double * ({_L('unit_price')})::double / ({_L('price_base_quantity')})::double) > ({_TOL})::double + 1e-9", _txt(_L("line_net_amount")), source=_LINES),
    "PROBABLE_DUPLICATE": _rule("PROBABLE_DUPLICATE", "CRITICAL", None, "'/document_id'", "true", "n_matches", source=f"canonical_records join {_DUPLICATES} on k = {_at('document_id')}"),
}


def _matches(docs: DataFrame) -> DataFrame:
    """Documents whose id others have too, with their number."""
    counts = docs.groupBy(F.col("d.document_id").alias("k")).agg((F.count(F.lit(1)) - 1).alias("n_matches")).where("k is not null and n_matches > 0")
    return docs.select(KEY, F.col("d.document_id").alias("k")).join(counts, "k")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return C.findings(docs, KEY, TODAY, _matches(docs), check_schema=False)


for _code, _sql in _RULES.items():
    _name = "rule_" + _code.lower()
    QUERIES[_name] = lambda spark, sf_dir, code=_code: _findings(spark, sf_dir).where(F.col("code") == code)
    SQL[_name] = _sql

_PAYLOADS = """(select 'r' || record_id as ground_truth, payload as record_json from approved_batch where json_valid(payload) and json_type(payload) = 'OBJECT' and json_type(json_extract(payload, '$.source')) = 'OBJECT')"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are one document with a source of its own, as canonical documents."""
    rows = read_table(spark, sf_dir, "approved_batch").select(F.concat(F.lit("r"), "record_id").alias(KEY), F.col("payload").alias("record_json"))
    return C.documents(rows.where(F.get_json_object("record_json", "$.source").startswith("{")))


for _code, _severity, _behavior, _where in (
    ("UNSUPPORTED_STRUCTURED_PROFILE", "HIGH", "quarantine", f"{_at('source.route')} = 'quarantine'"),
    ("UNKNOWN_SOURCE_ROUTE", "HIGH", None, f"coalesce({_at('source.route')}, '') not in ('quarantine', {', '.join(repr(r) for r in C.ROUTES)})"),
):
    _name = "rule_" + _code.lower()
    QUERIES[_name] = lambda spark, sf_dir, code=_code: C.findings(_payloads(spark, sf_dir), KEY, TODAY, check_schema=False).where(F.col("code") == code)
    SQL[_name] = _rule(_code, _severity, _behavior, "'/source/route'", _where, _at("source.route"), source=_PAYLOADS)

_KEYS = "json_keys(record_json)"
_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_bad = lambda name, test: f"case when list_contains({_KEYS}, '{name}') and not coalesce({test}, false) then ['/{name}'] else [] end"
_ERRORS = f"""list_concat(list_transform(list_filter({_list(C.REQUIRED)}, lambda k: not list_contains({_KEYS}, k)), lambda k: '/' || k), list_transform(list_filter({_KEYS}, lambda k: not list_contains({_list([*C.REQUIRED, *C.OPTIONAL])}, k)), lambda k: '/' || k),
 {_bad('document_type', f"{_at('document_type')} in ({', '.join(repr(t) for t in C.TYPES)})")}, {_bad('schema_version', f"{_at('schema_version')} = '2.0'")}, {_bad('document_id', f"length({_at('document_id')}) between 8 and 128")})"""
SQL["rule_schema_invalid"] = f"select ground_truth, 'SCHEMA_INVALID' as code, field_paths, count(*) over (partition by ground_truth) as n_of_document from (select ground_truth, unnest(case when json_valid(record_json) then {_ERRORS} else [''] end) as field_paths from canonical_records)"


def rule_schema_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema errors, and that a document with any has no other finding."""
    from pyspark.sql import Window

    found = C.findings(_docs(spark, sf_dir), KEY, TODAY)
    return found.select(KEY, "code", "field_paths", F.count(F.lit(1)).over(Window.partitionBy(KEY)).alias("n_of_document")).where("code = 'SCHEMA_INVALID'")


QUERIES["rule_schema_invalid"] = rule_schema_invalid

SQL["export_envelopes"] = f"""select ground_truth, 'm1.0' as export_version, {_at('schema_version')} as schema_version, review_status, sha256(record_json) as body_digest from canonical_records join {_STATUS} using (ground_truth) where review_status = 'ready_for_approval'"""


def export_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of every approved document; its body is the document as it is, here shown by its digest."""
    approved = _statuses(spark, sf_dir).where("review_status = 'ready_for_approval'")
    return _docs(spark, sf_dir).join(approved, KEY).select(KEY, F.lit("m1.0").alias("export_version"), "d.schema_version", "review_status", F.sha2("body", 256).alias("body_digest"))


QUERIES["export_envelopes"] = export_envelopes
