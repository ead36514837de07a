"""Queries of the document operators over whole tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X
from ledgerloom.operators import coerce, evaluate, fingerprint, history, mapping, merge, trees, validate
from ledgerloom.operators.orphans import normal_key
from ledgerloom.session import read_table
from ledgerloom.sources import sniff, structured
from ledgerloom.streaming import events as stream

TODAY = "2026-03-01"
CUT = "2026-01-01 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Pieces of SQL
_PAT = r"'^-?\d{1,20}(\.\d{1,8})?$'"


def _dec(c: str) -> str:
    return f"case when regexp_matches({c}, {_PAT}) then try_cast({c} as decimal(28,8)) end"


def _zero(c: str) -> str:
    return f"coalesce({_dec(c)}, cast(0 as decimal(28,8)))"


def _txt(e: str) -> str:
    v = f"cast({e} as varchar)"
    s = f"case when contains({v}, '.') then regexp_replace(regexp_replace({v}, '0+$', ''), '\\.$', '') else {v} end"
    return f"case when ({s}) = '-0' then '0' else ({s}) end"


_TOL = "case upper(trim(currency)) " + " ".join(f"when '{c}' then cast('{ {0: '1', 2: '0.01', 3: '0.001'}[n] }' as decimal(28,8))" for c, n in D.MINOR_UNITS.items()) + " end"
_UNITS = "case upper(trim(currency)) " + " ".join(f"when '{c}' then {n}" for c, n in D.MINOR_UNITS.items()) + " end"
_DATE = r"case when regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast({0} as date) end"
_DKEY = "nullif(regexp_replace(lower(document_id), '^[\\s ]+|[\\s ]+$', '', 'g'), '')"
_key = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _scale(c: str) -> str:
    return f"case when regexp_matches({c}, {_PAT}) then length(regexp_extract(regexp_replace({c}, '(\\.\\d*?)0+$', '\\1'), '\\.(\\d+)$', 1)) end"


def _finding(code: str, severity: str, path: str, cond: str) -> str:
    return f"select row_id, '{code}' as code, '{severity}' as severity, '{path}' as field_path from invoices where {cond}"


_EXCL = f"({_zero('line_extension_amount')} - {_zero('allowance_total_amount')} + {_zero('charge_total_amount')})"
_INCL = f"({_zero('tax_exclusive_amount')} + {_zero('total_tax_amount')})"
_PAY = f"({_zero('tax_inclusive_amount')} - {_zero('prepaid_amount')} - {_zero('withholding_total_amount')} + {_zero('rounding_amount')})"
_FINDINGS = " union all ".join(
    [
        _finding("DOCUMENT_TYPE_AMBIGUOUS", "CRITICAL", "/document_type", "document_type = 'unknown'"),
        _finding("CURRENCY_MISSING_OR_AMBIGUOUS", "CRITICAL", "/invoice/currency", "currency is null or currency = ''"),
        _finding("PAYABLE_AMOUNT_MISSING", "CRITICAL", "/totals/payable_amount", "payable_amount is null or payable_amount = ''"),
        _finding("AMBIGUOUS_DOCUMENT_DATE", "HIGH", "/invoice/issue_date", f"issue_date <> '' and ({_DATE.format('issue_date')}) is null"),
        _finding("FUTURE_ISSUE_DATE", "HIGH", "/invoice/issue_date", f"({_DATE.format('issue_date')}) > date '{TODAY}'"),
        _finding("HEADER_TOTAL_MISMATCH", "CRITICAL", "/totals/tax_exclusive_amount", f"abs(({_dec('tax_exclusive_amount')}) - {_EXCL}) > {_TOL}"),
        _finding("TAX_INCLUSIVE_TOTAL_MISMATCH", "CRITICAL", "/totals/tax_inclusive_amount", f"abs(({_dec('tax_inclusive_amount')}) - {_INCL}) > {_TOL}"),
        _finding("PAYABLE_TOTAL_MISMATCH", "CRITICAL", "/totals/payable_amount", f"abs(({_dec('payable_amount')}) - {_PAY}) > {_TOL}"),
        *[_finding("CURRENCY_PRECISION_MISMATCH", "HIGH", f"/totals/{m}", f"({_UNITS}) is not null and {m} <> '' and coalesce(({_scale(m)}) > ({_UNITS}), true)") for m in validate.MONEY],
    ]
)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.header_findings(read_table(spark, sf_dir, "invoices"), TODAY)
    return checked.select("row_id", "received_at", F.explode("findings").alias("f")).select("row_id", "received_at", "f.code", "f.severity", "f.field_path")


@query(_FINDINGS)
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).drop("received_at")


_WEIGHT = "case severity when 'CRITICAL' then 100 when 'HIGH' then 50 when 'MEDIUM' then 20 when 'LOW' then 5 else 1 end"


@query(f"""with f as ({_FINDINGS}), r as (select row_id, cast(sum({_WEIGHT}) as bigint) as risk_score, count(*) as n_findings from f group by row_id)
select r.row_id, risk_score, n_findings from r join invoices i on r.row_id = i.row_id order by risk_score desc, received_at, r.row_id limit 20""")
def risk_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = validate.risk(_findings(spark, sf_dir), "row_id").join(read_table(spark, sf_dir, "invoices").select("row_id", "received_at"), "row_id")
    return scored.orderBy(F.desc("risk_score"), "received_at", "row_id").limit(20).drop("received_at")


_RANK = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end"


@query(f"""select code, severity, count(*) as n_rows, cast(row_number() over (order by {_RANK}, code) as int) as place from ({_FINDINGS}) group by code, severity""")
def severity_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _findings(spark, sf_dir).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n_rows"))
    order = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).when(F.col("severity") == "LOW", 3).otherwise(4)
    return history.numbered(counts.withColumn("one", F.lit(1)), ["one"], [order, F.col("code")], "place").drop("one")


_LINE = r"case when regexp_matches({0}, '^-?\d{{1,9}}(\.\d{{1,8}})?$') then try_cast({0} as decimal(19,8)) end"


@query(f"""with cur as (select document_id, min(currency) as currency from invoices where document_id is not null group by 1),
t as (select row_id, {_LINE.format('line_net_amount')} as net, {_LINE.format('quantity')} as q, {_LINE.format('unit_price')} as p,
  case when price_base_quantity is null or price_base_quantity = '' then cast(1 as decimal(19,8)) else {_LINE.format('price_base_quantity')} end as base, cast({_TOL} as decimal(19,8)) as tol
  from line_items join cur using (document_id))
select row_id, {_txt('net')} as net from t where base <> 0 and abs(cast(net * base as decimal(38,12)) - cast(q * p as decimal(38,12))) > cast(tol * abs(base) as decimal(38,12))""")
def line_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.line_reconciliation(read_table(spark, sf_dir, "line_items"), read_table(spark, sf_dir, "invoices")).select("row_id", "net")


@query(f"""with s as (select document_id, sum({_zero('tax_amount')}) as s from tax_breakdowns where line_id is null and document_id is not null group by 1)
select row_id, {_txt('t')} as total_tax, {_txt('s')} as sum_tax from (select row_id, currency, {_dec('total_tax_amount')} as t, cast(s as decimal(38,8)) as s from invoices join s using (document_id)) where abs(t - s) > {_TOL}""")
def tax_breakdown_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.tax_conflicts(read_table(spark, sf_dir, "invoices"), read_table(spark, sf_dir, "tax_breakdowns"))


@query(f"""select row_id, cast(({_dec('payable_amount')}) * case ({_UNITS}) when 0 then 1 when 2 then 100 when 3 then 1000 end as bigint)::varchar as minor_units, {_txt(_dec('payable_amount'))} as payable_text,
cast({_scale('payable_amount')} as int) as payable_scale from invoices""")
def minor_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = D.parse(F.col("payable_amount"))
    units = D.minor_units(F.col("currency"))
    factor = F.when(units == 0, 1).when(units == 2, 100).when(units == 3, 1000)
    return read_table(spark, sf_dir, "invoices").select("row_id", (amount * factor).try_cast("bigint").cast("string").alias("minor_units"), D.text(amount).alias("payable_text"), D.scale(F.col("payable_amount")).alias("payable_scale"))


@query(f"""with f as (select row_id, {_key('supplier_name')} as a, {_key('buyer_name')} as b, {_key('invoice_number')} as c, cast({_DATE.format('issue_date')} as varchar) as d, upper(trim(currency)) as e,
  {_txt(_dec('payable_amount'))} as g, {_txt(_dec('total_tax_amount'))} as h from invoices),
k as (select * from f where a <> '' and c <> '' and d <> '' and e <> '' and g <> ''),
x as (select a, b, c, d, e, g, h, min(row_id) as first_row_id, count(*) as copies from k group by all having count(*) > 1)
select row_id, first_row_id, copies from k join x on k.a = x.a and k.c = x.c and k.d = x.d and k.e = x.e and k.g = x.g and coalesce(k.b, '') = coalesce(x.b, '') and coalesce(k.h, '') = coalesce(x.h, '')""")
def fingerprint_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.duplicates(read_table(spark, sf_dir, "invoices"))


@query("""with h as (select doc_id, sha256(text) as digest from documents where text is not null), g as (select digest, min(doc_id) as first, count(*) as copies from h group by 1)
select doc_id, digest, first, copies from h join g using (digest) where copies > 1""")
def content_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return history.first_seen(hashed, "digest", "doc_id").where("copies > 1")


def _fields(role: str) -> list:
    p = lambda k: F.get_json_object("record_json", f"$.{role}.{k}").alias(k.split(".")[-1])
    return [p("display_name"), p("legal_name"), p("address.city"), p("address.postal_code"), F.get_json_object("record_json", f"$.{role}.address.lines[0]").alias("line")]


def _party_sql(role: str) -> str:
    p = lambda k, n: f"json_extract_string(record_json, '$.{role}.{k}') as {n}"
    return f"select ground_truth, '{role}' as role, {p('display_name', 'display_name')}, {p('legal_name', 'legal_name')}, {p('address.city', 'city')}, {p('address.postal_code', 'postal_code')}, {p('address.lines[0]', 'line')} from canonical_records where json_extract_string(record_json, '$.{role}.display_name') is not null"


@query(" union all ".join(_party_sql(r) for r in ("supplier", "buyer")))
def decompose_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "canonical_records")
    parts = [records.select("ground_truth", F.lit(r).alias("role"), *_fields(r)).where("display_name is not null") for r in ("supplier", "buyer")]
    return parts[0].unionByName(parts[1])


_ID = "array<struct<scheme:string,value:string,issuing_country:string,purpose:string>>"


@query(" union all ".join(
    f"""select ground_truth, '{r}' as role, cast(i as int) as ordinal, json_extract_string(record_json, '$.{r}.identifiers[' || (i - 1) || '].scheme') as scheme, json_extract_string(record_json, '$.{r}.identifiers[' || (i - 1) || '].value') as value
    from (select ground_truth, record_json, unnest(range(1, 1 + cast(coalesce(json_array_length(record_json, '$.{r}.identifiers'), 0) as bigint))) as i from canonical_records)"""
    for r in ("supplier", "buyer")
))
def decompose_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read_table(spark, sf_dir, "canonical_records").select("ground_truth", F.from_json("record_json", f"supplier struct<identifiers:{_ID}>, buyer struct<identifiers:{_ID}>").alias("r"))
    roles = parsed.select("ground_truth", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"r.{r}.identifiers").alias("ids")) for r in ("supplier", "buyer")])).alias("p"))
    each = roles.select("ground_truth", "p.role", F.posexplode("p.ids").alias("i", "x"))
    return each.select("ground_truth", "role", (F.col("i") + 1).alias("ordinal"), "x.scheme", "x.value")


@query("""select ground_truth, cast(i as int) as line_pos, json_extract_string(record_json, '$.line_items[' || (i - 1) || '].line_id') as line_id, json_extract_string(record_json, '$.line_items[' || (i - 1) || '].quantity') as quantity
from (select ground_truth, record_json, unnest(range(1, 1 + cast(coalesce(json_array_length(record_json, '$.line_items'), 0) as bigint))) as i from canonical_records)""")
def decompose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read_table(spark, sf_dir, "canonical_records").select("ground_truth", F.from_json("record_json", "line_items array<struct<line_id:string,quantity:string>>").alias("r"))
    return parsed.select("ground_truth", F.posexplode("r.line_items").alias("i", "x")).select("ground_truth", (F.col("i") + 1).alias("line_pos"), "x.line_id", "x.quantity")


@query("""with b as (select doc_id, text as t, ltrim(text, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) as s from documents where text is not null)
select doc_id, case when starts_with(t, '%PDF') then 'pdf' when starts_with(s, '<') then 'xml' when starts_with(s, '{') or starts_with(s, '[') then 'json' else 'unknown' end as format, octet_length(encode(t)) as n_bytes,
cast(len(regexp_extract_all(t, '<[A-Za-z/!?]')) as int) as n_tags, regexp_matches(t, '(?i)<!(DOCTYPE|ENTITY)') as has_dtd from b""")
def upload_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return sniff.inspected(blobs, "content").select("doc_id", "format", "n_bytes", "n_tags", "has_dtd")


_XML = """'<?xml version="1.0"?><inv:Invoice xmlns:inv="urn:x"><cbc:ID>' || coalesce(invoice_number, '') || '</cbc:ID><cbc:IssueDate>' || coalesce(issue_date, '') || '</cbc:IssueDate><cac:AccountingSupplierParty><cac:Party><cbc:Name schemeID="n">' || coalesce(supplier_name, '') || '</cbc:Name></cac:Party></cac:AccountingSupplierParty><cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="X">' || coalesce(payable_amount, '') || '</cbc:PayableAmount></cac:LegalMonetaryTotal></inv:Invoice>'"""


@query("""select row_id, nullif(trim(invoice_number), '') as number, nullif(trim(issue_date), '') as issue_date, nullif(trim(supplier_name), '') as supplier_name, nullif(trim(payable_amount), '') as payable_amount from invoices""")
def xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = read_table(spark, sf_dir, "invoices").select("row_id", F.expr(_XML).alias("x"))
    x = F.col("x")
    return xml.select("row_id", X.first_tag(x, "id").alias("number"), X.first_tag(x, "IssueDate").alias("issue_date"), X.nested_tag(x, "AccountingSupplierParty", "Party", "Name").alias("supplier_name"), X.nested_tag(x, "LegalMonetaryTotal", "PayableAmount").alias("payable_amount"))


@query("""select row_id, case when regexp_matches(quantity, '^[=+\\-@]') then '''' || quantity else quantity end as quantity, case when regexp_matches(description, '^[=+\\-@]') then '''' || description else description end as description from line_items""")
def formula_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "line_items").select("row_id", X.neutral(F.col("quantity")).alias("quantity"), X.neutral(F.col("description")).alias("description"))


@query(f"""select row_id, {_key('supplier_name')} as name_key, lower(regexp_replace(regexp_replace(buyer_name, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) as name_scalar, regexp_replace(lower(buyer_name), '\\s+', '', 'g') as name_squeezed from invoices""")
def key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "invoices").select("row_id", X.key(F.col("supplier_name")).alias("name_key"), X.scalar(F.col("buyer_name")).alias("name_scalar"), X.squeezed(F.col("buyer_name")).alias("name_squeezed"))


def _coerce_sql(c: str, kind: str, ok: str, value: str) -> str:
    return f"case when {c} is null or {c} = '' then null when {ok} then {value} end as {c}_value, case when {c} is null or {c} = '' then null when coalesce({ok}, false) then null else 'not_{kind}' end as {c}_issue"


@query(f"""select row_id, {_coerce_sql('payable_amount', 'decimal', f"({_dec('payable_amount')}) is not null", _txt(_dec('payable_amount')))},
{_coerce_sql('issue_date', 'date', f"({_DATE.format('issue_date')}) is not null", f"cast({_DATE.format('issue_date')} as varchar)")}, {_coerce_sql('due_date', 'date', f"({_DATE.format('due_date')}) is not null", f"cast({_DATE.format('due_date')} as varchar)")} from invoices""")
def coerce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"payable_amount": ("decimal", "numeric"), "issue_date": ("date", "date"), "due_date": ("date", "date")}
    out = read_table(spark, sf_dir, "invoices").select("row_id", *[coerce.coerced(F.col(c), *k).alias(c) for c, k in kinds.items()])
    return out.select("row_id", *[F.col(f"{c}.{p}").alias(f"{c}_{p}") for c in kinds for p in ("value", "issue")])


def _delivered(spark: SparkSession, sf_dir: str, table: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, table).withColumn("doc_key", normal_key("document_id")).where("doc_key is not null")
    return rows.where(F.col("received_at") < F.lit(CUT).cast("timestamp")), rows.where(F.col("received_at") >= F.lit(CUT).cast("timestamp"))


_CUT = f"timestamptz '{CUT}+00'"


@query(f"""with r as (select *, {_DKEY} as doc_key from invoices), b as (select * from r where doc_key is not null and received_at < {_CUT}),
i as (select * from r where doc_key is not null and received_at >= {_CUT}), l as (select *, row_number() over (partition by doc_key order by received_at desc, row_id desc) as n from i)
select doc_key, row_id, payable_amount from b where doc_key not in (select doc_key from i) union all select doc_key, row_id, payable_amount from l where n = 1""")
def push_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _delivered(spark, sf_dir, "invoices")
    columns = ["doc_key", "row_id", "payable_amount"]
    return merge.upsert(base.select(*columns), new.select(*columns, "received_at"), ["doc_key"], ["received_at", "row_id"])


@query(f"""with r as (select distinct {_DKEY} as doc_key, received_at >= {_CUT} as new from invoices where {_DKEY} is not null and received_at is not null), k as (select doc_key, bool_or(new) as n, bool_or(not new) as o from r group by 1)
select count(*) filter (n and not o) as inserted, count(*) filter (n and o) as updated, count(*) filter (o and not n) as kept from k""")
def push_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _delivered(spark, sf_dir, "invoices")
    return merge.upsert_counts(base, new, ["doc_key"])


@query(f"""with r as (select *, {_DKEY} as doc_key from line_items), b as (select * from r where doc_key is not null and received_at < {_CUT}), i as (select * from r where doc_key is not null and received_at >= {_CUT})
select doc_key, row_id, line_id from b where doc_key not in (select doc_key from i) union all select doc_key, row_id, line_id from i""")
def line_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _delivered(spark, sf_dir, "line_items")
    return merge.replace_children(base.select("doc_key", "row_id", "line_id"), new, "doc_key")


@query("select ground_truth from canonical_records where ground_truth not in (select ground_truth from manifest where ground_truth is not null)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "canonical_records").join(read_table(spark, sf_dir, "manifest"), "ground_truth", "left_anti").select("ground_truth")


@query("select manifest_id from manifest m where exists (select 1 from canonical_records c where c.ground_truth = m.ground_truth)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "manifest").join(read_table(spark, sf_dir, "canonical_records"), "ground_truth", "left_semi").select("manifest_id")


@query(f"""select doc_key, row_id, n_deliveries from (select {_DKEY} as doc_key, row_id, row_number() over (partition by {_DKEY} order by received_at desc, row_id desc) as n, count(*) over (partition by {_DKEY}) as n_deliveries from invoices where {_DKEY} is not null) where n = 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "invoices").select(normal_key("document_id").alias("doc_key"), "received_at", "row_id").where("doc_key is not null")
    return rows.groupBy("doc_key").agg(F.max(F.struct("received_at", "row_id")).alias("m"), F.count(F.lit(1)).alias("n_deliveries")).select("doc_key", "m.row_id", "n_deliveries")


@query(f"""select row_id, cast(row_number() over w as int) as revision, coalesce(lead(row_id) over w, 0) as superseded_by from (select {_DKEY} as k, row_id, received_at from invoices where {_DKEY} is not null) window w as (partition by k order by received_at, row_id)""")
def revision_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read_table(spark, sf_dir, "invoices").select(normal_key("document_id").alias("k"), "received_at", "row_id").where("k is not null")
    order = [F.col("received_at"), F.col("row_id")]
    numbered = history.numbered(rows, ["k"], order)
    return numbered.withColumn("superseded_by", F.coalesce(F.lead("row_id").over(Window.partitionBy("k").orderBy(*order)), F.lit(0))).select("row_id", "revision", "superseded_by")


@query("""select event_id, running, running <= 50000 as accepted from (select event_id, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as running from events)""")
def spend_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return history.within_limit(events, "user_id", ["ts", "event_id"], "cents", 50_000).select("event_id", "running", "accepted")


@query("""select region_pack, count(*) as total, count(*) filter (lower(review_status) = 'approved') as approved, count(*) filter (review_status is null) as open, cast(round(100.0 * count(*) filter (lower(review_status) = 'approved') / count(*)) as bigint) as percent,
bool_and(review_status is not null) as complete, case when bool_and(review_status is not null) then 'completed' when bool_or(lower(review_status) = 'approved') then 'review' else 'processing' end as state from invoices group by region_pack""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.lower("review_status") == "approved"
    known = F.col("review_status").isNotNull()
    out = read_table(spark, sf_dir, "invoices").groupBy("region_pack").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("approved"), F.count_if(~known).alias("open"), F.bool_and(known).alias("complete"), F.bool_or(done).alias("any")
    )
    state = F.when(F.col("complete"), "completed").when(F.coalesce("any", F.lit(False)), "review").otherwise("processing")
    return out.select("region_pack", "total", "approved", "open", F.round(F.col("approved") * 100 / F.col("total")).cast("bigint").alias("percent"), "complete", state.alias("state"))


@query("""select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as most, printf('%.6f', count(*) filter (value > 100) / count(*)) as rate from events group by event_type""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.format_string("%.6f", F.count_if(F.col("value") > 100) / F.count(F.lit(1)))
    events = read_table(spark, sf_dir, "events")
    totals = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), rate.alias("rate"))
    return totals.join(evaluate.percentiles(events, "event_type", "value", 0.5, 0.95), "event_type")


@query("""select user_id, event_type as best_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by 1, 2) where k = 1""")
def argmax_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("best_type"), F.max("n").alias("n"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "canonical_records")
    joined = read_table(spark, sf_dir, "manifest").join(records.select("ground_truth", "record_json"), "ground_truth")
    at = lambda path: F.get_json_object("record_json", path)
    fields = [("currency", at("$.invoice.currency"), "exact"), ("document_type", at("$.document_type"), "normalized"), ("country", at("$.locale.supplier_country"), "exact")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), evaluate.outcome(F.col(n), o, mode).alias("outcome")) for n, o, mode in fields]))
    return joined.select(F.col("manifest_id").alias("case_id"), "kind", each.alias("c")).select("case_id", "kind", "c.field", "c.outcome")


def _cmp(f: str, path: str, norm: bool = False) -> str:
    e, o = f, f"json_extract_string(record_json, '{path}')"
    n = (lambda c: f"lower(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))") if norm else (lambda c: c)
    return f"select manifest_id as case_id, kind, '{f}' as field, case when {e} is null or {o} is null then 'field_missing' when {n(e)} = {n(o)} then 'matched' else 'mismatch' end as outcome from manifest join canonical_records using (ground_truth)"


_GOLD = " union all ".join([_cmp("currency", "$.invoice.currency"), _cmp("document_type", "$.document_type", True), _cmp("country", "$.locale.supplier_country")])


@query(_GOLD)
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@query(f"""select kind, field, count(distinct case_id) as n_cases, count(*) as n_fields, count(*) filter (outcome = 'matched') as n_matched, printf('%.6f', count(*) filter (outcome = 'matched') / count(*)) as accuracy from ({_GOLD}) group by rollup(kind, field)""")
def golden_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_compared(spark, sf_dir), "kind", "field")


# An external schema and synonyms, as small literal tables
_SOURCE = [(1, "document_id", "text", True), (2, "invoice_number", "text", True), (3, "issue_date", "date", False), (4, "payable_amount", "decimal", True), (5, "supplier_name", "text", False), (6, "currency", "text", False), (7, "buyer_name", "text", False)]
_TARGET = [("customer_invoices", "DocumentId", "varchar(64)", False, False), ("customer_invoices", "number", "text", False, False), ("customer_invoices", "invoice_date", "date", True, False), ("customer_invoices", "total", "numeric(18,2)", False, False), ("customer_invoices", "vendor", "integer", True, False), ("customer_invoices", "created_at", "timestamp", False, True), ("customer_invoices", "tenant", "text", False, False), ("ledger", "currency", "blob", True, False), ("ledger", "total", "numeric", True, False)]
_SYNONYMS = [("invoice_number", 1, "number"), ("invoice_number", 2, "invoice_no"), ("issue_date", 1, "invoice_date"), ("payable_amount", 1, "total"), ("payable_amount", 2, "amount_due"), ("supplier_name", 1, "vendor"), ("buyer_name", 1, "vendor")]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)
_MAPWITH = f"""with s(source_pos, source_column, kind, required) as (values {_values(_SOURCE)}), t(target_table, target_column, data_type, nullable, has_default) as (values {_values(_TARGET)}), y(source_column, priority, synonym) as (values {_values(_SYNONYMS)}),
w as (select source_pos, source_column, 0 as priority, {_key('source_column')} as name from s union all select source_pos, s.source_column, priority, {_key('synonym')} from s join y on s.source_column = y.source_column),
c as (select target_table, source_column, source_pos, target_column, priority, row_number() over (partition by target_table, source_column order by priority, target_column) as n from w join t on w.name = {_key('target_column')}),
m as (select target_table, source_column, target_column, priority from (select *, row_number() over (partition by target_table, target_column order by source_pos) as k from c where n = 1) where k = 1)"""


def _mapping_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    source = spark.createDataFrame(_SOURCE, "source_pos int, source_column string, kind string, required boolean")
    target = spark.createDataFrame(_TARGET, "target_table string, target_column string, data_type string, nullable boolean, has_default boolean")
    return source, target, spark.createDataFrame(_SYNONYMS, "source_column string, priority int, synonym string")


@query(_MAPWITH + " select target_table, source_column, target_column, cast(priority as int) as priority from m")
def mapping_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.propose(*_mapping_tables(spark))


@query(_MAPWITH + " select target_table, cast(count(*) + case when contains(lower(target_table), 'invoice') then 10 else 0 end as bigint) as score from m group by target_table order by score desc, target_table limit 1")
def mapping_pick_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.pick_table(mapping.propose(*_mapping_tables(spark)), ["invoice"])


@query(_MAPWITH + """, i as (select source_column, target_column from m where target_table = 'customer_invoices'), tt as (select * from t where target_table = 'customer_invoices')
select 'type_mismatch' as issue, 'error' as severity, source_column as name from i join s using (source_column) join tt using (target_column) where (kind = 'text' and not (data_type like 'varchar%' or data_type = 'text')) or (kind = 'date' and data_type not in ('date', 'timestamp', 'text'))
union all select 'unmapped_required_source', 'error', source_column from s where required and source_column not in (select source_column from i)
union all select 'unmapped_required_target', 'error', target_column from tt where not nullable and not has_default and target_column not in (select target_column from i)""")
def mapping_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, synonyms = _mapping_tables(spark)
    proposed = mapping.propose(source, target, synonyms).where("target_table = 'customer_invoices'")
    return mapping.validate(proposed, source, target.where("target_table = 'customer_invoices'"))


@query(r"""select row_id, case when schema_version is null or not regexp_matches(schema_version, '^\d{1,9}\.\d{1,9}(\.\d{1,9})?$') then 'invalid' when split_part(schema_version, '.', 1) <> '2' then 'other_major' when cast(split_part(schema_version, '.', 2) as int) > 0 then 'future_minor' else 'compatible' end as relation from invoices""")
def version_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "invoices").select("row_id", X.version_relation(F.col("schema_version"), "2.0").alias("relation"))


@query("select event_type, cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return read_table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("select manifest_id, sha256(concat(coalesce(sha256, ''), chr(0), coalesce(document_type, ''), chr(0), coalesce(expected_route, ''))) as idempotency_key from manifest")
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "manifest").select("manifest_id", X.digest(F.col("sha256"), F.col("document_type"), F.col("expected_route")).alias("idempotency_key"))


@query("""with reg(kind, format_id, route) as (values ('visual_pdf', 'pdf', 'visual_model'), ('image', 'raster', 'visual_model'), ('ubl_xml', 'ubl', 'structured_parser'), ('hybrid_pdf_xml', 'pdf_a3', 'hybrid_compare'))
select manifest_id, coalesce(format_id, 'none') as format_id, coalesce(route, 'quarantine') as route, coalesce(route, 'quarantine') = expected_route as as_expected from manifest left join reg using (kind)""")
def route_registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("visual_pdf", "pdf", "visual_model"), ("image", "raster", "visual_model"), ("ubl_xml", "ubl", "structured_parser"), ("hybrid_pdf_xml", "pdf_a3", "hybrid_compare")], "kind string, format_id string, route string")
    joined = read_table(spark, sf_dir, "manifest").join(F.broadcast(registry), "kind", "left")
    route = F.coalesce("route", F.lit("quarantine"))
    return joined.select("manifest_id", F.coalesce("format_id", F.lit("none")).alias("format_id"), route.alias("route"), (route == F.col("expected_route")).alias("as_expected"))


@query("""select row_id, case when item_name is null or item_name = '' or item_name = description then coalesce(description, '') when description is null or description = '' then item_name else description || chr(10) || item_name end as corpus_text from line_items""")
def corpus_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array_distinct(F.filter(F.array("description", "item_name"), lambda x: x.isNotNull() & (x != "")))
    return read_table(spark, sf_dir, "line_items").select("row_id", F.array_join(texts, "\n").alias("corpus_text"))


@query(f"select {_DKEY} as doc_key, count(*) as n from invoices where {_DKEY} is not null group by 1 having count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "invoices").groupBy(normal_key("document_id").alias("doc_key")).agg(F.count(F.lit(1)).alias("n")).where("doc_key is not null and n > 1")


_KEYS = [("pk_inv", "invoices", "id"), ("uq_inv", "invoices", "tenant"), ("uq_inv", "invoices", "number"), ("pk_line", "lines", "id")]


@query(f"with k(constraint_name, table_name, column_name) as (values {_values(_KEYS)}) select table_name, min(column_name) as column_name from k group by constraint_name, table_name having count(*) = 1")
def single_col_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame(_KEYS, "constraint_name string, table_name string, column_name string")
    return keys.groupBy("constraint_name", "table_name").agg(F.count(F.lit(1)).alias("n"), F.min("column_name").alias("column_name")).where("n = 1").select("table_name", "column_name")


@query("""select c_mktsegment as segment, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as varchar) as total from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1""")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    joined = read_table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("total"))


@query("""select 'both' as side, country from (select supplier_country as country from invoices intersect select buyer_country from invoices) union all
select 'supplier_only', country from (select supplier_country as country from invoices except select buyer_country from invoices) union all select 'any', country from (select supplier_country as country from invoices union select buyer_country from invoices)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = read_table(spark, sf_dir, "invoices")
    a, b = invoices.select(F.col("supplier_country").alias("country")), invoices.select(F.col("buyer_country").alias("country"))
    label = lambda df, s: df.select(F.lit(s).alias("side"), "country")
    return label(a.intersect(b), "both").unionByName(label(a.subtract(b), "supplier_only")).unionByName(label(a.union(b).distinct(), "any"))


@query(f"select source_family, region_pack, count(*) as n, {_txt(f"cast(sum({_zero('payable_amount')}) as decimal(38,8))")} as payable from invoices group by rollup(source_family, region_pack)")
def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "invoices").rollup("source_family", "region_pack").agg(F.count(F.lit(1)).alias("n"), D.text(F.sum(D.or_zero(F.col("payable_amount"))).cast("decimal(38,8)")).alias("payable"))


@query(f"select supplier_country, case when count(distinct currency) = 1 then min(currency) end as currency, {_txt(f"cast(sum({_zero('payable_amount')}) as decimal(38,8))")} as payable, cast(round(avg(length(supplier_name))) as bigint) as mean_length from invoices group by 1")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.count_distinct("currency") == 1, F.min("currency"))
    return read_table(spark, sf_dir, "invoices").groupBy("supplier_country").agg(one.alias("currency"), D.text(F.sum(D.or_zero(F.col("payable_amount"))).cast("decimal(38,8)")).alias("payable"), F.round(F.avg(F.length("supplier_name"))).cast("bigint").alias("mean_length"))


@query(f"select strftime({_DATE.format('issue_date')}, '%Y%m%d') as compact, strftime({_DATE.format('issue_date')}, '%Y-%m-%d') as iso, count(*) as n from invoices where ({_DATE.format('issue_date')}) is not null group by 1, 2")
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read_table(spark, sf_dir, "invoices").select(F.date_format(X.iso_date(F.col("issue_date")), "yyyyMMdd").alias("compact")).where("compact is not null")
    return days.groupBy("compact", X.compact_date(F.col("compact")).alias("iso")).agg(F.count(F.lit(1)).alias("n"))


@query("""select row_id, json_object('export_version', 'm1.0', 'document_id', document_id, 'review_status', review_status, 'payable_amount', payable_amount) as envelope from invoices""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct(F.lit("m1.0").alias("export_version"), "document_id", "review_status", "payable_amount")
    return read_table(spark, sf_dir, "invoices").select("row_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"))


@query("select c_mktsegment as segment, approx_level from (select c_mktsegment, count(distinct c_nationkey) as approx_level from customer group by 1)")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("c_nationkey").alias("approx_level"))


RECORD_SCHEMA = {
    "type": "object",
    "required": ["document_id", "document_type", "invoice", "totals", "line_items", "payment"],
    "properties": {"document_id": {"type": "string", "minLength": 8, "maxLength": 128}, "document_type": {"enum": ["invoice", "tax_invoice", "receipt", "credit_note", "debit_note"]}, "invoice": {"type": "object", "properties": {"issue_date": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}, "number": {"type": ["string", "null"]}}}, "line_items": {"type": "array", "maxItems": 2000}},
}


_R = lambda p: f"json_extract(record_json, '$.{p}')"
_S = lambda p: f"json_extract_string(record_json, '$.{p}')"
_violation = lambda pointer, keyword, where: f"select '{pointer}' as pointer, '{keyword}' as keyword from r where {where}"


@query("with r as (select record_json from canonical_records where json_valid(record_json)) select pointer, keyword, count(*) as n from (select '' as pointer, 'json' as keyword from canonical_records where not coalesce(json_valid(record_json), false) union all " + " union all ".join([
    *[_violation(f"/{k}", "required", f"{_R(k)} is null") for k in RECORD_SCHEMA["required"]],
    _violation("/document_id", "type", f"json_type({_R('document_id')}) <> 'VARCHAR'"),
    _violation("/document_id", "minLength", f"json_type({_R('document_id')}) = 'VARCHAR' and length({_S('document_id')}) < 8"),
    _violation("/document_id", "maxLength", f"json_type({_R('document_id')}) = 'VARCHAR' and length({_S('document_id')}) > 128"),
    _violation("/document_type", "enum", f"{_R('document_type')} is not null and coalesce({_S('document_type')}, '') not in ('invoice', 'tax_invoice', 'receipt', 'credit_note', 'debit_note')"),
    _violation("/invoice", "type", f"json_type({_R('invoice')}) <> 'OBJECT'"),
    _violation("/invoice/issue_date", "type", f"json_type({_R('invoice.issue_date')}) <> 'VARCHAR'"),
    _violation("/invoice/issue_date", "pattern", f"json_type({_R('invoice.issue_date')}) = 'VARCHAR' and not regexp_matches({_S('invoice.issue_date')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"),
    _violation("/invoice/number", "type", f"json_type({_R('invoice.number')}) not in ('VARCHAR', 'NULL')"),
    _violation("/line_items", "type", f"json_type({_R('line_items')}) <> 'ARRAY'"),
    _violation("/line_items", "maxItems", f"json_array_length({_R('line_items')}) > 2000"),
]) + ") group by 1, 2")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of schema violations by pointer and keyword."""
    check = trees.schema_check(RECORD_SCHEMA)
    each = read_table(spark, sf_dir, "canonical_records").select(F.explode(check("record_json")).alias("e"))
    return each.groupBy("e.pointer", "e.keyword").agg(F.count(F.lit(1)).alias("n"))


@query()
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records equal up to JSON form: (digest, n, first) of digests that occur more than once."""
    digests = read_table(spark, sf_dir, "canonical_records").select("ground_truth", trees.sorted_digest("record_json").alias("digest"))
    return digests.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("ground_truth").alias("first")).where("n > 1")


@query("""select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1, 2""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of the event stream, run to its end."""
    return stream.windowed(spark, f"{sf_dir}/events.parquet").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "cents")


@query("select user_id, event_type, count(distinct event_id) as n from events group by 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted once by id, however often the stream delivers them."""
    return stream.deduplicated(spark, f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


_CII = """'<rsm:CrossIndustryInvoice xmlns:rsm="u"><rsm:ExchangedDocument><ram:ID>' || invoice_number || '</ram:ID><ram:IssueDateTime><udt:DateTimeString format="102">' || replace(issue_date, '-', '') || '</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument><ram:SellerTradeParty><ram:Name>' || supplier_name || '</ram:Name></ram:SellerTradeParty><ram:InvoiceCurrencyCode>' || currency || '</ram:InvoiceCurrencyCode><ram:GrandTotalAmount>' || payable_amount || '</ram:GrandTotalAmount></rsm:CrossIndustryInvoice>'"""
_UBL = _XML.replace("</cbc:IssueDate>'", "</cbc:IssueDate><cbc:DocumentCurrencyCode>' || coalesce(currency, '') || '</cbc:DocumentCurrencyCode>'")


@query(f"""with x as (select row_id, invoice_number, issue_date, supplier_name, currency, payable_amount, coalesce({_CII}, {_UBL}) as xml, ({_CII}) is not null as cii from invoices)
select row_id, case when cii then 'cii' else 'ubl' end as vocabulary, 'structured_' || substr(sha256(xml), 1, 16) as document_id, nullif(trim(invoice_number), '') as number, nullif(trim(issue_date), '') as issue_date, nullif(trim(supplier_name), '') as supplier_name,
nullif(trim(currency), '') as currency, nullif(trim(payable_amount), '') as payable_amount from x""")
def structured_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two XML vocabularies mapped to one set of columns; rows that lack a part are written in the other vocabulary."""
    xml = read_table(spark, sf_dir, "invoices").select("row_id", F.expr(f"coalesce({_CII}, {_UBL})").alias("xml"))
    return structured.mapped(xml).select("row_id", "vocabulary", "document_id", "number", "issue_date", "supplier_name", "currency", "payable_amount")


_CHANGES = ("supplier_name", "buyer_name", "invoice_number", "issue_date", "currency", "payable_amount", "review_status")


@query(f"""with r as (select *, {_DKEY} as k from invoices), l as (select row_id, received_at, k, {", ".join(f"{c}, lag({c}) over w as p_{c}" for c in _CHANGES)}, lag(row_id) over w as previous from r where k is not null window w as (partition by k order by received_at, row_id))
select row_id, previous, concat_ws(',', {", ".join(f"case when {c} is distinct from p_{c} then '{c}' end" for c in _CHANGES)}) as changed from l where previous is not null""")
def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in which a delivery differs from the one before it."""
    from pyspark.sql import Window

    rows = read_table(spark, sf_dir, "invoices").select(normal_key("document_id").alias("k"), "received_at", "row_id", *_CHANGES).where("k is not null")
    before = F.lag(F.struct("row_id", *_CHANGES)).over(Window.partitionBy("k").orderBy("received_at", "row_id"))
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"_p.{c}")), F.lit(c)) for c in _CHANGES]
    return rows.withColumn("_p", before).where("_p is not null").select("row_id", F.col("_p.row_id").alias("previous"), F.concat_ws(",", *changed).alias("changed"))


@query("""select m.ground_truth is null as unnamed, m.ground_truth is not null and c.ground_truth is null as missing, count(*) as n_rows, count(distinct m.ground_truth) as n_paths from manifest m left join canonical_records c using (ground_truth) group by 1, 2""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "canonical_records").select("ground_truth", F.lit(True).alias("there"))
    joined = read_table(spark, sf_dir, "manifest").select("ground_truth").join(records, "ground_truth", "left")
    unnamed, missing = F.col("ground_truth").isNull(), F.col("ground_truth").isNotNull() & F.col("there").isNull()
    return joined.groupBy(unnamed.alias("unnamed"), missing.alias("missing")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ground_truth").alias("n_paths"))


@query(f"""with l as (select {_DKEY} as k, count(*) as n, count(distinct unit_code) as u from line_items where {_DKEY} is not null group by 1)
select row_id, coalesce(n, 0) as n_lines, coalesce(u, 0) as n_units from invoices left join l on {_DKEY} = k""")
def delivered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice with the number of its lines, none counting as zero."""
    lines = read_table(spark, sf_dir, "line_items").groupBy(normal_key("document_id").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_code").alias("u")).where("k is not null")
    invoices = read_table(spark, sf_dir, "invoices").select("row_id", normal_key("document_id").alias("k"))
    return invoices.join(lines, "k", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("u", F.lit(0)).alias("n_units"))


@query(r"""select doc_id, nullif(regexp_extract(text, '(?s)[\{\[].*[\}\]]', 0), '') as json_span, cast(len(list_filter(list_transform(string_split(split_part(text, chr(10), 1), 'x'), lambda s: trim(s, ' ')), lambda s: s <> '')) as int) as n_cells from documents where text is not null""")
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost bracketed span of a text, and the non-empty cells of its first line split at x."""
    first = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), "x")
    cells = F.filter(F.transform(first, lambda s: F.trim(s)), lambda s: s != "")
    span = F.nullif(F.regexp_extract("text", r"(?s)[\{\[].*[\}\]]", 0), F.lit(""))
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", span.alias("json_span"), F.size(cells).alias("n_cells"))


@query("""select source_family, array_to_string(list_sort(list_distinct(list(upper(trim(currency))))), ',') as codes, count(*) as n from invoices where currency is not null group by source_family""")
def normal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct upper-case codes per source; the set is bounded by the number of currencies."""
    rows = read_table(spark, sf_dir, "invoices").where("currency is not null")
    return rows.groupBy("source_family").agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("currency")))), ",").alias("codes"), F.count(F.lit(1)).alias("n"))


@query("""select user_id, concat_ws(',', case when count(*) filter (event_type = 'click') > 40 then 'click' end, case when count(*) filter (event_type = 'error') > 40 then 'error' end) as busy from events group by user_id""")
def map_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a map whose values pass a test."""
    counts = F.create_map(*[x for t in ("click", "error") for x in (F.lit(t), F.col(t))])
    wide = read_table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "error")])
    return wide.select("user_id", F.array_join(F.map_keys(F.map_filter(counts, lambda k, v: v > 40)), ",").alias("busy"))
