"""Queries of delivery, configuration and evaluation operators over whole tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import texts as X
from ledgerloom.operators import delivery
from ledgerloom.operators.orphans import normal_key
from ledgerloom.plans.invoice_queries import _DATE, _DKEY, _dec, _txt, _values
from ledgerloom.session import read_table, scratch_path
from ledgerloom.sources import delimited, exports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("select r_regionkey::varchar as r_regionkey, r_name, n_nationkey::varchar as n_nationkey, n_name from region join nation on n_regionkey = r_regionkey")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written as a CSV bundle and read again, all columns as text."""
    path = scratch_path(spark, "csv")
    tables = {n: read_table(spark, sf_dir, n) for n in ("region", "nation")}
    exports.write_csv_bundle(tables, path)
    region, nation = (delimited.read_csv(spark, f"{path}/{n}") for n in tables)
    return region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_nationkey", "n_name")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "invoices", "parties", "line_items", "tax_breakdowns", "manifest", "canonical_records")


@query(f"select table_name, cast(count(*) as int) as n_columns, string_agg(column_name, ',' order by ordinal_position) as columns from information_schema.columns where table_name in ({', '.join(repr(t) for t in _TABLES)}) group by 1")
def schema_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = delivery.schema_snapshot(spark, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES})
    return snapshot.select("table_name", F.size("columns").alias("n_columns"), F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"))


@query(f"""select {_DKEY} as doc_key, line_no, source_family, count(*) as n from line_items l join (select distinct {_DKEY} as k, source_family, cast(received_at as date) as day from invoices) i on i.k = {_DKEY} and i.day = cast(l.received_at as date) group by all""")
def keys_on_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to deliveries on key and day, and counted by the three keys that the catalogue join uses."""
    lines = read_table(spark, sf_dir, "line_items").select(normal_key("document_id").alias("doc_key"), "line_no", F.to_date("received_at").alias("day"))
    invoices = read_table(spark, sf_dir, "invoices").select(normal_key("document_id").alias("doc_key"), "source_family", F.to_date("received_at").alias("day")).distinct()
    return lines.join(invoices, ["doc_key", "day"]).groupBy("doc_key", "line_no", "source_family").agg(F.count(F.lit(1)).alias("n"))


_CONSTRAINTS = [("pk_invoices", "public", "invoices"), ("uq_invoices", "public", "invoices"), ("pk_lines", "public", "line_items"), ("pk_lines", "archive", "line_items")]
_USAGE = [("pk_invoices", "public", "invoices", "row_id"), ("uq_invoices", "public", "invoices", "document_id"), ("uq_invoices", "public", "invoices", "received_at"), ("pk_lines", "public", "line_items", "row_id"), ("pk_lines", "archive", "line_items", "line_id")]


@query(f"with c(constraint_name, table_schema, table_name) as (values {_values(_CONSTRAINTS)}), u(constraint_name, table_schema, table_name, column_name) as (values {_values(_USAGE)}) select * from c join u using (constraint_name, table_schema, table_name)")
def catalogue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of constraints and their columns on three keys; a catalogue has a few rows per table."""
    return delivery.key_columns(spark.createDataFrame(_CONSTRAINTS, "constraint_name string, table_schema string, table_name string"), spark.createDataFrame(_USAGE, "constraint_name string, table_schema string, table_name string, column_name string"))


# source column, target column, kind, bucket of the target, nullable
_MAPPING = [("document_id", "doc_no", "text", "text", False), ("issue_date", "doc_date", "date", "date", True), ("payable_amount", "total", "decimal", "numeric", False), ("currency", "ccy", "text", "text", False)]
_LINE_MAPPING = [("document_id", "doc_no", "text", "text", False), ("quantity", "qty", "decimal", "numeric", True), ("line_net_amount", "net", "decimal", "numeric", False)]


def _value(c: str, kind: str) -> tuple[str, str]:
    ok = {"text": "true", "date": f"({_DATE.format(c)}) is not null", "decimal": f"({_dec(c)}) is not null"}[kind]
    value = {"text": c, "date": f"cast({_DATE.format(c)} as varchar)", "decimal": _txt(_dec(c))}[kind]
    return f"case when {c} <> '' and {ok} then {value} end", ok


def _mapped(mapping, table: str) -> str:
    values = ", ".join(f"{_value(s, k)[0]} as {t}" for s, t, k, _, _ in mapping)
    issues = ", ".join(f"case when {s} is null or {s} = '' then {'null' if n else repr(t + ':required_value_missing')} when not coalesce({_value(s, k)[1]}, false) then '{t}:not_{k}' end" for s, t, k, _, n in mapping)
    return f"select row_id, {_DKEY} as doc_key, {values}, list_filter([{issues}], lambda x: x is not null) as issues from {table}"


@query(f"select row_id, {', '.join(t for _, t, *_ in _MAPPING)}, array_to_string(issues, ',') as issues from ({_mapped(_MAPPING, 'invoices')})")
def row_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices renamed and coerced onto an external table by its mapping."""
    return delivery.transformed(read_table(spark, sf_dir, "invoices"), "row_id", _MAPPING).withColumn("issues", F.array_join("issues", ","))


_PUSH = f"""with h as ({_mapped(_MAPPING, 'invoices')}), l as ({_mapped(_LINE_MAPPING, 'line_items')}), b as (select doc_key, count(*) as n from l where len(issues) > 0 group by 1),
o as (select h.row_id, h.doc_key, case when len(issues) = 0 and b.n is null then 'pushed' else 'failed' end as status, array_to_string(list_concat(issues, case when b.n is null then [] else ['lines:' || b.n] end), ',') as issues from h left join b using (doc_key))"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda t: read_table(spark, sf_dir, t).withColumn("doc_key", normal_key("document_id"))
    with_key = lambda t, m: delivery.transformed(key(t), "row_id", m).join(key(t).select("row_id", "doc_key"), "row_id")
    header, lines = with_key("invoices", _MAPPING), with_key("line_items", _LINE_MAPPING)
    return delivery.push_outcomes(header, lines, "doc_key")


@query(_PUSH + " select row_id, status, issues from o")
def push_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered header with its outcome: a document with an issue in header or lines fails whole, others are not touched."""
    return _outcomes(spark, sf_dir).select("row_id", "status", F.array_join("issues", ",").alias("issues"))


@query(_PUSH + """ select source_family, count(*) filter (status = 'pushed') as n_pushed, count(*) filter (status = 'failed') as n_failed,
case when count(*) filter (status = 'failed') = 0 then 'pushed' when count(*) filter (status = 'pushed') = 0 then 'failed' else 'partial' end as status from o join invoices using (row_id) group by 1""")
def push_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).join(read_table(spark, sf_dir, "invoices").select("row_id", "source_family"), "row_id")
    return delivery.push_status(rows, "source_family")


@query(_PUSH + " select row_id, payable_amount from invoices where row_id in (select row_id from o where status = 'failed')")
def push_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a retry takes: those that failed, by a semi join with the ids."""
    return delivery.to_retry(read_table(spark, sf_dir, "invoices").select("row_id", "payable_amount"), _outcomes(spark, sf_dir), "row_id")


@query("select row_id, currency in ('EUR', 'USD') as listed, true as unlisted from invoices where currency is not null")
def allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a list, and in an empty one, which permits all."""
    some, none = F.array(F.lit("EUR"), F.lit("USD")), F.array().cast("array<string>")
    return read_table(spark, sf_dir, "invoices").where("currency is not null").select("row_id", delivery.allowed(F.col("currency"), some).alias("listed"), delivery.allowed(F.col("currency"), none).alias("unlisted"))


@query(f"""with l as (select {_DKEY} as k, count(*) as n, string_agg(line_id, ',' order by line_no, row_id) filter (line_no <= 3) as first_lines from line_items where {_DKEY} is not null group by 1)
select row_id, coalesce(n, 0) as n_lines, coalesce(first_lines, '') as first_lines from invoices left join l on k = {_DKEY}""")
def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with their first lines as a nested list: lines are gathered per document, which bounds them."""
    lines = read_table(spark, sf_dir, "line_items").select(normal_key("document_id").alias("k"), "line_no", "row_id", "line_id").where("k is not null")
    first = F.array_sort(F.collect_list(F.when((F.col("line_no") <= 3) & F.col("line_id").isNotNull(), F.struct("line_no", "row_id", "line_id"))))
    listed = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n"), first.alias("ls"))
    invoices = read_table(spark, sf_dir, "invoices").select("row_id", normal_key("document_id").alias("k"))
    joined = invoices.join(listed, "k", "left")
    return joined.select("row_id", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce(F.array_join(F.transform("ls", lambda x: x.line_id), ","), F.lit("")).alias("first_lines"))


@query("select event_type, printf('%.6f', case when count(*) filter (value < 0) = 0 then 0 else count(*) filter (value > 100) / count(*) filter (value < 0) end) as ratio, coalesce(max(value) filter (value < 0), 0) as most_negative from events group by 1")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with zero where there is nothing to divide by, maxima with a default."""
    below = F.count_if(F.col("value") < 0)
    rate = F.when(below == 0, F.lit(0.0)).otherwise(F.count_if(F.col("value") > 100) / below)
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.format_string("%.6f", rate).alias("ratio"), F.coalesce(F.max(F.when(F.col("value") < 0, F.col("value"))), F.lit(0.0)).alias("most_negative"))


_CHECKS = {"no_document_id": "document_id is null or trim(document_id) = ''", "no_number": "invoice_number is null", "deleted_before_received": "deleted_at < received_at", "due_before_issue": "due_date < issue_date"}


@query(" union all ".join(f"select '{n}' as violation, count(*) as n_rows, min(row_id) as first_row from invoices where {c}" for n, c in _CHECKS.items()))
def restore_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of several rules counted in one pass over the rows."""
    invoices = read_table(spark, sf_dir, "invoices")
    wide = invoices.agg(*[x for n, c in _CHECKS.items() for x in (F.count_if(F.expr(c)).alias(n), F.min(F.when(F.expr(c), F.col("row_id"))).alias(f"{n}_at"))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(n).alias("n_rows"), F.col(f"{n}_at").alias("first_row")) for n in _CHECKS]))
    return wide.select(each.alias("v")).select("v.*")


@query("select row_id, cast(row_number() over (order by received_at desc nulls last, row_id) as int) as place from invoices order by place limit 50")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that a screen shows first: the newest 50."""
    top = read_table(spark, sf_dir, "invoices").orderBy(F.desc_nulls_last("received_at"), "row_id").limit(50).select("row_id", "received_at")
    return top.select("row_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("received_at"), "row_id")).alias("place"))


@query("select row_id, substr(sha256(coalesce(description, '')), 1, 12) as short_hash, array_to_string(list_slice(string_split(coalesce(description, ''), ' '), 1, 3), ' ') as first_words from line_items")
def element_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("description", F.lit(""))
    return read_table(spark, sf_dir, "line_items").select("row_id", F.substring(F.sha2(text, 256), 1, 12).alias("short_hash"), F.array_join(F.slice(F.split(text, " "), 1, 3), " ").alias("first_words"))


@query("select currency, count(*) as n from invoices where payable_amount > '5' and source_family = 'ubl' group by 1")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with named parameters, which are values and never text of the statement."""
    return spark.sql("select currency, count(*) as n from {t} where payable_amount > :least and source_family = :family group by 1", args={"least": "5", "family": "ubl"}, t=read_table(spark, sf_dir, "invoices"))


@query("select doc_id, base64(encode(text)) as encoded from documents where text is not null")
def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the encoder breaks no lines here: RFC 4648 text in one piece
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("encoded"))


@query("select manifest_id, nullif(regexp_extract(x, '(?s)[\\{\\[].*[\\}\\]]', 0), '') as body from (select manifest_id, '{\"id\": \"' || coalesce(fixture_id, '') || '\", \"notes\": [\"' || coalesce(notes, '') || '\"]}' as x from manifest)")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON taken out of a code fence with words around it."""
    body = F.concat(F.lit('{"id": "'), F.coalesce("fixture_id", F.lit("")), F.lit('", "notes": ["'), F.coalesce("notes", F.lit("")), F.lit('"]}'))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))
    return read_table(spark, sf_dir, "manifest").select("manifest_id", X.unfenced(fenced).alias("body"))


@query("select row_id, coalesce(description, '') || ' ' || coalesce(quantity, '') as page_text from line_items")
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings that a page shows, brackets and backslashes unescaped, from the bytes of a page."""
    shown = lambda c: F.concat(F.lit("("), F.regexp_replace(F.coalesce(c, F.lit("")), r"([()\\])", r"\\$1"), F.lit(") Tj\n"))
    page = F.encode(F.concat(F.lit("BT\n"), shown(F.col("description")), F.lit("0 -12 Td "), shown(F.col("quantity")), F.lit("ET")), "UTF-8")
    text = X.pdf_strings(page)
    # what was written as UTF-8 is read byte by byte
    return read_table(spark, sf_dir, "line_items").select("row_id", F.decode(F.encode(text, "ISO-8859-1"), "UTF-8").alias("page_text"))


@query("select manifest_id, case expected_status when 'quarantined' then 'quarantined' when 'needs_review' then 'needs_review' else 'failed' end as status from manifest")
def failure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes mapped to a status by a small map, all others failed."""
    known = F.create_map(*[F.lit(x) for x in ("quarantined", "quarantined", "needs_review", "needs_review")])
    return read_table(spark, sf_dir, "manifest").select("manifest_id", F.coalesce(F.try_element_at(known, "expected_status"), F.lit("failed")).alias("status"))


@query("select manifest_id, case when kind = 'ubl_xml' then 'parser' when expected_route = 'visual_model' and currency = 'INR' then 'second' else 'first' end as provider from manifest")
def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.when(F.col("kind") == "ubl_xml", "parser").when((F.col("expected_route") == "visual_model") & (F.col("currency") == "INR"), "second").otherwise("first")
    return read_table(spark, sf_dir, "manifest").select("manifest_id", choice.alias("provider"))


@query("""select manifest_id, concat_ws(',', case when currency is null then 'currency' end, case when country is null then 'country' end, case when notes is null then 'notes' end, case when sha256 is null then 'sha256' end) as lacking from manifest""")
def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of flags that are not set: merged maps, filtered by value."""
    flags = F.map_concat(*[F.create_map(F.lit(c), F.col(c).isNull()) for c in ("currency", "country", "notes", "sha256")])
    return read_table(spark, sf_dir, "manifest").select("manifest_id", F.array_join(F.map_keys(F.map_filter(flags, lambda _, v: v)), ",").alias("lacking"))


@query(f"select row_id, strftime(received_at at time zone 'UTC', 'Batch %Y-%m-%d %H:%M') as batch_name, coalesce((epoch_us(lead(received_at) over w) - epoch_us(received_at)) // 1000, -1) as elapsed_ms from invoices where {_DKEY} is not null window w as (partition by {_DKEY} order by received_at, row_id)")
def batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from times, and milliseconds to the next delivery of the same document, -1 for the last."""
    rows = read_table(spark, sf_dir, "invoices").select("row_id", "received_at", normal_key("document_id").alias("k")).where("k is not null")
    after = F.lead("received_at").over(Window.partitionBy("k").orderBy("received_at", "row_id"))
    return rows.select("row_id", F.date_format("received_at", "'Batch' yyyy-MM-dd HH:mm").alias("batch_name"), F.coalesce(F.floor((F.unix_micros(after) - F.unix_micros("received_at")) / 1000), F.lit(-1)).alias("elapsed_ms"))


_TEN = "document_id schema_version document_type source_family source_profile language_tag supplier_country buyer_country currency region_pack".split()


@query(f"select row_id, sha256({' || chr(0) || '.join(f'''coalesce({c}, '')''' for c in _TEN)}) as profile_version from invoices")
def profile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "invoices").select("row_id", X.digest(*[F.col(c) for c in _TEN]).alias("profile_version"))


@query("""with a as (select manifest_id, 'received' as action, received_at as seen from manifest union all select manifest_id, 'routed', received_at + interval 1 minute from manifest where expected_route is not null)
select manifest_id, action, strftime(seen at time zone 'UTC', '%Y-%m-%d %H:%M') as seen_at, sha256(manifest_id || chr(0) || action) as event_key from a""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of events with keys that make an append idempotent."""
    rows = read_table(spark, sf_dir, "manifest")
    one = rows.select("manifest_id", F.lit("received").alias("action"), F.col("received_at").alias("seen"))
    two = rows.where("expected_route is not null").select("manifest_id", F.lit("routed").alias("action"), (F.col("received_at") + F.expr("interval 1 minute")).alias("seen"))
    return one.unionByName(two).select("manifest_id", "action", F.date_format("seen", "yyyy-MM-dd HH:mm").alias("seen_at"), X.digest(F.col("manifest_id"), F.col("action")).alias("event_key"))


@query("select manifest_id, '/' || replace(replace(coalesce(file, ''), '~', '~0'), '/', '~1') || '/' || replace(replace(coalesce(notes, ''), '~', '~0'), '/', '~1') as pointer from manifest")
def pointer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "manifest").select("manifest_id", X.keyed_path(F.coalesce("file", F.lit("")), F.coalesce("notes", F.lit(""))).alias("pointer"))
