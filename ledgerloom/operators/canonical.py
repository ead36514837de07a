"""Canonical invoices: the typed document, its five export tables, and the whole rule engine over one document per row.

The document is parsed once with a fixed schema; tables are projections and explodes of it, findings one array per document
(no shuffle). Numbers come out as the text that the document has.

Results by case:
- a document that cannot be read has no rows in any table and one SCHEMA_INVALID finding; a missing part gives nulls;
- with schema errors, only these are reported: the other rules of such a document say nothing;
- null roles and lists give no rows; ordinals count from one in the order of the document; repeated documents repeat;
- amounts are exact up to 20 digits before and 8 behind the point (28 digits); longer ones count as no decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X
from ledgerloom.operators.validate import MONEY

_strings = lambda names: ", ".join(f"{n}: string" for n in names.split())
_IDENTIFIER = f"struct<{_strings('scheme value issuing_country purpose')}>"
_PARTY = f"struct<{_strings('display_name legal_name trading_name')}, identifiers: array<{_IDENTIFIER}>, address: struct<lines: array<string>, {_strings('city subdivision postal_code country_code')}>>"
TAX_COLUMNS = "tax_type component jurisdiction_code category_code rate taxable_amount tax_amount payable_effect exemption_code exemption_reason reverse_charge source_label".split()
LINE_COLUMNS = "line_id line_no description item_name seller_item_id buyer_item_id quantity unit_code unit_price price_base_quantity line_net_amount line_gross_amount".split()
_TAX = f"struct<{_strings(' '.join(TAX_COLUMNS))}>"
_CHARGE = f"struct<{_strings('charge_indicator amount')}>"
_LINE = f"struct<{_strings(' '.join(LINE_COLUMNS))}, allowances_charges: array<{_CHARGE}>, tax_breakdowns: array<{_TAX}>>"
DOCUMENT = f"""struct<{_strings('schema_version document_id document_type')}, source: struct<{_strings('family route profile')}>,
 locale: struct<{_strings('document_language supplier_country buyer_country')}, applied_region_pack: struct<id: string>>,
 supplier: {_PARTY}, buyer: {_PARTY}, payee: {_PARTY}, invoice: struct<{_strings('number issue_date due_date currency')}>,
 totals: struct<{_strings(' '.join(MONEY))}>, tax_breakdowns: array<{_TAX}>, line_items: array<{_LINE}>, evidence: array<struct<field_path: string>>>"""
ROLES = ("supplier", "buyer", "payee")

# Keys that a document must have and may have, its types, routes, and paths that need evidence.
REQUIRED = "schema_version document_id document_type source locale supplier invoice totals tax_breakdowns line_items evidence uncertainties".split()
OPTIONAL = "buyer payee references allowances_charges payment".split()
TYPES = "invoice tax_invoice commercial_invoice receipt credit_note debit_note proforma_invoice self_billed_invoice unknown".split()
ROUTES = "visual_model structured_parser hybrid_compare".split()
EVIDENCE = "/supplier/display_name /invoice/number /invoice/issue_date /invoice/currency /totals/payable_amount".split()
LINE_MONEY = "quantity unit_price price_base_quantity line_net_amount line_gross_amount".split()


def documents(records: DataFrame, key: str = "ground_truth", payload: str = "record_json") -> DataFrame:
    """(key, body, d): the text and the typed document; `d` is null where the text is no JSON object."""
    body = F.col(payload)
    readable = F.json_object_keys(body).isNotNull()
    return records.select(F.col(key), body.alias("body"), F.when(readable, F.from_json(body, DOCUMENT)).alias("d"))


def invoice_table(docs: DataFrame, key: str, statuses: DataFrame) -> DataFrame:
    """One row of 26 columns per document; `statuses` has key and review_status, and a document without one gets null."""
    d = F.col("d")
    columns = {
        "document_id": d.document_id, "schema_version": d.schema_version, "document_type": d.document_type, "source_family": d.source.family, "source_profile": d.source.profile,
        "language_tag": d.locale.document_language, "supplier_country": d.locale.supplier_country, "buyer_country": d.locale.buyer_country, "supplier_name": d.supplier.display_name,
        "buyer_name": d.buyer.display_name, "invoice_number": d.invoice.number, "issue_date": d.invoice.issue_date, "due_date": d.invoice.due_date, "currency": d.invoice.currency,
        **{m: d.totals[m] for m in MONEY}, "region_pack": d.locale.applied_region_pack.id,
    }
    rows = docs.where("d is not null").select(key, *[c.alias(n) for n, c in columns.items()])
    return rows.join(statuses.select(key, "review_status"), key, "left").select(*rows.columns, "review_status")


def _roles(docs: DataFrame, key: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(f"party_{r}_1").alias("party_id"), F.col(f"d.{r}").alias("p")) for r in ROLES])
    return docs.where("d is not null").select(key, "d.document_id", F.explode(each).alias("r")).where("r.p is not null").select(key, "r.party_id", "document_id", "r.role", "r.p")


def party_table(docs: DataFrame, key: str) -> DataFrame:
    a = F.col("p.address")
    return _roles(docs, key).select(
        key, "party_id", "document_id", "role", "p.display_name", "p.legal_name", "p.trading_name", F.try_element_at(a.lines, F.lit(1)).alias("address_line_1"), a.city.alias("city"), a.subdivision.alias("subdivision"), a.postal_code.alias("postal_code"), a.country_code.alias("country_code")
    )


def identifier_table(docs: DataFrame, key: str) -> DataFrame:
    return _roles(docs, key).select(key, "party_id", "document_id", "role", F.posexplode("p.identifiers").alias("i", "x")).select(key, "party_id", "document_id", "role", (F.col("i") + 1).alias("ordinal"), "x.*")


def line_table(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, "d.document_id", F.posexplode("d.line_items").alias("i", "x")).select(key, "document_id", (F.col("i") + 1).alias("ordinal"), *[F.col(f"x.{c}").alias(c) for c in LINE_COLUMNS])


def tax_table(docs: DataFrame, key: str) -> DataFrame:
    """Taxes of the document and of its lines in one table, with ids that say where they stand."""
    columns = [F.col(f"x.{c}").alias(c) for c in TAX_COLUMNS]
    whole = docs.select(key, "d.document_id", F.posexplode("d.tax_breakdowns").alias("i", "x"))
    whole = whole.select(key, F.concat(F.lit("tax_doc_"), F.col("i") + 1).alias("tax_id"), "document_id", F.lit(None).cast("string").alias("line_id"), *columns)
    lines = docs.select(key, "d.document_id", F.explode("d.line_items").alias("l")).select(key, "document_id", "l.line_id", "l.line_no", F.posexplode("l.tax_breakdowns").alias("i", "x"))
    return whole.unionByName(lines.select(key, F.concat(F.lit("tax_line_"), F.coalesce("line_no", F.lit("")), F.lit("_"), F.col("i") + 1).alias("tax_id"), "document_id", "line_id", *columns))


FINDING = "array<struct<code:string,severity:string,behavior:string,field_paths:string,observed:string,calculated:string>>"


def _finding(code: str, severity: str, behavior: str | None, when: Column, paths: Column | str, observed: Column | None = None, calculated: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    paths = F.lit(paths) if isinstance(paths, str) else paths
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(behavior).cast("string").alias("behavior"), paths.alias("field_paths"), (none if observed is None else observed).alias("observed"), (none if calculated is None else calculated).alias("calculated")))


def schema_errors(docs: DataFrame) -> DataFrame:
    """Adds `errors`: pointers of keys that lack, keys that no document has, and values outside their list."""
    keys = F.json_object_keys("body")
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    pointers = lambda names: F.transform(names, lambda k: F.concat(F.lit("/"), k))
    present = lambda name, test: F.when(F.array_contains(keys, name) & ~F.coalesce(test, F.lit(False)), F.array(F.lit(f"/{name}"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        pointers(F.array_except(lit(REQUIRED), keys)), pointers(F.array_except(keys, lit([*REQUIRED, *OPTIONAL]))),
        present("document_type", F.col("d.document_type").isin(*TYPES)), present("schema_version", F.col("d.schema_version") == "2.0"), present("document_id", F.length("d.document_id").between(8, 128)),
    )
    return docs.withColumn("errors", F.when(F.col("d").isNull(), F.array(F.lit(""))).otherwise(F.array_sort(found)))


def findings(docs: DataFrame, key: str, today: str, duplicates: DataFrame | None = None, check_schema: bool = True) -> DataFrame:
    """(key, code, severity, behavior, field_paths, observed, calculated) of every finding.

    `duplicates` has key and n_matches of documents with probable duplicates. Without `check_schema` the typed rules run on
    every readable document.
    """
    d = F.col("d")
    docs = schema_errors(docs)
    if duplicates is not None:
        docs = docs.join(duplicates.select(key, "n_matches"), key, "left")
    m = lambda c: F.col(f"_{c}")
    zero = lambda c: F.coalesce(c, F.lit(0).cast(D.TYPE))
    # amounts are parsed in a projection of their own, so that the rules stay small enough to compile
    docs = docs.withColumns({f"_{c}": D.parse(d.totals[c]) for c in MONEY} | {"_tolerance": D.tolerance(d.invoice.currency), "_units": D.minor_units(d.invoice.currency), "_date": X.iso_date(d.invoice.issue_date)})
    sums = {
        "tax_exclusive_amount": ("HEADER_TOTAL_MISMATCH", zero(m("line_extension_amount")) - zero(m("allowance_total_amount")) + zero(m("charge_total_amount"))),
        "tax_inclusive_amount": ("TAX_INCLUSIVE_TOTAL_MISMATCH", zero(m("tax_exclusive_amount")) + zero(m("total_tax_amount"))),
        "payable_amount": ("PAYABLE_TOTAL_MISMATCH", zero(m("tax_inclusive_amount")) - zero(m("prepaid_amount")) - zero(m("withholding_total_amount")) + zero(m("rounding_amount"))),
    }
    taxes = F.aggregate(F.transform(d.tax_breakdowns, lambda t: D.or_zero(t.tax_amount)), F.lit(0).cast("decimal(38,8)"), lambda s, x: (s + x).cast("decimal(38,8)"))
    docs = docs.withColumns({f"_sum_{c}": total for c, (_, total) in sums.items()} | {"_sum_taxes": taxes})
    apart = lambda observed, total: F.abs(observed - total) > F.col("_tolerance")
    route, date, units = d.source.route, F.col("_date"), F.col("_units")
    missing = F.array_except(F.array(*[F.lit(p) for p in EVIDENCE]), F.coalesce(F.transform(d.evidence, lambda e: e.field_path), F.array().cast("array<string>")))
    single = [
        _finding("DOCUMENT_TYPE_AMBIGUOUS", "CRITICAL", "block_export", d.document_type == "unknown", "/document_type"),
        _finding("CURRENCY_MISSING_OR_AMBIGUOUS", "CRITICAL", "block_export", X.blank(d.invoice.currency), "/invoice/currency"),
        _finding("PAYABLE_AMOUNT_MISSING", "CRITICAL", "block_export", X.blank(d.totals.payable_amount), "/totals/payable_amount"),
        _finding("UNSUPPORTED_STRUCTURED_PROFILE", "HIGH", "quarantine", route == "quarantine", "/source/route", route),
        _finding("UNKNOWN_SOURCE_ROUTE", "HIGH", None, ~F.coalesce(route.isin("quarantine", *ROUTES), F.lit(False)), "/source/route", route),
        _finding("HIGH_RISK_EVIDENCE_MISSING", "HIGH", "block_export", F.size(missing) > 0, F.array_join(missing, ",")),
        _finding("AMBIGUOUS_DOCUMENT_DATE", "HIGH", None, ~X.blank(d.invoice.issue_date) & date.isNull(), "/invoice/issue_date"),
        _finding("FUTURE_ISSUE_DATE", "HIGH", None, date > F.lit(today).cast("date"), "/invoice/issue_date"),
        *[_finding(code, "CRITICAL", None, apart(m(c), F.col(f"_sum_{c}")), f"/totals/{c}", D.text(m(c)), D.text(F.col(f"_sum_{c}"))) for c, (code, _) in sums.items()],
        _finding("TAX_BREAKDOWN_CONFLICT", "HIGH", "require_confirmation", (F.size(d.tax_breakdowns) > 0) & apart(m("total_tax_amount"), F.col("_sum_taxes")), "/tax_breakdowns,/totals/total_tax_amount", D.text(m("total_tax_amount")), D.text(F.col("_sum_taxes"))),
        *[_finding("CURRENCY_PRECISION_MISMATCH", "HIGH", None, units.isNotNull() & ~X.blank(d.totals[c]) & (D.scale(d.totals[c]).isNull() | (D.scale(d.totals[c]) > units)), f"/totals/{c}", d.totals[c]) for c in MONEY],
    ]
    if duplicates is not None:
        single.append(_finding("PROBABLE_DUPLICATE", "CRITICAL", None, F.col("n_matches") > 0, "/document_id", F.col("n_matches").cast("string")))
    lines = F.coalesce(d.line_items, F.array().cast(f"array<{_LINE}>"))
    precise = F.flatten(F.transform(lines, lambda x, i: F.array(*[
        _finding("CURRENCY_PRECISION_MISMATCH", "HIGH", None, units.isNotNull() & ~X.blank(x[c]) & (D.scale(x[c]).isNull() | (D.scale(x[c]) > units)), F.concat(F.lit("/line_items/"), i, F.lit(f"/{c}")), x[c]) for c in LINE_MONEY
    ])))
    schema = F.transform("errors", lambda p: _finding("SCHEMA_INVALID", "CRITICAL", "block_export", F.lit(True), p))
    typed = F.concat(F.array(*single).cast(FINDING), precise.cast(FINDING))
    clear = F.col("errors") == F.array().cast("array<string>") if check_schema else F.col("d").isNotNull()
    chosen = F.when(clear, typed).otherwise(schema.cast(FINDING))
    flat = docs.select(key, F.explode(F.array_compact(chosen)).alias("f")).select(key, "f.*")
    return flat.unionByName(line_findings(docs.where(clear), key))


def line_findings(docs: DataFrame, key: str) -> DataFrame:
    """Lines whose net amount is not quantity * price / base with their allowances and charges. Tested without division:
    |(net + allowances - charges) * base - quantity * price| > tolerance * |base|; a line that lacks one of the four is not tested."""
    tolerance = D.tolerance(F.col("d.invoice.currency"))
    flagged = lambda flag: F.aggregate(F.transform(F.filter("x.allowances_charges", lambda c: F.lower(c.charge_indicator) == flag), lambda c: D.or_zero(c.amount)), F.lit(0).cast("decimal(38,8)"), lambda s, v: (s + v).cast("decimal(38,8)"))
    rows = docs.select(key, tolerance.alias("tol"), F.explode("d.line_items").alias("x")).where("tol is not null")
    rows = rows.select(key, "tol", F.col("x.line_no").alias("line_no"), *[D.parse(F.col(f"x.{c}")).alias(a) for a, c in (("q", "quantity"), ("p", "unit_price"), ("b", "price_base_quantity"), ("net", "line_net_amount"))], F.coalesce(flagged("false"), F.lit(0)).alias("less"), F.coalesce(flagged("true"), F.lit(0)).alias("more"))
    whole = F.abs((F.col("net") + F.col("less") - F.col("more")) * F.col("b") - F.col("q") * F.col("p"))
    off = rows.where((F.col("b") != 0) & (whole > F.col("tol") * F.abs("b")))
    path = F.concat(F.lit("/line_items/"), F.coalesce("line_no", F.lit("")), F.lit("/line_net_amount"))
    none = F.lit(None).cast("string")
    return off.select(key, F.lit("LINE_ITEM_RECONCILIATION_FAILED").alias("code"), F.lit("HIGH").alias("severity"), F.lit("require_confirmation").alias("behavior"), path.alias("field_paths"), D.text(F.col("net")).alias("observed"), none.alias("calculated"))
