"""Arithmetic, precision, date and completeness rules over invoice tables, as one array of findings per document.

A missing or unknown currency switches the arithmetic rules off; a blank observed amount skips its rule, a blank input
of the calculated side counts as zero; differences of up to one minor unit are no finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X

# Weights of severities in a document's risk.
RISK = {"CRITICAL": 100, "HIGH": 50, "MEDIUM": 20, "LOW": 5, "INFO": 1}
MONEY = ("line_extension_amount", "allowance_total_amount", "charge_total_amount", "tax_exclusive_amount", "total_tax_amount", "tax_inclusive_amount", "prepaid_amount", "withholding_total_amount", "rounding_amount", "payable_amount")


def finding(code: str, severity: str, when: Column, path: str, observed: Column | None = None, calculated: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(
        when,
        F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(path).alias("field_path"), (none if observed is None else observed.cast("string")).alias("observed"), (none if calculated is None else calculated).alias("calculated")),
    )


def header_findings(invoices: DataFrame, today: str) -> DataFrame:
    """Adds `findings`, an array of (code, severity, field_path, observed, calculated)."""
    # every amount is parsed once, in a projection of its own: the rules share the columns and stay small enough to compile
    parsed = invoices.withColumns({f"_{m}": D.parse(F.col(m)) for m in MONEY} | {f"_scale_{m}": D.scale(F.col(m)) for m in MONEY})
    parsed = parsed.withColumns({"_tolerance": D.tolerance(F.col("currency")), "_units": D.minor_units(F.col("currency"))})
    z = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0).cast(D.TYPE))
    _off = lambda observed, calculated: F.abs(F.col(f"_{observed}") - calculated) > F.col("_tolerance")
    calculated = {}
    calculated["_exclusive"] = z("line_extension_amount") - z("allowance_total_amount") + z("charge_total_amount")
    calculated["_inclusive"] = z("tax_exclusive_amount") + z("total_tax_amount")
    calculated["_payable"] = z("tax_inclusive_amount") - z("prepaid_amount") - z("withholding_total_amount") + z("rounding_amount")
    parsed = parsed.withColumns(calculated | {"_date": X.iso_date(F.col("issue_date"))})
    parsed = parsed.withColumns({f"_text{c}": D.text(F.col(c)) for c in calculated})
    exclusive, inclusive, payable, date, units = (F.col(c) for c in ("_exclusive", "_inclusive", "_payable", "_date", "_units"))
    rules = [
        finding("DOCUMENT_TYPE_AMBIGUOUS", "CRITICAL", F.col("document_type") == "unknown", "/document_type"),
        finding("CURRENCY_MISSING_OR_AMBIGUOUS", "CRITICAL", X.blank(F.col("currency")), "/invoice/currency"),
        finding("PAYABLE_AMOUNT_MISSING", "CRITICAL", X.blank(F.col("payable_amount")), "/totals/payable_amount"),
        finding("AMBIGUOUS_DOCUMENT_DATE", "HIGH", ~X.blank(F.col("issue_date")) & date.isNull(), "/invoice/issue_date", F.col("issue_date")),
        finding("FUTURE_ISSUE_DATE", "HIGH", date > F.lit(today).cast("date"), "/invoice/issue_date", F.col("issue_date")),
        finding("HEADER_TOTAL_MISMATCH", "CRITICAL", _off("tax_exclusive_amount", exclusive), "/totals/tax_exclusive_amount", F.col("tax_exclusive_amount"), F.col("_text_exclusive")),
        finding("TAX_INCLUSIVE_TOTAL_MISMATCH", "CRITICAL", _off("tax_inclusive_amount", inclusive), "/totals/tax_inclusive_amount", F.col("tax_inclusive_amount"), F.col("_text_inclusive")),
        finding("PAYABLE_TOTAL_MISMATCH", "CRITICAL", _off("payable_amount", payable), "/totals/payable_amount", F.col("payable_amount"), F.col("_text_payable")),
        *[finding("CURRENCY_PRECISION_MISMATCH", "HIGH", units.isNotNull() & ~X.blank(F.col(m)) & (F.col(f"_scale_{m}").isNull() | (F.col(f"_scale_{m}") > units)), f"/totals/{m}", F.col(m)) for m in MONEY],
    ]
    return parsed.withColumn("findings", F.array_compact(F.array(*rules))).select(*[c for c in invoices.columns if c != "findings"], "findings")


def line_reconciliation(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """(row_id, net, expected) of lines whose net amount is not quantity * price / base, within a minor unit.

    Tested without division: |net * base - quantity * price| <= tolerance * |base|. A currency that differs between
    deliveries of one document takes the smallest; lines of absent documents or unknown currencies are not tested.
    """
    currency = invoices.where("document_id is not null").groupBy("document_id").agg(F.min("currency").alias("currency"))
    p = lambda c: F.when(F.col(c).rlike(r"^-?\d{1,9}(\.\d{1,8})?$"), F.col(c).try_cast("decimal(18,8)"))
    base = F.when(X.blank(F.col("price_base_quantity")), F.lit(1).cast("decimal(18,8)")).otherwise(p("price_base_quantity"))
    tested = lines.join(currency, "document_id").select("row_id", "currency", p("line_net_amount").alias("net"), p("quantity").alias("q"), p("unit_price").alias("p"), base.alias("base"))
    tested = tested.withColumn("tol", D.tolerance(F.col("currency")).cast("decimal(18,8)")).where("base <> 0")
    off = F.abs((F.col("net") * F.col("base")).cast("decimal(38,12)") - (F.col("q") * F.col("p")).cast("decimal(38,12)")) > (F.col("tol") * F.abs("base")).cast("decimal(38,12)")
    return tested.where(off).select("row_id", D.text(F.col("net")).alias("net"), F.round((F.col("q") * F.col("p")).cast("double") / F.col("base").cast("double"), 4).alias("expected"))


def tax_conflicts(invoices: DataFrame, taxes: DataFrame) -> DataFrame:
    """(row_id, total_tax, sum_tax) of invoices whose document-level taxes do not add up to their total."""
    sums = taxes.where("line_id is null and document_id is not null").groupBy("document_id").agg(F.sum(D.or_zero(F.col("tax_amount"))).alias("s"))
    joined = invoices.join(sums, "document_id")
    total = D.parse(F.col("total_tax_amount"))
    return joined.where(F.abs(total - F.col("s")) > D.tolerance(F.col("currency"))).select("row_id", D.text(total).alias("total_tax"), D.text(F.col("s").cast("decimal(38,8)")).alias("sum_tax"))


def risk(found: DataFrame, by: str) -> DataFrame:
    weights = F.create_map(*[x for s, w in RISK.items() for x in (F.lit(s), F.lit(w))])
    return found.groupBy(by).agg(F.sum(weights[F.col("severity")]).cast("long").alias("risk_score"), F.count(F.lit(1)).alias("n_findings"))
