"""Fingerprints of documents from normalised identifying parts, and documents that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X


def parts() -> list[Column]:
    c = F.col
    return [X.key(c("supplier_name")), X.key(c("buyer_name")), X.key(c("invoice_number")), X.iso_date(c("issue_date")).cast("string"), F.upper(F.trim(c("currency"))), D.text(D.parse(c("payable_amount"))), D.text(D.parse(c("total_tax_amount")))]


def fingerprinted(invoices: DataFrame) -> DataFrame:
    """Adds `fingerprint` (SHA-256 of the parts) and `complete`: a document lacking a required part has no duplicates."""
    known = parts()
    required = [known[i] for i in (0, 2, 3, 4, 5)]
    ok = F.lit(True)
    for p in required:
        ok = ok & ~F.coalesce(X.blank(p), F.lit(True))
    return invoices.withColumn("fingerprint", X.digest(*known)).withColumn("complete", ok)


def duplicates(invoices: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, first_row_id, copies): members of each class of complete documents; copies are not expanded to pairs."""
    rows = fingerprinted(invoices).where("complete").select(F.col(row_id).alias("row_id"), "fingerprint")
    classes = rows.groupBy("fingerprint").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(classes, "fingerprint").select("row_id", "first_row_id", "copies")
