"""Structured XML invoices (two vocabularies) to canonical columns, with fallback chains, in Column expressions."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.texts import compact_date, nested_tag

# Element paths of each vocabulary, tried in order.
PATHS = {
    "ubl": {
        "number": [("ID",)], "issue_date": [("IssueDate",)], "currency": [("DocumentCurrencyCode",)],
        "supplier_name": [("AccountingSupplierParty", "RegistrationName"), ("AccountingSupplierParty", "Name")], "buyer_name": [("AccountingCustomerParty", "RegistrationName"), ("AccountingCustomerParty", "Name")],
        "tax_exclusive_amount": [("LegalMonetaryTotal", "TaxExclusiveAmount")], "payable_amount": [("LegalMonetaryTotal", "PayableAmount")],
    },
    "cii": {
        "number": [("ExchangedDocument", "ID")], "issue_date": [("IssueDateTime", "DateTimeString")], "currency": [("InvoiceCurrencyCode",)],
        "supplier_name": [("SellerTradeParty", "Name")], "buyer_name": [("BuyerTradeParty", "Name")],
        "tax_exclusive_amount": [("TaxBasisTotalAmount",)], "payable_amount": [("DuePayableAmount",), ("GrandTotalAmount",)],
    },
}


# Declarations and comments of any length before the root element.
_PROLOGUE = r"(?s)^(?:[\s\x{FEFF}]++|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^\[>]*(?:\[.*?\]\s*)?>)*+"


def vocabulary(xml: Column) -> Column:
    """The vocabulary of the root element; null if it is another one."""
    root = lambda names: xml.rlike(_PROLOGUE + rf"<(?:[\w.-]+:)?(?:{names})(?=[\s/>])")
    return F.when(root("CrossIndustryInvoice"), "cii").when(root("Invoice|CreditNote"), "ubl")


def mapped(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds vocabulary, document_id (from the content's digest) and one column per field; unknown XML has null fields."""
    x = F.col(xml)
    kind = vocabulary(x)
    fields = {}
    for name in PATHS["ubl"]:
        value = F.lit(None).cast("string")
        for v, paths in PATHS.items():
            value = F.when(kind == v, F.coalesce(*[nested_tag(x, *p) for p in paths[name]])).otherwise(value)
        fields[name] = compact_date(value) if name.endswith("_date") else value
    return documents.withColumns({"vocabulary": kind, "document_id": F.concat(F.lit("structured_"), F.substring(F.sha2(x, 256), 1, 16)), **fields})


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
MAX_INFLATED = 2**20


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("xml", T.StringType()), T.StructField("issue", T.StringType())])))
def embedded_xml(content: pd.Series) -> pd.Series:
    """XML payloads in the streams of a PDF, inflated, else as they are; one of more than `MAX_INFLATED` bytes is an issue without XML."""

    def one(data: bytes | None) -> list[dict[str, str | None]]:
        found = []
        for m in _STREAM.finditer(data or b""):
            try:
                body = zlib.decompressobj().decompress(m.group(1), MAX_INFLATED + 1)
            except zlib.error:
                body = m.group(1)
            text = body.decode("utf-8", "replace").lstrip("\ufeff \r\n\t")
            if text.startswith("<"):
                large = len(body) > MAX_INFLATED
                found.append({"xml": None if large else text, "issue": f"stream over {MAX_INFLATED} bytes" if large else None})
        return found

    return content.map(one, na_action=None)
