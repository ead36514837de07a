"""Sinks: JSON Lines envelopes, a bundle of CSV tables, and an XLSX workbook of it."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.texts import neutral

#: Rows of a worksheet (fixed by the file format); larger tables are exported as CSV.
MAX_SHEET_ROWS = 1_048_576


def write_json(rows: DataFrame, path: str, version: str = "m1.0") -> None:
    """One envelope per row; nulls are written."""
    body = F.struct(F.lit(version).alias("export_version"), F.struct(*rows.columns).alias("canonical_invoice"))
    rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files with a header per table; text cells cannot become formulas."""
    for name, df in tables.items():
        safe = df.select(*[neutral(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        safe.write.option("header", "true").option("escape", '"').csv(f"{path}/{name}")


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook with one sheet per table, streamed row by row to one local file; meant for reports, not for bulk."""
    names = list(tables)
    sheets = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    relations = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>')
        for i, name in enumerate(names, 1):
            df = tables[name]
            if df.limit(MAX_SHEET_ROWS).count() >= MAX_SHEET_ROWS:
                raise ValueError(f"{name} has more rows than a worksheet; export it as CSV")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                cells = lambda row: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in row)
                sheet.write(f"<row>{cells(df.columns)}</row>".encode())
                for row in df.select(*[neutral(F.col(c).cast("string")).alias(c) for c in df.columns]).toLocalIterator():
                    sheet.write(f"<row>{cells(row)}</row>".encode("utf-8", "replace"))
                sheet.write(b"</sheetData></worksheet>")


class NotApproved(ValueError):
    """Raised where rows are exported that are not approved; names some of them."""


def export(tables: dict[str, DataFrame], fmt: str, path: str, statuses: DataFrame, key: str, approved: str = "approved") -> None:
    """Write tables in a format (json, csv or xlsx), but only if every row of `statuses` (key, review_status) is approved."""
    open_ones = statuses.where(F.coalesce(F.col("review_status") != approved, F.lit(True))).select(F.col(key).cast("string")).limit(20).collect()
    if open_ones:
        raise NotApproved("not approved: " + ", ".join(sorted(str(r[0]) for r in open_ones)))
    if fmt == "json":
        for name, df in tables.items():
            write_json(df, f"{path}/{name}")
    elif fmt == "csv":
        write_csv_bundle(tables, path)
    elif fmt == "xlsx":
        write_xlsx(tables, path)
    else:
        raise ValueError(f"unknown format {fmt}")
