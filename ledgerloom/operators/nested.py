"""Deeply nested JSON records to related flat tables by single-pass tagged emission.

A depth-first visitor walks each record once and emits one row per object it recognises: the table's tag, the row's
primary key (its path of positions), its parent's key and a JSON payload of that table's columns. The emission is
written partitioned by tag, and every table is read back from its own folder with its schema applied.

Results by case:
- null, blank or unparsable payloads, and JSON without any root object, give one row in `rejects` and no other row;
- JSON in a string within a payload that cannot be read gives a row in `rejects` under its parent; all else comes out;
- any depth is walked; a payload nested deeper than the JSON reader goes (some thousands) is unreadable;
- a list may be an array, a single object, an object of numbered entries, an object that wraps the array, or JSON in a
  string; nulls and scalars in it are skipped and take no position;
- an absent parent attribute is null in the flat tables; numbers and booleans come out as their JSON text;
- repeated records give their rows again under their own record key; records without a key keep a null key;
- an empty input gives empty tables with the same columns; further input columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import scratch_path

REJECTS = "rejects"


@dataclass(frozen=True)
class Level:
    """One table of the result.

    tag: the table's name. columns: output column -> paths of keys tried in order. marks: keys of which an object has
    at least one if it is a row of this table. key: where the children of a parent lie. under: keys of lists of plain
    groups that may stand between parent and rows. pass_on: columns that rows below repeat.
    """

    tag: str
    columns: dict[str, tuple[tuple[str, ...], ...]]
    marks: frozenset[str]
    key: str = ""
    under: tuple[str, ...] = ()
    pass_on: tuple[str, ...] = ()
    children: tuple[Level, ...] = field(default=())


def _path(*paths: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(p.split(".")) for p in paths)


_TAX = Level(
    tag="taxes",
    key="tax_breakdowns",
    marks=frozenset({"tax_type", "tax_amount", "taxable_amount", "rate", "category_code", "component", "source_label"}),
    columns={c: _path(c) for c in ("tax_type", "component", "jurisdiction_code", "category_code", "rate", "taxable_amount", "tax_amount", "payable_effect", "exemption_code", "exemption_reason", "reverse_charge", "source_label")},
)
_LINE = Level(
    tag="lines",
    key="line_items",
    under=("sections",),
    marks=frozenset({"line_id", "line_no", "description", "quantity", "unit_price", "line_net_amount", "item_name"}),
    columns={c: _path(c) for c in ("line_id", "line_no", "description", "item_name", "seller_item_id", "buyer_item_id", "quantity", "unit_code", "unit_price", "price_base_quantity", "line_net_amount", "line_gross_amount")},
    pass_on=("line_id",),
    children=(_TAX,),
)
#: The canonical invoice. A string in place of a region pack or a source stands for its id or family.
INVOICE = Level(
    tag="invoices",
    marks=frozenset({"document_id", "schema_version", "line_items", "tax_breakdowns"}),
    columns={
        "document_id": _path("document_id"),
        "schema_version": _path("schema_version"),
        "document_type": _path("document_type"),
        "region_pack_id": _path("locale.applied_region_pack.id", "locale.applied_region_pack"),
        "region_pack_version": _path("locale.applied_region_pack.version"),
        "source_family": _path("source.family", "source"),
        "source_route": _path("source.route"),
        "document_language": _path("locale.document_language"),
        "supplier_country": _path("locale.supplier_country"),
        "buyer_country": _path("locale.buyer_country"),
        "supplier_name": _path("supplier.display_name", "supplier.legal_name"),
        "buyer_name": _path("buyer.display_name", "buyer.legal_name"),
        "invoice_number": _path("invoice.number"),
        "issue_date": _path("invoice.issue_date"),
        "currency": _path("invoice.currency"),
        "tax_exclusive_amount": _path("totals.tax_exclusive_amount"),
        "total_tax_amount": _path("totals.total_tax_amount"),
        "payable_amount": _path("totals.payable_amount"),
    },
    pass_on=("document_id", "region_pack_id", "source_family"),
    children=(_TAX, _LINE),
)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return None if isinstance(value, (dict, list)) else str(value)


def _pick(node: dict, paths: tuple[tuple[str, ...], ...]) -> str | None:
    for path in paths:
        value: object = node
        for key in path:
            value = value.get(key) if isinstance(value, dict) else None
        if (text := _text(value)) is not None:
            return text
    return None


_NESTED = re.compile(r"\s*[\[{]")
#: Text that must have been meant as JSON.
_MEANT = re.compile(r"\s*(?:\{\s*\"|\[\s*[\[{\"])")


def _objects(value: object, marks: frozenset[str], bad: list[str], texts_in_objects: bool = False) -> Iterator[dict]:
    """The objects of a list in any of its shapes, in payload order; `bad` takes what is wrong with JSON in a string.

    With an explicit stack: records may be nested deeper than calls can.
    """
    stack = [value]
    while stack:
        value = stack.pop()
        if isinstance(value, str):
            if _NESTED.match(value):
                try:
                    inner = json.loads(value, parse_int=str, parse_float=str)
                except (ValueError, RecursionError) as e:
                    if _MEANT.match(value):
                        bad.append(str(e)[:200])
                else:
                    stack.append(inner)
        elif isinstance(value, list):
            stack += reversed(value)
        elif isinstance(value, dict):
            if marks & value.keys():
                yield value
            else:
                stack += [x for x in reversed(value.values()) if texts_in_objects or isinstance(x, (dict, list))]


def _below(node: dict, level: Level, bad: list[str]) -> Iterator[dict]:
    stack = [iter(node.items())]
    while stack:
        for key, value in stack[-1]:
            if key == level.key:
                yield from _objects(value, level.marks, bad)
            elif key in level.under:
                groups = value if isinstance(value, list) else [value]
                stack.append(chain.from_iterable(g.items() for g in groups if isinstance(g, dict)))
                break
        else:
            stack.pop()


Row = tuple[str, str, "str | None", "list[int]", str]


def visit(payload: str | None, level: Level = INVOICE) -> Iterator[Row]:
    """(tag, key, parent key, positions, JSON of the columns) of every object of a payload, parents first."""
    try:
        tree = json.loads(payload.lstrip("\ufeff"), parse_int=str, parse_float=str) if payload is not None else None
    except (ValueError, RecursionError) as e:
        yield REJECTS, "0", None, [0], _json({"reason": "unreadable", "detail": str(e)[:200]})
        return
    found = False
    depths = _depths(level)
    bad: list[str] = []
    for at, root in enumerate(_objects(tree, level.marks, bad, texts_in_objects=True), 1):
        found = True
        yield from _emit(root, level, depths, [at], None, {})
    yield from _unread(bad, None)
    if not found:
        yield REJECTS, "0", None, [0], _json({"reason": "empty" if tree is None else "no record"})


def _unread(bad: list[str], parent: str | None) -> Iterator[Row]:
    """A row for each part that cannot be read, under the row that should have held it."""
    for i, detail in enumerate(bad, 1):
        yield REJECTS, f"{parent}.x{i}" if parent else f"x{i}", parent, [0], _json({"reason": "unreadable part", "detail": detail})


def _emit(node: dict, level: Level, depths: dict[str, int], positions: list[int], parent: str | None, inherited: dict[str, str | None]) -> Iterator[Row]:
    key = ".".join(map(str, positions))
    values = inherited | {c: _pick(node, paths) for c, paths in level.columns.items()}
    bad: list[str] = []
    below = [(child, list(_below(node, child, bad))) for child in level.children]
    yield level.tag, key, parent, positions, _json({c: v for c, v in values.items() if v is not None} | {f"n_{child.tag}": len(rows) for child, rows in below})
    yield from _unread(bad, key)
    passed = inherited | {c: values[c] for c in level.pass_on}
    for child, rows in below:
        # rows that hang above the deepest place of their table (taxes of the document) take position 0 in between
        gap = [0] * (depths[child.tag] - len(positions))
        for at, row in enumerate(rows, 1):
            yield from _emit(row, child, depths, [*positions, *gap, at], key, passed)


def _json(values: dict) -> str:
    return json.dumps(values, ensure_ascii=False).encode("utf-8", "replace").decode()


def _depths(level: Level, above: int = 1) -> dict[str, int]:
    """How many positions come before a table's own, at the deepest place where it occurs."""
    out: dict[str, int] = {}
    for child in level.children:
        for tag, depth in ({child.tag: above} | _depths(child, above + 1)).items():
            out[tag] = max(depth, out.get(tag, 0))
    return out


def schema_of(level: Level, inherited: tuple[str, ...] = ()) -> dict[str, T.StructType]:
    """The payload schema of each table."""
    out: dict[str, T.StructType] = {}
    for child in level.children:
        for tag, schema in schema_of(child, (*inherited, *level.pass_on)).items():
            known = {f.name: f for f in out[tag].fields} if tag in out else {}
            out[tag] = T.StructType([*known.values(), *(f for f in schema.fields if f.name not in known)])
    own = [T.StructField(c, T.StringType()) for c in dict.fromkeys((*inherited, *level.columns))]
    out[level.tag] = T.StructType([*own, *(T.StructField(f"n_{c.tag}", T.IntegerType()) for c in level.children)])
    return out


EMITTED = T.StructType([
    T.StructField("record_key", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("parent_key", T.StringType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("payload", T.StringType()),
    T.StructField("tag", T.StringType()),
])
_ARROW = pa.schema([("record_key", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("positions", pa.list_(pa.int32())), ("payload", pa.string()), ("tag", pa.string())])
_BATCH = 4096


def emit(records: DataFrame, key: str, payload: str, level: Level = INVOICE) -> DataFrame:
    """The tagged emission of every record: no shuffle, one pass, bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for tag, own, parent, positions, body in visit(text.as_py(), level):
                    rows.append((record, own, parent, positions, body, tag))
                if len(rows) >= _BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return records.select(F.col(key).cast("long").alias("record_key"), F.col(payload).cast("string").alias("payload")).mapInArrow(run, EMITTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def flatten_records(records: DataFrame, key: str = "record_id", payload: str = "payload", level: Level = INVOICE) -> dict[str, DataFrame]:
    """The related flat tables of nested records, by tag, and `rejects`.

    Columns: `key` (the record's), `row_key` and `parent_key` (paths of positions within the record, unique with the
    record's key), `positions`, then the table's own columns and those that it repeats from the tables above it.
    """
    spark = records.sparkSession
    path = scratch_path(spark, "emission")
    emit(records, key, payload, level).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    written = spark.read.schema(EMITTED).parquet(path)
    schemas = schema_of(level) | {REJECTS: T.StructType([T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType())])}
    return {
        tag: written.where(F.col("tag") == tag)  # prunes to the folder of this tag
        .select(F.col("record_key").alias(key), F.col("key").alias("row_key"), "parent_key", "positions", F.from_json("payload", schema).alias("_row"))
        .select(key, "row_key", "parent_key", "positions", *[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
        for tag, schema in schemas.items()
    }
