import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X
from ledgerloom.operators import coerce, evaluate, history, merge, trees
from ledgerloom.session import lookup_join
from ledgerloom.sources import exports, sniff


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(column(F.col("x"))).collect()]


def test_decimals(spark):
    assert values(spark, D.parse, "1.50", "-0", "1e3", "", None, " 1", "1.123456789", "9" * 21) == [Decimal("1.5"), Decimal(0), None, None, None, None, None, None]
    assert values(spark, lambda c: D.text(D.parse(c)), "100", "-0.00", "10.50", "0.00000001", None) == ["100", "0", "10.5", "0.00000001", None]
    assert values(spark, D.scale, "1.10", "1", "1.1234", "x") == [1, 0, 4, None]
    assert values(spark, D.minor_units, "jpy", " KWD", "AED", None) == [0, 3, None, None]


def test_texts(spark):
    assert values(spark, X.neutral, "=1", "-5", "+a", "@x", "a=1", None) == ["'=1", "'-5", "'+a", "'@x", "a=1", None]
    assert values(spark, X.iso_date, "2025-02-28", "2025-02-30", "2025", None)[1:] == [None, None, None]
    assert values(spark, lambda c: X.version_relation(c, "2.1"), "2.1", "2.0.3", "2.2", "3.0", "2", None) == ["compatible", "migration_required", "future_minor", "other_major", "invalid", "invalid"]
    assert values(spark, lambda c: X.nested_tag(c, "a", "b"), "<x:A k='1'><y:b>\n v </y:b></x:A>", "<a></a>", "<ab>1</ab>", None) == ["v", None, None, None]
    nul = values(spark, lambda c: X.digest(c, F.lit(None)), "a")[0]
    assert nul == values(spark, lambda c: X.digest(c, F.lit("")), "a")[0] != values(spark, lambda c: X.digest(c), "a")[0]


def test_coercion(spark):
    got = values(spark, lambda c: coerce.coerced(c, "integer", "numeric"), "5.00", "5.5", "x", "", None)
    assert [tuple(g) for g in got] == [("5", None), (None, "not_integer"), (None, "not_integer"), (None, None), (None, None)]
    assert values(spark, lambda c: coerce.coerced(c, "date", "date", nullable=False), "")[0].issue == "required_value_missing"


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "k int, v string")
    once = merge.upsert(target, new, ["k"], ["v"])
    assert sorted((r.k or 0, r.v) for r in once.collect()) == [(0, "n"), (1, "a"), (2, "B"), (3, "D")]
    assert sorted(map(str, merge.upsert(once, new, ["k"], ["v"]).collect())) == sorted(map(str, once.collect()))
    assert tuple(merge.upsert_counts(target, new, ["k"]).first()) == (1, 1, 2)
    assert merge.upsert(target, new.where("false"), ["k"]).count() == 3


def test_replace_children(spark):
    target = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "d string, n int")
    assert sorted(map(tuple, merge.replace_children(target, spark.createDataFrame([("d1", 9)], "d string, n int"), "d").collect())) == [("d1", 9), ("d2", 1)]


def test_history(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "g string, t int, c string")
    assert sorted(map(tuple, history.latest(rows, ["g"], ["t"]).select("g", "t").collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, history.first_seen(rows, "c", "t").select("c", "first", "copies").distinct().collect())) == [("x", 1, 2), ("y", 2, 1)]
    events = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 4, 3, 1])], "u int, i int, c int")
    assert [r.accepted for r in history.within_limit(events, "u", ["i"], "c", 9).orderBy("i").collect()] == [True, True, False, False]


def test_comparison_modes(spark):
    df = spark.createDataFrame([("1.0", "1"), (" A  b", "a B"), (None, None), ("x", None)], "e string, o string")
    of = lambda mode, n=False: [r[0] for r in df.select(evaluate.outcome(F.col("e"), F.col("o"), mode, n)).collect()]
    assert of("decimal")[0] == "matched" and of("exact")[0] == "mismatch" and of("normalized")[1] == "matched"
    assert of("exact")[2:] == ["field_missing"] * 2 and of("exact", True)[2:] == ["matched", "field_missing"]


def test_trees():
    assert trees.resolve({"a/b": [1, {"~": None}]}, "/a~1b/1/~0") is None
    assert trees.resolve({}, "/x") is trees.MISSING
    assert list(trees.changed_leaves({"a": 1, "b": [1], "c": {"d": 1}}, {"a": 1.0, "b": [2], "c": {"d": 1, "e": None}})) == ["/a", "/b", "/c/e"]
    assert trees.merge_patch({"a": {"b": 1, "c": 2}}, {"a": {"b": None}, "d": 3}) == {"a": {"c": 2}, "d": 3}
    schema = {"type": "object", "additionalProperties": False, "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"enum": ["x"]}, "l": {"type": "array", "maxItems": 1, "items": {"type": "string", "pattern": "^a"}}}}
    assert sorted(trees.schema_errors({"n": 0, "s": "y", "l": ["b", "a"], "z": 1}, schema)) == [("/l", "maxItems"), ("/l/0", "pattern"), ("/n", "minimum"), ("/s", "enum"), ("/z", "additionalProperties")]
    assert list(trees.schema_errors({"n": True}, schema)) == [("/n", "type")] and list(trees.schema_errors({}, schema)) == [("/n", "required")]


def test_tree_columns(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"c": null}}', '{"a":{"c":null},"b":1}'), ("{", None)], "x string, y string")
    row = df.select(trees.sorted_digest("x").alias("dx"), trees.sorted_digest("y").alias("dy"), trees.json_pointer("x", F.lit("/a/c")).alias("p"), trees.patched("x", F.lit('{"b": 2}'), F.array(F.lit("/b"))).alias("t")).collect()
    assert row[0].dx == row[0].dy and row[0].p == "null" and json.loads(row[0].t)["b"] == 2
    assert tuple(row[1]) == (None, None, None, None)


def test_sniffing_and_archives(spark, tmp_path):
    blobs = [(b"%PDF-1.4 /Type /Page /Type /Page %%EOF",), (b"\xff\xd8\xff\xe0",), (b"\x89PNG\r\n\x1a\n",), (b" \n<a><!DOCTYPE x></a>",), (b"{}",), (b"",), (None,), (b"%PDF /Encrypt %%EOF",), (b"plain",)]
    rows = sniff.inspected(spark.createDataFrame(blobs, "content binary")).collect()
    assert [r.format for r in rows[:5]] == ["pdf", "jpeg", "png", "xml", "json"] and rows[0].n_pages == 2
    assert [r.status for r in rows] == ["accepted", "accepted", "accepted", "quarantined", "accepted", "rejected", rows[6].status, "quarantined", "quarantined"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("a.xml", "../evil", "__MACOSX/x", "d/b.txt"):
            z.writestr(name, name)
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(sniff.MAX_ENTRIES + 1):
            z.writestr(str(i), "")
    df = spark.createDataFrame([("ok", data.getvalue()), ("bad", b"no"), ("many", many.getvalue()), ("null", None)], "path string, content binary")
    got = {(r.key, r.entry): r.issue for r in sniff.archive_entries(df).collect()}
    assert got == {("ok", "a.xml"): None, ("ok", "../evil"): "unsafe_entry", ("ok", "d/b.txt"): None, ("bad", None): "not_an_archive", ("many", None): "archive_limits", ("null", None): "archive_size"}
    (tmp_path / "f.bin").write_bytes(b"{}")
    assert sniff.files(spark, str(tmp_path)).count() == 1


def test_exports_read_back(spark, tmp_path):
    df = spark.createDataFrame([("d1", "=x", None), ("d,2", 'a "b"', "-1")], "id string, name string, amount string")
    exports.write_csv_bundle({"t": df}, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv/t")).collect()
    assert sorted(map(tuple, back)) == sorted([("d1", "'=x", None), ("d,2", 'a "b"', "'-1")])
    exports.write_json(df, str(tmp_path / "json"))
    assert {json.loads(r.value)["canonical_invoice"]["amount"] for r in spark.read.text(str(tmp_path / "json")).collect()} == {None, "-1"}
    exports.write_xlsx({"t": df, "u": df}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert z.testzip() is None and "&apos;=x" not in z.read("xl/worksheets/sheet1.xml").decode() and "'=x" in z.read("xl/worksheets/sheet2.xml").decode()


@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_is_the_same_broadcast_or_salted(spark, small):
    rows = spark.range(1000).selectExpr("id", "if(id < 700, 'hot', cast(id % 5 as string)) as k")
    lookup = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    out = lookup_join(rows, lookup, ["k"], "id", small=small)
    assert (out.count(), out.where("v = 1").count(), out.where("v is null").count()) == (1000, 700, 240)
