from datetime import datetime

from ledgerloom.operators.orphans import orphan_references

T = [datetime(2025, 1, d) for d in range(1, 10)]


def run(spark, children, parents):
    c = spark.createDataFrame(children, "row_id long, document_id string, received_at timestamp, deleted_at string")
    p = spark.createDataFrame(parents, "document_id string, received_at timestamp, deleted_at timestamp, row_id long")
    found = orphan_references(c, p, ["document_id"], ["document_id"], deleted_at="deleted_at")
    return sorted((r.row_id, r.reason) for r in found.collect())


def test_reasons(spark):
    children = [(1, " DOC_a ", T[3], "x"), (2, "none", T[3], "x"), (3, None, T[3], "x"), (4, "  ", T[3], "x"), (5, "doc_late", T[3], "x"), (6, "doc_late", T[6], "x"), (7, "doc_gone", T[3], "x"), (8, "doc_gone", T[5], "x"), (9, "doc_mixed", T[3], "x"), (10, "none", None, "x"), (11, "doc_late", None, "x")]
    parents = [("doc_A", T[0], None, 1), ("doc_late", T[5], None, 2), ("doc_gone", T[0], T[5], 3), ("doc_mixed", T[5], None, 4), ("doc_mixed", T[0], T[1], 5), (None, T[0], None, 6)]
    assert run(spark, children, parents) == [(2, "missing"), (5, "late"), (8, "deleted"), (10, "missing")]


def test_null_times_of_parents_are_never_late(spark):
    assert run(spark, [(1, "a", T[0], None)], [("a", None, None, 1), ("a", T[5], None, 2)]) == []


def test_repeats_and_empty_tables(spark):
    assert run(spark, [(1, "a", T[0], None), (1, "a", T[0], None)], [("b", T[0], None, 1)]) == [(1, "missing"), (1, "missing")]
    empty = spark.createDataFrame([], "document_id string, received_at timestamp, deleted_at timestamp, row_id long")
    child = spark.createDataFrame([(1, "a", T[0])], "row_id long, document_id string, received_at timestamp")
    assert orphan_references(child, empty, ["document_id"], ["document_id"], deleted_at="deleted_at").count() == 1
    assert orphan_references(child.where("false"), empty, ["document_id"], ["document_id"]).count() == 0


def test_hot_key_and_compound_keys(spark):
    children = spark.range(5000).selectExpr("id as row_id", "'hot' as document_id", "'L1' as line_id", "timestamp'2025-01-01' as received_at")
    parents = spark.createDataFrame([("HOT", "l2", T[0])], "document_id string, line_id string, received_at timestamp")
    keys = ["document_id", "line_id"]
    assert orphan_references(children, parents, keys, keys).count() == 5000
