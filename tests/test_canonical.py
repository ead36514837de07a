"""Every rule and export table on documents made to meet each case, against the SQL of the queries."""

import json

import duckdb
import pytest

from ledgerloom.operators import canonical as C
from ledgerloom.operators import delivery, evaluate
from ledgerloom.plans import canonical_queries as Q
from tests.test_queries import rows

PARTY = {"display_name": "A", "legal_name": None, "identifiers": [{"scheme": "VAT", "value": "1"}, {"scheme": "X", "value": None}], "address": {"lines": [], "city": "T"}}
GOOD = {
    "schema_version": "2.0", "document_id": "doc_00000001", "document_type": "invoice", "source": {"family": "ubl", "route": "structured_parser"}, "locale": {"applied_region_pack": {"id": "p"}}, "supplier": PARTY, "uncertainties": [],
    "invoice": {"number": "1", "issue_date": "2026-01-02", "currency": "EUR"}, "evidence": [{"field_path": p} for p in C.EVIDENCE], "line_items": [], "tax_breakdowns": [{"tax_amount": "1.50"}, {"tax_amount": "0.5", "reverse_charge": True}],
    "totals": {"line_extension_amount": "10", "allowance_total_amount": "1", "charge_total_amount": "1.00", "tax_exclusive_amount": "10.01", "total_tax_amount": "2", "tax_inclusive_amount": "12.01", "payable_amount": "12.01"},
}
LINE = {"line_id": "a", "line_no": 1, "quantity": "3", "unit_price": "2.50", "price_base_quantity": "2", "line_net_amount": "3.75", "tax_breakdowns": [{"tax_type": "V", "rate": "20"}]}


def changed(**parts):
    out = json.loads(json.dumps(GOOD))
    for path, value in parts.items():
        node, *rest = path.split("__")
        if rest:
            out[node] = out[node] | {rest[0]: value}
        else:
            out[node] = value
    return out


CASES = {
    "good": GOOD, "again": GOOD, "unknown": changed(document_type="unknown"), "no_currency": changed(invoice__currency=""), "null_currency": changed(invoice__currency=None), "odd_currency": changed(invoice__currency="XXX", totals__payable_amount="9"),
    "no_payable": changed(totals__payable_amount=None), "quarantine": changed(source__route="quarantine"), "other_route": changed(source__route="guess"), "no_route": changed(source={}), "no_evidence": changed(evidence=[{"field_path": "/invoice/number"}]),
    "bad_date": changed(invoice__issue_date="02.01.2026"), "no_day": changed(invoice__issue_date="2026-02-30"), "future": changed(invoice__issue_date="2027-01-01"), "off_header": changed(totals__tax_exclusive_amount="10.02"), "off_inclusive": changed(totals__tax_inclusive_amount="12.10"),
    "off_payable": changed(totals__payable_amount="100"), "yen": changed(invoice__currency="JPY"), "precise": changed(totals__prepaid_amount="0.001", totals__rounding_amount="1e3", totals__charge_total_amount="1.000"), "huge": changed(totals__payable_amount="9" * 25),
    "off_tax": changed(totals__total_tax_amount="5"), "no_taxes": changed(tax_breakdowns=[], totals__total_tax_amount="5"), "payee": changed(payee=PARTY | {"identifiers": [], "address": None}, buyer=None),
    "lines": changed(line_items=[LINE, LINE | {"line_no": 2, "line_net_amount": "3.77"}, LINE | {"line_no": 3, "price_base_quantity": ""}, LINE | {"line_no": 4, "line_net_amount": "3.751"}, LINE | {"line_no": 5, "allowances_charges": [{"charge_indicator": False, "amount": "1"}, {"charge_indicator": True, "amount": "0.25"}], "line_net_amount": "3.00"}, LINE | {"line_no": 6, "price_base_quantity": "0"}, LINE | {"line_no": 7, "quantity": "12345678901", "line_net_amount": "1"}]),
    "extra": changed(foo=1), "old": changed(schema_version="1.0"), "short": changed(document_id="x"), "lacking": {k: v for k, v in GOOD.items() if k not in ("totals", "evidence")}, "empty": {},
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("made"))
    for name, df in {
        "canonical_records": spark.createDataFrame([(k, json.dumps(v)) for k, v in CASES.items()], "ground_truth string, record_json string"),
        "manifest": spark.createDataFrame([("good", "ready_for_approval"), ("good", None), ("lines", "needs_review"), (None, "x")], "ground_truth string, expected_status string"),
        "approved_batch": spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(CASES.values())] + [(100, "{"), (101, None), (102, "[]"), (103, '{"source": "ubl"}')], "record_id long, payload string"),
    }.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in ("canonical_records", "manifest", "approved_batch"):
        con.execute(f"create view {name} as select * from read_parquet('{path}/{name}.parquet/*.parquet')")
    return path, con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_on_made_documents(spark, made, name):
    path, con = made
    got = rows(Q.QUERIES[name](spark, path).toPandas())
    assert got == rows(con.execute(Q.SQL[name]).df())
    assert got[1]


def test_unreadable_documents_have_one_finding_and_no_rows(spark):
    docs = C.documents(spark.createDataFrame([("a", "{"), ("b", None), ("c", "[1]"), ("d", "")], "ground_truth string, record_json string"))
    found = C.findings(docs, "ground_truth", "2026-01-01").collect()
    assert sorted((r.ground_truth, r.code, r.field_paths) for r in found) == [(k, "SCHEMA_INVALID", "") for k in "abcd"]
    assert all(t(docs, "ground_truth").count() == 0 for t in (C.party_table, C.identifier_table, C.line_table, C.tax_table))


def test_percentiles_with_ties_nulls_and_single_values(spark):
    data = [("a", float(v)) for v in [5] * 300 + list(range(100))] + [("a", None), ("b", 7.0), (None, 1.0), (None, 2.0), ("c", None)]
    got = {r.g: (r.p50, r.p95) for r in evaluate.percentiles(spark.createDataFrame(data, "g string, v double"), "g", "v", 0.5, 0.95).collect()}
    assert got == {"a": (5.0, 79.0), "b": (7.0, 7.0), None: (1.0, 2.0)}
    assert evaluate.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0


def test_mapping_push_and_export_gate(spark, tmp_path):
    from ledgerloom.sources import delimited, exports

    rows_ = spark.createDataFrame([(1, "a", "1.5", "x"), (2, None, "2", "x"), (3, "c", "1e3", "x")], "id long, name string, amount string, issues string")
    out = delivery.transformed(rows_, "id", [("name", "n", "text", "text", False), ("amount", "a", "decimal", "numeric", True)])
    assert [(r.n, r.a, r.issues) for r in out.orderBy("id").collect()] == [("a", "1.5", []), (None, "2", ["n:required_value_missing"]), ("c", None, ["a:not_decimal"])]
    done = delivery.push_outcomes(out, out.where("id = 1").withColumn("issues", out.issues), "id")
    assert {r.id: r.status for r in done.collect()} == {1: "pushed", 2: "failed", 3: "failed"}
    assert delivery.push_status(done).first()["status"] == "partial" and delivery.to_retry(rows_, done, "id").count() == 2
    statuses = spark.createDataFrame([(1, "approved"), (2, None)], "id long, review_status string")
    with pytest.raises(exports.NotApproved, match="2"):
        exports.export({"t": rows_}, "csv", str(tmp_path / "x"), statuses, "id")
    exports.export({"t": rows_}, "csv", str(tmp_path / "y"), statuses.where("id = 1"), "id")
    assert delimited.read_csv(spark, str(tmp_path / "y" / "t")).count() == 3
    exports.export({"t": rows_}, "json", str(tmp_path / "z"), statuses.where("false"), "id")
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert delimited.read_config(spark, str(tmp_path / "c.json")) == {"a": 1}


def test_streams_go_on_where_they_ended_and_count_late_rows(spark, tmp_path):
    from ledgerloom.streaming import events as S

    def put(name, rows_):
        spark.createDataFrame([(i, t, k, v) for i, t, k, v in rows_], "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    day = "2026-01-01 "
    put("one", [(1, day + "00:10:00", "a", 1.0), (1, day + "00:10:00", "a", 1.0), (2, day + "05:00:00", "a", 2.0)])
    state, ids = f"file://{tmp_path}/state", f"file://{tmp_path}/ids"
    first = {(str(r.window_start), r.n) for r in S.windowed(spark, f"{tmp_path}/in", state=state).collect()}
    assert first == {(day + "00:00:00", 2), (day + "05:00:00", 1)} and S.deduplicated(spark, f"{tmp_path}/in", state=ids).count() == 2
    put("two", [(3, day + "05:30:00", "a", 1.0), (4, day + "00:20:00", "a", 1.0), (2, day + "05:00:00", "a", 2.0)])
    second = {(str(r.window_start), r.n) for r in S.windowed(spark, f"{tmp_path}/in", state=state).collect()}
    assert second == {(day + "00:00:00", 2), (day + "05:00:00", 3)} and S.windowed.late == 1
    assert {(str(r.window_start), r.n) for r in S.windowed(spark, f"{tmp_path}/in", state=state).collect()} == second
