import json

from ledgerloom.operators.nested import INVOICE, flatten_records, schema_of, visit


def tags(payload):
    return [(r[0], r[1], r[2]) for r in visit(payload if payload is None or isinstance(payload, str) else json.dumps(payload))]


def test_shapes_of_lists_give_the_same_rows():
    taxes = [{"tax_type": "A"}, {"tax_type": "B"}]
    lines = [{"line_id": 1, "tax_breakdowns": taxes}, None, {"line_id": "2"}]
    want = None
    for line_items in (lines, {"line": lines}, json.dumps(lines)):
        for of_line in (taxes, {"1": taxes[0], "2": taxes[1]}):
            if line_items is lines:
                lines[0]["tax_breakdowns"] = of_line
            got = tags({"document_id": "d", "line_items": line_items})
            want = want or got
            assert got == want
    assert tags({"document_id": "d", "line_items": None, "sections": [{"title": "A", "line_items": [lines[0]]}, {"title": "B", "line_items": [lines[2]]}]}) == want
    assert tags([{"approved": [{"document_id": "d", "line_items": lines}]}]) == want
    assert want == [("invoices", "1", None), ("lines", "1.1", "1"), ("taxes", "1.1.1", "1.1"), ("taxes", "1.1.2", "1.1"), ("lines", "1.2", "1")]


def test_single_objects_stand_for_lists():
    got = tags({"document_id": "d", "tax_breakdowns": {"tax_type": "A"}, "line_items": {"line_id": 1, "tax_breakdowns": {"rate": "3"}}})
    assert got == [("invoices", "1", None), ("taxes", "1.0.1", "1"), ("lines", "1.1", "1"), ("taxes", "1.1.1", "1.1")]


def test_unreadable_and_empty_payloads_are_rejects():
    for payload in (None, "", "  ", '{"document_id": "d"', "null", "[]", "3", '{"batch_id": "b", "approved": []}'):
        assert [t for t, _, _ in tags(payload)] == ["rejects"]


def test_deep_payloads_are_walked_or_rejected():
    record = json.dumps({"document_id": "d", "line_items": [{"line_id": 1}]})
    for depth in (900, 3000):
        assert tags('{"a":' * depth + record + "}" * depth) == tags("[" * depth + record + "]" * depth) == [("invoices", "1", None), ("lines", "1.1", "1")]
    assert [t for t, _, _ in tags("[" * 20_000 + record + "]" * 20_000)] == ["rejects"]
    deep_lines = '{"document_id": "d", "line_items": ' + '{"x":' * 3000 + '{"line_id": 1}' + "}" * 3001
    assert tags(deep_lines) == [("invoices", "1", None), ("lines", "1.1", "1")]


def test_unreadable_parts_are_rejects_and_the_rest_comes_out():
    rows = list(visit(json.dumps({"document_id": "d", "tax_breakdowns": '[{"tax_type": "V"', "line_items": [{"line_id": 1, "tax_breakdowns": '{"rate": '}, "[see below]"]})))
    assert [r[:3] for r in rows] == [("invoices", "1", None), ("rejects", "1.x1", "1"), ("lines", "1.1", "1"), ("rejects", "1.1.x1", "1.1")]
    assert json.loads(rows[1][4])["reason"] == "unreadable part"
    assert [r[:2] for r in visit(json.dumps([{"a": '[{"document_id": 1'}, {"document_id": "d"}]))] == [("invoices", "1"), ("rejects", "x1")]


def test_numbers_keep_their_text_and_strings_stand_for_objects():
    rows = list(visit('{"document_id": 7, "source": "ubl", "locale": {"applied_region_pack": "p1"}, "line_items": [{"line_id": 10, "quantity": 1.50}]}'))
    invoice, line = (json.loads(r[4]) for r in rows)
    assert (invoice["document_id"], invoice["source_family"], invoice["region_pack_id"]) == ("7", "ubl", "p1")
    assert (line["line_id"], line["quantity"]) == ("10", "1.50")


def test_tables_keep_parents_and_ignore_extra_columns(spark):
    payload = json.dumps({"document_id": "d", "line_items": [{"line_id": "l", "tax_breakdowns": [{"tax_type": "V"}]}]})
    rows = spark.createDataFrame([(1, payload, "x"), (1, payload, "x"), (None, payload, "x"), (2, "\ud83d", "x"), (3, None, "x")], "record_id long, payload string, tag string")
    out = {k: v.collect() for k, v in flatten_records(rows).items()}
    assert {k: len(v) for k, v in out.items()} == {"invoices": 3, "lines": 3, "taxes": 3, "rejects": 2}
    tax = out["taxes"][0]
    assert (tax["document_id"], tax["line_id"], tax["parent_key"], tax["positions"]) == ("d", "l", "1.1", [1, 1, 1])
    empty = flatten_records(rows.where("false"))
    assert all(df.count() == 0 for df in empty.values())
    assert {f.name for f in schema_of(INVOICE)["taxes"].fields} <= set(empty["taxes"].columns)


def test_p1_against_a_plain_walk(spark, sf):
    from ledgerloom.plans.data_quality import p1_found
    from ledgerloom.session import read_table

    want = set()
    for r in read_table(spark, sf, "approved_batch").collect():
        try:
            tree = json.loads(r.payload or "null")
        except ValueError:
            continue
        found = [tree]
        while found and not all(isinstance(x, dict) and "document_id" in x for x in found):
            found = [y for x in found for y in ((x.get("approved") or [x.get("approved_invoice")]) if isinstance(x, dict) and "document_id" not in x else x if isinstance(x, list) else [x]) if y]
            if found and not any(isinstance(x, (dict, list)) for x in found):
                found = []
        for doc in found:
            items = lambda v: [] if v is None else items(json.loads(v)) if isinstance(v, str) else [x for x in v if x is not None] if isinstance(v, list) else items(v["line"]) if "line" in v else list(v.values()) if "1" in v else [v]
            pack, source = (doc.get("locale") or {}).get("applied_region_pack"), doc.get("source")
            head = (r.record_id, doc["document_id"])
            tail = ((pack.get("id") if isinstance(pack, dict) else pack) or "", (source.get("family") if isinstance(source, dict) else source) or "")
            for k, t in enumerate(items(doc.get("tax_breakdowns")), 1):
                want.add((*head, 0, "", k, t.get("tax_type") or "", *tail))
            lines = items(doc.get("line_items")) + [x for s in doc.get("sections") or [] for x in items(s.get("line_items"))]
            for n, line in enumerate(lines, 1):
                line_id = "" if line.get("line_id") is None else str(line["line_id"])
                taxes = items(line.get("tax_breakdowns"))
                for k, t in enumerate(taxes, 1):
                    want.add((*head, n, line_id, k, t.get("tax_type") or "", *tail))
                if not taxes:
                    want.add((*head, n, line_id, 0, "", *tail))
    got = [tuple(r) for r in p1_found(spark, sf).collect()]
    assert set(got) == want and len(got) == len(set(got))
