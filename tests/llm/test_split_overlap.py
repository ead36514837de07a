import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import split_overlap as S
from ledgerloom.llm.graph import connected_components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_segments_find_every_pair_within_k_edits(k):
    rng = random.Random(k)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(k + 1, 24)))
        b = a
        for _ in range(rng.randint(0, k)):
            p = rng.randrange(len(b) + 1)
            b = rng.choice([b[:p] + rng.choice("abc") + b[p:], b[:p] + b[p + 1 :], b[:p] + rng.choice("abc") + b[p + 1 :]])
        if len(b) <= k:
            continue
        d = distance(a, b)
        assert S.edits_within(a, b, k) == (d if d <= k else None)
        short, long = sorted((a, b), key=len)
        if d <= k:
            assert set(S.own_keys(short, k)) & S.looked_up_keys(long, k)


def test_other_invoices_of_the_same_parties_differ():
    assert S.same_invoice("r1234567", "20250101", None, "20250101") and S.same_invoice("r1234567", "20250101", "r134567", "20250101")
    assert not S.same_invoice("r1234567", "20250101", "r9999999", "20250101") and not S.same_invoice("r1234567", "20250101", None, "20250203")
    assert S.same_invoice("r1", "20250101", "r1", None) and not S.same_invoice(None, None, None, None)


def record(number="R-123456-789", date="2025-03-01", doc="d1", name="Some Firm Ltd", **more):
    line = {"quantity": "10", "unit_price": "2.50", "line_net_amount": "25.00", "description": "x"}
    other = {"quantity": "3", "unit_price": "7.10", "line_net_amount": "21.30", "description": "y"}
    base = {"document_id": doc, "supplier": {"display_name": name}, "invoice": {"number": number, "issue_date": date, "currency": "EUR"}, "totals": {"tax_exclusive_amount": "46.30", "total_tax_amount": "8.80", "payable_amount": "55.10"}, "line_items": [line, other]}
    return base | more


def pairs(spark, manifest, records):
    m = spark.createDataFrame([(i, s, h, g, f"f{i}", "k", "clash") for i, s, h, g in manifest], "manifest_id long, split string, sha256 string, ground_truth string, file string, kind string, component string")
    r = spark.createDataFrame([(g, t if t is None or isinstance(t, str) else json.dumps(t)) for g, t in records], "ground_truth string, record_json string")
    same = S.same_rows(m, r)
    return sorted(map(tuple, S.overlapping_pairs(same).collect())), same


def test_kinds_of_overlap_and_bridges(spark):
    swapped = record(doc="other")
    swapped["line_items"] = swapped["line_items"][::-1]
    records = [("a", record()), ("b", swapped), ("c", record(number=None, date="01.03.2025")), ("d", record(number="R-999999-111", date="2025-03-02")), ("e", record(name="Smoe Firm Ltd")), ("bad", "{"), ("n", None)]
    h = "AB" * 32
    manifest = [(1, "TRAIN", None, "./a"), (2, "test", None, "b"), (3, "val", None, "c"), (4, "dev", None, "d"), (5, "Test", None, "e"), (6, None, h, "a"), (7, "testing", "sha256:" + h.lower(), None), (8, "train", "nonsense", "bad"), (9, "test", "nonsense", "n"), (10, " ", None, "a"), (11, "test", None, None)]
    found, same = pairs(spark, manifest, records)
    assert found == [(1, 2), (1, 3), (1, 5), (1, 7)]
    report = {r["split"]: (r["n_rows"], r["n_in_training"]) for r in S.overlap_report(same).collect()}
    assert report["test"] == (4, 2) and report["dev"] == (1, 0)


def test_slips_in_number_and_date_together_and_beside_missing_ones(spark):
    cases = [
        (record(number="R-123456-798", date="2025-03-10"), True),  # number and date
        (record(number="R-123465-789", date=None), True),  # number, the date missing
        (record(number=None, date="2025-03-11"), True),  # date, the number missing
        (record(number="R-173456-789", name="Some Firn Ltd"), True),  # number and text
        (record(date="2025-03-10", name="Some Firn Ltd"), True),  # date and text
        (record(number="R-987654-321", date="2025-03-10"), False),
        (record(number=None, date="2025-07-22"), False),
        (record(number=None, date=None), False),
        (record(number="R-123456-789", date="2024-11-30"), False),
    ]
    for case, want in cases:
        found, _ = pairs(spark, [(1, "train", None, "a"), (2, "test", None, "b")], [("a", record()), ("b", case)])
        assert (found == [(1, 2)]) == want, case


def test_a_hot_component_loses_no_pair(spark):
    from ledgerloom.llm.blocking import crossed_pairs

    left, right = [("hot", i) for i in range(30)] + [("x", 1), (None, 2)], [("hot", 100 + i) for i in range(50)] + [("x", 7), ("y", 8)]
    frame = lambda rows: spark.createDataFrame(rows, "block string, id long")
    got = [tuple(r) for r in crossed_pairs(frame(left), frame(right), chunk=8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, 100 + j) for i in range(30) for j in range(50)} | {(1, 7)}


def test_repeats_and_empty_tables(spark):
    found, _ = pairs(spark, [(1, "train", "a" * 64, "x"), (2, "train", "a" * 64, "x"), (3, "test", "a" * 64, "y")], [])
    assert found == [(1, 3), (2, 3)]
    m = spark.createDataFrame([], "manifest_id long, split string, sha256 string, ground_truth string, file string, kind string")
    r = spark.createDataFrame([], "ground_truth string, record_json string")
    assert S.overlapping_pairs(S.same_rows(m, r)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 200)] + [(300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 200)}}


def test_p4_against_brute_force(spark, sf):
    from ledgerloom.session import read_table

    # sameness told anew: by a plain edit distance, with at most two slips in number and date each, one in a lone date
    texts = S.record_texts(read_table(spark, sf, "canonical_records")).collect()
    got = connected_components(S.near_links(spark.createDataFrame(texts)))
    group = {r.node: r.component for r in got.collect()}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            told = a.number and b.number
            dates = distance(a.date, b.date) if a.date and b.date else None
            if (distance(a.number, b.number) <= 1 and (dates or 0) <= 1 if told else dates is not None and dates <= 1) and abs(len(a.text) - len(b.text)) < 5 and distance(a.text, b.text) <= 4:
                assert group.get(a.path, a.path) == group.get(b.path, b.path)


def test_numbers_and_dates_in_one_notation(spark):
    df = spark.createDataFrame([("209.00", "2025/02/19"), ("209", "19.02.2025"), ("-0.50", "2025-02-19T00:00:00Z"), (None, None)], "n string, d string")
    out = df.select(S._number(F.col("n")).alias("n"), S._date(F.col("d")).alias("d")).collect()
    assert [r.n for r in out] == ["209", "209", "-0.5", None] and [r.d for r in out] == ["20250219"] * 3 + [None]


def met_by_brute_force(rows):
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if S.same_invoice(a[2], a[3], b[2], b[3]) and S.edits_within(a[1], b[1], S.allowed_edits(a[1], b[1], S.MAX_EDITS)) is not None}


@pytest.mark.parametrize("hot", [2, 256])
def test_slips_in_text_number_and_date_at_once_lose_no_pair(spark, hot):
    rng = random.Random(hot)

    def slip(t, most):
        for _ in range(rng.randint(0, most)):
            p = rng.randrange(len(t) + 1)
            t = rng.choice([t[:p] + rng.choice("x71") + t[p:], t[:p] + t[p + 1 :], t[:p] + rng.choice("x71") + t[p + 1 :], t[:p] + t[p : p + 2][::-1] + t[p + 2 :]])
        return t

    starts = [("somefirm|eur|46.3|8.8|55.1|10x2.5x25", "inv2024123", "20250301"), ("firmus|eur|1|2|3", "7", "20250302"), ("otherhouse|eur|46.3|8.8|55.1|10x2.5x25", "x" * 40 + "123", "20250401"), ("abcde", "inv77", "20250505"), ("somefirm|eur|46.3|8.8|55.1|9x2.5x22.5", None, "20250304")]
    rows = []
    for text, number, date in starts * 12:
        rows.append((len(rows), slip(text, 4) or "x", rng.choice([number and (slip(number, 2) or "7"), number, None]), rng.choice([slip(date, 2) or "2", date, None])))
    want = met_by_brute_force(rows)
    assert {len(t) for _, t, *_ in rows} & {4, 5} == {4, 5} and any(a != b and x != y and t != u for (i, j) in want for _, t, a, x in [rows[i]] for _, u, b, y in [rows[j]] if a and b and x and y)
    classes = spark.createDataFrame(rows, "n long, text string, number string, date string")
    got = [tuple(r) for r in S.met_records(classes, hot=hot).collect()]
    assert len(got) == len(set(got)) and want <= set(got)


def test_one_slip_each_in_text_number_and_date(spark):
    texts = [("a", "somefirmltd|eur|46.3|8.8|55.1|10x2.5x25", "r123456789", "20250301")]
    cases = [("somefirnltd|eur|46.3|8.8|55.1|10x2.5x25", "r123456798", "20250310"), ("somefirnltd|eur|46.3|8.8|55.1|10x2.5x25", "r123465789", None), ("somefirnltd|eur|46.3|8.8|55.1|10x2.5x25", None, "20250311")]
    for case in cases:
        assert [tuple(sorted(r)) for r in S.near_links(spark.createDataFrame([*texts, ("b", *case)], "path string, text string, number string, date string")).collect()] == [("a", "b")], case
    short = [("a", "abcd", "r1", "20250301"), ("b", "abcde", "r1", "20250301")]
    assert S.near_links(spark.createDataFrame(short, "path string, text string, number string, date string")).count() == 1


def test_keys_of_numbers_and_dates_are_shared_by_all_that_may_be_one(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("01") for _ in range(n))
    for _ in range(3000):
        n = rng.choice([3, 6, 22, 23, 24, 25, 26, 27, 40])
        a = some(n)
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(b))
            b[p : p + 2] = rng.choice([b[p : p + 2][::-1], b[p : p + 1], ["2", *b[p : p + 2]]])
        one, two = (rng.choice([a, None]), rng.choice(["20250301", "20250310", None])), (rng.choice(["".join(b), None]), rng.choice(["20250301", "20250310", "20250308", None]))
        if S.same_invoice(*one, *two):
            assert S.invoice_keys(*one, True) & S.invoice_keys(*two, False), (one, two)


def test_a_lone_record_takes_the_one_invoice_within_a_slip(spark):
    text = "somefirmltd|eur|46.3|8.8|55.1|10x2.5x25"
    linked = lambda rows: {frozenset(r) for r in map(tuple, S.near_links(spark.createDataFrame(rows, "path string, text string, number string, date string")).collect())}
    two, lone = [("a", text, "r123456789", "20250301"), ("b", text + "0", "r123456798", "20250301")], ("c", text, None, "20250311")
    assert linked([*two, lone]) == {frozenset("ab"), frozenset("ac"), frozenset("bc")}  # slips in the number: one invoice
    assert linked([*two[:1], lone, ("d", text + "0", None, "20250311")]) == {frozenset("ac"), frozenset("ad"), frozenset("cd")}
    assert linked([two[0], ("b", text, "r987654321", "20250313"), lone]) == set()  # two invoices: neither
