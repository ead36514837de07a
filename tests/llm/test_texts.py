import random

import pytest

from ledgerloom.llm import leakage as L
from ledgerloom.llm import packing as P
from ledgerloom.llm import reading as R

ITEM = "Falyonell of Zelnupryn booked EUR 8693.73 under code G37F. The supplier number for Norvegate has changed. Rosgramere and Holgramere split the freight at 644 to one. A ledger kept by Stacrekamp showed EUR 2423.37 against Dravavik; after 2025-01-06 the R97P rebate fell to 131 points."
WORDS = ITEM.split()


def found(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in L.leaked_items(d, e).collect())


def test_disguised_passages_are_found(spark):
    noisy = WORDS.copy()
    noisy[3], noisy[12], noisy[20] = "then", "nmuber", "this"
    docs = [
        "Before. " + ITEM + " After.",
        "x <b>" + "</b>\n<i>".join(WORDS[5:35]).upper() + "</i>",
        " ".join(noisy),
        " ".join(WORDS[:20]) + "\nEine ganz andere Zeile steht hier dazwischen.\n" + " ".join(WORDS[20:]),
        " ".join(WORDS[8:34]).replace("Norvegate", "NorvÃ©gate").replace(".", ""),
    ]
    assert [d for d, _ in found(spark, docs)] == list(range(len(docs)))


def test_quotations_patterns_and_shuffles_are_not(spark):
    shuffled = WORDS.copy()
    random.Random(3).shuffle(shuffled)
    other = ITEM
    for a, b in (("Falyonell", "Korwick"), ("Zelnupryn", "Halbury"), ("8693.73", "55.10"), ("G37F", "K11P"), ("Norvegate", "Torben"), ("Rosgramere", "Palwick"), ("Holgramere", "Drunell"), ("644", "12"), ("Stacrekamp", "Ulfmere"), ("2423.37", "9.99"), ("Dravavik", "Esk"), ("R97P", "Z00Z"), ("131", "7"), ("2025-01-06", "2024-12-31")):
        other = other.replace(a, b)
    assert found(spark, [" ".join(WORDS[:15]), " ".join(shuffled), other, None, "", "   ", "Question: which amount?"]) == []


def test_hot_items_repeats_empty_tables_and_long_texts(spark):
    docs = [f"n{i} " + ITEM for i in range(60)] + ["filler words without meaning " * 5000 + ITEM]
    assert found(spark, docs) == [(i, 1) for i in range(61)]
    assert found(spark, []) == [] and found(spark, [ITEM], [(1, None), (2, " "), (3, "too short")]) == []
    assert found(spark, [ITEM, ITEM], [(1, ITEM), (2, ITEM)]) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def item_of(text):
    words, share, cased = L.weighted_tokens(text)
    return L.Item(words, share, cased)


def test_two_pieces_around_an_omitted_middle():
    words = [f"Word{c}{d}x" for c in "abcdefgh" for d in "klmnopqrst"]
    item = item_of(" ".join(words))

    def held(*parts):
        text = L.tokens("Some text. " + " ".join(" ".join(p) for p in parts) + " More text.")
        return item.held(text, [p for p in range(2, len(text) - 4)]) is not None

    assert held(words[:25]) and held(words[55:]) and held(words[:25], words[55:])
    assert held(words[:26], words[-12:]) and held(words[:12], words[-26:])
    assert not held(words[:12], words[-12:]) and not held(words[:12], words[34:46], words[-12:])


PROSE = "we walked along the river until the light began to fade and the birds went quiet, then sat on a fallen tree and ate what was left of the bread while the dog slept beside us in the grass"
SENTENCES = "Please pay the amount within thirty days of the date of the letter. If the amount is not paid by then a reminder follows, and after two reminders the case goes to the office in charge of it."


def test_plain_prose_and_ordinary_sentences_are_found_alone_and_beside_others(spark):
    few = PROSE.split()
    few[7], few[19], few[27] = "moon", "log", "cheese"
    docs = ["before " + PROSE + " after", SENTENCES, PROSE.upper().replace(" ", "\n"), " ".join(few), " ".join(PROSE.split()[::-1]), " ".join(PROSE.split()[:16]), "nothing of the kind"]
    for items in ([(1, PROSE), (2, SENTENCES)], [(1, PROSE), (2, SENTENCES), (3, ITEM)], [(1, PROSE), (2, SENTENCES), (3, ITEM.lower()), (4, PROSE + " " + ITEM.lower())]):
        assert [x for x in found(spark, docs, items) if x[1] < 3] == [(0, 1), (1, 2), (2, 1), (3, 1)]


def test_an_item_does_not_depend_on_others_that_share_its_names(spark):
    other = "Falyonell and Zelnupryn met Norvegate, Rosgramere, Holgramere, Stacrekamp and Dravavik; none of them agreed to any of the terms that were put before the board in the spring of that year, falyonell zelnupryn norvegate rosgramere"
    alone = found(spark, [ITEM, "Well. " + ITEM, "other text"])
    assert alone == [(0, 1), (1, 1)] and found(spark, [ITEM, "Well. " + ITEM, "other text"], [(1, ITEM), (2, other)]) == alone


def test_a_bound_never_rejects_what_the_alignment_accepts():
    rng = random.Random(5)
    item = item_of(ITEM)
    for _ in range(60):
        words = L.tokens(ITEM)
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([["changed"], [words[at] + "x"], ["two", "words"], []])
        slipped = item.slipped(set(words))
        if item.score(item.align(words, slipped))[0]:
            assert item.possible({*words}.union(*slipped.values()))


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 3)])
def test_hilbert_neighbours_are_neighbours(bits, dims):
    import itertools

    cells = {P.hilbert_index(list(c), bits): c for c in itertools.product(range(1 << bits), repeat=dims)}
    assert sorted(cells) == list(range(1 << bits * dims))
    assert all(sum(abs(x - y) for x, y in zip(cells[i], cells[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def test_packing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["invoice", "amount", "due", "paid", "zzz", "Straße"]) for _ in range(int(rng.lognormvariate(4.5, 0.9)))) for _ in range(400)] + [None, "", " ", "word " * 5000, "same text", "same text"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = P.pack(df).collect()
    sizes = {r.doc_id: r.n_tokens for r in P.measured(df).collect()}
    held, spans, pieces = {}, {}, {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        spans.setdefault(r.container_id, []).append((r.position, r.position + r.n_tokens))
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(held.values()) <= P.CAPACITY and set(pieces) == {i for i, t in enumerate(texts) if t and t.strip()}
    for doc, parts in pieces.items():
        assert sum(n for _, n in parts) == sizes[doc] and (len(parts) == 1 or sizes[doc] > P.CAPACITY)
    assert all(a[1] <= b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:], strict=False))
    report = P.fill_report(P.pack(df)).first()
    assert report.fill > 0.9 and report.n_cut == 1
    assert P.pack(df.where("false")).count() == 0


def test_packer_is_best_fit_with_bounded_memory():
    packer = P.Packer(10, 2)
    assert [packer.put(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    assert len(packer.room) <= 2


EASY = "My boss came. The van is late. We pay the bill now. "
HARD = "The counterparty's certification of beneficial ownership necessitates comprehensive reassessment notwithstanding subsequent rectification, pending determination of the classification, irrespective of contractual stipulations. "


def test_reading_levels_recover_ratings(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        level = i % 5 + 1
        parts = [HARD if rng.random() < (level - 1) / 4 else EASY for _ in range(12)]
        docs.append((i, "".join(parts), "en", "mail", "clash"))
        if i % 2:
            labels.append((i, level, "r1"))
    docs += [(900, None, "en", "mail", ""), (901, " \n", None, "mail", ""), (902, "12 34", None, "mail", ""), (0, docs[0][1], "EN", "mail", "")]
    labels += [(1, None, "r2"), (12345, 3, "r2")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, doc_kind string, words string")
    lab = spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")
    got = R.reading_levels(d, lab).collect()
    assert len(got) == 301 and {r.doc_id for r in got} == set(range(300))
    held = [abs(r.reading_level - (r.doc_id % 5 + 1)) for r in got if r.doc_id % 2 == 0]
    assert sum(held) / len(held) < 0.6 and max(held) <= 2
    assert R.level_profile(R.reading_levels(d, lab), d).agg({"n_documents": "sum"}).first()[0] >= 301


def test_without_ratings_or_documents(spark):
    d = spark.createDataFrame([(1, "Der Preis ist hoch.", None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, reading_level int, rater string")
    row = R.reading_levels(d, lab).first()
    assert (row.lang, row.reading_level, row.score) == ("de", None, None)
    assert R.reading_levels(d.where("false"), lab).count() == 0


def test_coverage_against_brute_force(spark):
    from collections import Counter

    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghij", [2**-k for k in range(10)], k=rng.randint(1, 60))) for _ in range(40)]
    d = spark.createDataFrame([(i, "the " + t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    total = Counter(w for t in texts for w in ("the " + t).split())
    rank = {w: 1 + sum(n > total[w] for n in total.values()) for w in total}
    for r in R.coverage(R.measured(d)).collect():
        ranks = sorted(rank[w] for w in ("the " + texts[r.doc_id]).split())
        for share in R.SHARES:
            need = next(k for k in range(1, len(ranks) + 1) if k >= share * len(ranks) - 1e-12)
            assert r[f"cover_{round(100 * share)}"] == ranks[need - 1]


def test_neighbours_on_the_curve_are_alike_whatever_their_length_and_containers_are_stable(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    topics = [[word() for _ in range(60)] for _ in range(12)]
    common = [word() for _ in range(30)]
    topic = [rng.randrange(12) for _ in range(600)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.5 else topics[k]) for _ in range(rng.choice([20, 60, 400]))) for k in topic]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = P.pack(df).collect()
    boxes = {}
    for r in rows:
        boxes.setdefault(r.container_id, []).append(r.doc_id)
    pairs = [(a, b) for ids in boxes.values() for a, b in zip(ids, ids[1:], strict=False)]
    assert sum(topic[a] == topic[b] for a, b in pairs) / len(pairs) > 3 / 12
    again = P.pack(df.repartition(7, "text")).collect()
    key = lambda rs: sorted((r.container_id, r.position, r.doc_id) for r in rs)
    assert key(rows) == key(again)
