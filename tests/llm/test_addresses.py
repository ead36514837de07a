import numpy as np
import pytest

from ledgerloom.llm import addresses as A
from ledgerloom.llm.blocking import block_pairs


@pytest.mark.parametrize(
    "line, city, code, want",
    [
        ("18 Dunbawick St, 58433", "Gricrewick Falls", None, ("18", "dunbawick", "street", "58433")),
        ("Floor 7, No. 123 Paldrigate Drive", "X", "1", ("123", "paldrigate", "drive", "1")),
        ("Pº Fenfledorf, 176", "Lansilund", "237 79", ("176", "fenfledorf", "paseo", "23779")),
        ("Haus B, 23, Halkafeldplatz, D-55024", "Thipatorstadt", None, ("23", "halkafeld", "place", "55024")),
        ("Torsihurstg. 163", "Y", "F-12345", ("163", "torsihurst", "gasse", "12345")),
        ("Calzuwick-Platz 57", "Y", "17166-5364", ("57", "calzuwick", "place", "17166")),
        ("C/ Weswigate, 133, piso 2", "Y", "ln72 1rs", ("133", "weswigate", "calle", "ln721rs")),
        ("#71 Ostveyard Drv, U9W 4K0", "Z", "", ("71", "ostveyard", "drive", "u9w4k0")),
        ("97 Dunblawo0d Street", "Z", None, ("97", "dunblawood", "street", "")),
    ],
)
def test_parsing(line, city, code, want):
    p = A.parse_address(line, city, code, None)
    assert (p["number"], p["street"], p["kind"], p["postcode"]) == want


def test_town_in_the_line_moves_to_its_place():
    assert A.parse_address("44 Plaza Corvemere, Ivoclamark de la Sierra", None, "24493", None)["city"] == "ivoclamarkdelasierra"
    assert A.parse_address(None, None, None, None)["street"] == ""
    assert A.parse_address("x" * 10_000 + " Road 5", "y", None, None)["number"] == "5"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows, 1)], "address_id long, address_line_1 string, city string, subdivision string, postal_code string, country_code string, location string")


SAME = [("18 Dunbawick Street", "Gricrewick Falls", "Calmera", "58433", "US"), ("Dunbawick St 18, Floor 2", "Gricrewick", None, "58433", None), ("18 DUNBAWICK STREET, 58433", None, "Calmera", None, "US"), ("18 Dunbawikc Street", "Gricrewick Falls", "CM", "54833", "US")]
OTHER = [("20 Dunbawick Street", "Gricrewick Falls", "Calmera", "58433", "US"), ("18 Dunbawick Street", "Halkavik", "Wolden", "AB1 2CD", "GB"), ("18 Torgowick Lane", "Gricrewick Falls", "Calmera", "58433", "US")]


def filler(n):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(4)) for _ in range(2 * n)]
    out = []
    for i in range(n):
        code = str(20000 + 13 * i)
        out += [(f"{7 + i % 90} {words[i].title()} Road", words[n + i].title(), "Calmera", code, "US"), (f"{words[i].title()} Rd. {7 + i % 90}", words[n + i].title() if i % 3 else None, "Calmera", code, "US"), (f"{9 + i % 90} {words[i].title()} Road", words[n + i].title(), "Calmera", code, "US")]
    return out


def test_locations(spark):
    groups = {r.address_id: r.location for r in A.address_groups(table(spark, SAME + OTHER + filler(60))).collect()}
    assert {groups[i] for i in (1, 2, 3, 4)} == {1} and [groups[i] for i in (5, 6, 7)] == [5, 6, 7]
    first = [groups[8 + 3 * i] == groups[9 + 3 * i] != groups[10 + 3 * i] for i in range(60)]
    assert np.mean(first) > 0.95


LOST = [
    (("34 Velvcmark Street", "Halkavik", None, "GK7 2AW", "GB"), ("34 Velvemark Street", "Halkavik", None, None, "GB")),
    (("187 Tarnyogate Lane", "Zelflemouth", None, "FL2 0W3Z", "GB"), ("187 Tamyogate Lane", "Zelflemouth", None, "FL2 03WZ", "GB")),
    (("56 Thiiwen Weg", "Kordribacham", None, None, "DE"), ("56 Thifiwen Weg", None, None, "28412", "DE")),
    (("107 Ostnuped Road", "Varmirandabad", None, "617226", "IN"), ("107 Osrnuped Road", None, None, "612726", "IN")),
]


def test_a_slip_in_both_sound_keys_and_the_postcode(spark):
    rows = filler(60) + [r for pair in LOST for r in pair]
    groups = {r.address_id: r.location for r in A.address_groups(table(spark, rows)).collect()}
    first = len(rows) - 2 * len(LOST) + 1
    assert [groups[first + i] for i in range(2 * len(LOST))] == [first + i // 2 * 2 for i in range(2 * len(LOST))]
    before = {r.address_id: r.location for r in A.address_groups(table(spark, rows[: first - 1])).collect()}
    assert before == {i: v for i, v in groups.items() if i < first}


@pytest.mark.parametrize("a, b", LOST)
def test_block_keys_meet_though_sound_and_postcode_differ(a, b):
    x, y = (A.parse_address(r[0], r[1], r[3], r[2]) | {"country": r[4].lower()} for r in (a, b))
    assert A.may_match(A.compare(x, y)) and not A.alike_in_one(x, y)
    keys = lambda p: set(A.block_keys(*[p[f] for f in ("street", "kind", "city", "postcode", "country")]))
    assert x["number"] == y["number"] and keys(x) & keys(y)


def test_numbers_in_street_names_and_all_scripts(spark):
    line = lambda text: A.parse_address(text, "X", None, None)
    assert line("120 5th Avenue")["street"] != line("120 7th Avenue")["street"] and line("120 5th Avenue")["street"] == line("5th Ave 120")["street"]
    assert line("12, Calle 42")["street"] != line("12, Calle 43")["street"]
    rows = [
        ("120 5th Avenue", "Calmera", None, "58433", "US"), ("120 7th Avenue", "Calmera", None, "58433", "US"), ("120 5th Ave, Suite 3", "Calmera", None, "58433", "US"),
        ("ул. Ленина 14", "Москва", None, "101000", "RU"), ("14 ул Ленина", "Москва", None, "101000", "RU"), ("ул. Гагарина 14", "Москва", None, "101000", "RU"),
        ("東京通り 7", "大阪", None, "530001", "JP"), ("7 東京通り", "大阪", None, "530001", "JP"),
        ("12e Halkaweg", "Wolden", None, "20001", "DE"), ("Halkaweg 12e", "Wolden", None, "20001", "DE"), ("Halkaweg 12f", "Wolden", None, "20001", "DE"),
    ]
    got = {r.address_id: r.location for r in A.address_groups(table(spark, rows + filler(40))).collect()}
    assert [got[i] for i in range(1, 12)] == [1, 2, 1, 4, 4, 6, 7, 7, 9, 9, 11]


def test_one_street_name_in_many_towns_is_not_one_block(spark):
    rng = np.random.default_rng(3)
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    towns = ["".join(rng.choice(syllables, 5)).title() for _ in range(400)]
    keys = [set(A.block_keys("hauptstrasse", "", A._letters(A.plain(t)), str(10000 + 173 * i), "de")) for i, t in enumerate(towns)]
    shared = sum(bool(keys[i] & keys[j]) for i in range(400) for j in range(i))
    assert shared < 0.05 * 400 * 399 / 2


def test_identical_texts_without_number_and_missing_lines(spark):
    rows = [("Old Mill", "Town", None, None, None), ("OLD MILL", "town", None, None, "GB"), ("Old Mill", "Other", None, None, None), (None, "Town", None, None, None), ("  ", "Town", None, None, None)]
    got = {r.address_id: r.location for r in A.address_groups(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    pairs = A.group_pairs(A.address_groups(table(spark, rows))).collect()
    assert [tuple(p) for p in pairs] == [(1, 2)]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = table(spark, SAME[:1])
    again = df.unionByName(df).unionByName(df.selectExpr("cast(null as long) as address_id", *[c for c in df.columns if c != "address_id"]))
    assert [tuple(r) for r in A.address_groups(again).collect()] == [(1, 1)]
    assert A.address_groups(df.where("false")).count() == 0


def test_em_separates_patterns():
    patterns = [((2, 2, 1, 2, 2, 1, 1), 500), ((2, 1, 1, 2, 2, 1, 1), 200), ((2, 2, 1, 3, 1, 2, 1), 100), ((2, 0, 0, 0, 0, 0, 0), 300), ((0, 2, 0, 0, 0, 0, 0), 40), ((2, 0, 1, 0, 0, 2, 1), 100)]
    fit = A.fit_weights(patterns)
    assert [A.probability(p, *fit) > 0.9 for p, _ in patterns] == [True, True, True, False, False, False]


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_blocks_in_chunks_lose_no_pair(spark, chunk):
    members = [("hot", i) for i in range(40)] + [("b", 1), ("b", 50), ("c", 2), (None, 3)]
    got = {tuple(r) for r in block_pairs(spark.createDataFrame(members, "block string, id long"), chunk).collect()}
    assert got == {(i, j) for j in range(40) for i in range(j)} | {(1, 50)}
