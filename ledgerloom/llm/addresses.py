"""Address records that denote one location: blocking, component comparison and linkage weights by EM.

Every distinct address is parsed into house number, street, kind of street, town, postcode and subdivision; floors,
flats and buildings are set aside. Records meet if they share the digits of the house number and one of the keys of
`block_keys`, each of which names the street together with the town or the postcode, by sound or by an end, so that a slip in
one part meets by what is left and a block does not grow with the number of towns. The agreement levels of a pair
(with levels of their own for missing values) give a pattern; the patterns' counts over the pairs alike in a whole street's
sound or the postcode are what expectation-maximization estimates the linkage weights from, so only a table of at most
5,184 rows reaches the driver. All pairs are judged by these weights. Pairs above `MIN_PROBABILITY` whose number, street
and town do not contradict each other are linked; linked records form groups.

Results by case:
- records of identical text (line, town, postcode; case and accents aside) are one location, also without a house number;
- without a house number no other record is linked; a null line is no address; a null town or postcode is a level;
- letters of all scripts count; numbers in the name of a street (5th Avenue, Calle 42) must agree;
- parts in the wrong field (town or postcode in the line) are moved to theirs; the town named twice counts once;
- repeated rows of one address_id are collapsed first, its smallest texts taken if they differ; empty tables give none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.blocking import block_pairs
from ledgerloom.llm.graph import connected_components
from ledgerloom.session import lookup_join, store

MIN_PROBABILITY = 0.9
#: Weight, in pairs, of the starting values during estimation.
PRIOR = 20

# Words for kinds of streets, as typed and abbreviated in six countries.
STREET_KINDS = {
    "road": "road rd", "street": "street st str", "lane": "lane ln la", "drive": "drive dr drv",
    "avenue": "avenue ave av avenida avda avd", "boulevard": "boulevard boul bd blvd bvd", "rue": "rue r",
    "chemin": "chemin chem ch", "place": "place plaza platz pl pza plz", "calle": "calle c cl", "camino": "camino cno cam cmno",
    "paseo": "paseo pso po p", "strasse": "strasse", "weg": "weg", "gasse": "gasse", "allee": "allee", "court": "court ct", "square": "square sq", "way": "way",
}
_KIND = {word: kind for kind, words in STREET_KINDS.items() for word in words.split()}
_SUFFIXES = (("strasse", "strasse"), ("str", "strasse"), ("gasse", "gasse"), ("platz", "place"), ("allee", "allee"), ("weg", "weg"))
_SHORT_SUFFIXES = (("str", "strasse"), ("g", "gasse"), ("pl", "place"), ("w", "weg"), ("al", "allee"))
_UNIT = re.compile(
    r"^(?:(?:floor|fl|flat|unit|suite|ste|apt|apartment|room|rm|piso|planta|puerta|pta|local|oficina|etage|etg|stock|og|bureau|bur|appt|app|bat|batiment|building|bldg|block|blk|haus|hinterhaus|hinterhof|vorderhaus|wing|wohnung|whg|esc|escalier|izq|dcha|bajo|tower|level|lvl)\b.*"
    r"|\d+\s*(?:st|nd|rd|th|er|eme|e|o|a|\.)?\s*(?:floor|fl|og|etage|stock|piso|planta|izq|dcha|etg)\b.*|\d+\s*[oa]\s+(?:izq|dcha|a|b|c|d)\b.*)$"
)
_UNIT_WITHIN = re.compile(r"\b(?:floor|flat|unit|suite|apt|apartment|room|piso|etage|bureau|building|bat)\s+[\da-z]{1,3}\b|\bhinterhaus\b")
_NUMBER = re.compile(r"(?:\b(?:nr|no|num|numero|n)\b[\s.:]*|#\s*)?(?<![\w])(\d{1,5}(?:\s?(?:bis|ter)|[a-z])?(?:-\d{1,4})?)(?![\w])")
_POSTCODE = re.compile(r"^(?:[a-z]{1,2}-)?(?:\d{5}(?:-\d{4})?|\d{6}|\d{3} \d{2,3}|[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}|[a-z]\d[a-z]\s?\d[a-z]\d|(?=[a-z\d ]{6,8}$)(?=(?:.*\d){3})(?=(?:.*[a-z]){3})[a-z\d]+(?: [a-z\d]+)?|(?=[a-z\d ]{6,8}$)(?=(?:.*\d){2})(?=(?:.*[a-z]){4})[a-z\d]+ [a-z\d]+)$")
_LOOKALIKES = str.maketrans("015", "ols")


def plain(text: str | None) -> str:
    """Lower case ASCII, one blank between words."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("°", "o ").replace("º", "o ").replace("ª", "a "))
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c)).lower()).strip()


def _word(word: str) -> str:
    """Digits typed in place of letters inside a word are letters."""
    return word.translate(_LOOKALIKES) if sum(c.isalpha() for c in word) >= 3 else word


def _letters(text: str) -> str:
    """The letters of all scripts, words joined. Numbers stay where they are the name (5th Avenue, Calle 42), else they are none."""
    words = [_word(w) for w in re.findall(r"[^\W_]+", text)]
    numbered = [m.group(1) + "#" if (m := _ORDINAL.fullmatch(w)) else "".join(c for c in w if c.isalpha()) for w in words]
    return "".join(numbered) or "".join(f"{w}#" for w in words)


_ORDINAL = re.compile(r"(\d{1,3})(?:st|nd|rd|th|er|re|eme|ieme|e|o)")


def normal_postcode(text: str) -> str:
    code = re.sub(r"^[a-z]{1,2}-(?=\d)", "", text)
    code = re.sub(r"[^a-z0-9]", "", code)
    return code[:5] if re.fullmatch(r"\d{9}", code) else code


def _street(part: str) -> tuple[str, str, str]:
    """(core, kind, house number) of the part of a line that names the street."""
    part = re.sub(r"\bn o\b", "no", re.sub(r"\b[cp]\s*/\s*", lambda m: "calle " if m.group(0).startswith("c") else "paseo ", part))
    part = re.sub(r"\bp o (?=[a-z])", "paseo ", part)
    number = ""
    if found := list(_NUMBER.finditer(part)):
        # the number stands at one end of the part
        hit = found[0] if found[0].start() == 0 or len(found) == 1 else found[-1]
        number = re.sub(r"\s", "", hit.group(1))
        part = part[: hit.start()] + " " + part[hit.end() :]
    words = [w for w in re.findall(r"[^\W_]+\.?", part) if w not in ("nr.", "no.", "nr", "no", "n", "n.")]
    kind, rest = "", []
    for i, w in enumerate(words):
        bare = w.rstrip(".")
        if not kind and bare in _KIND and len(words) > 1 and (i in (0, len(words) - 1)):
            kind = _KIND[bare]
        else:
            rest.append(w)
    if not kind and rest:
        last = _word(rest[-1].rstrip("."))
        for suffix, name in _SHORT_SUFFIXES if rest[-1].endswith(".") else _SUFFIXES:
            if last.endswith(suffix) and len(last) > len(suffix) + 3:
                kind, rest[-1] = name, last[: -len(suffix)]
                break
    return _letters(" ".join(rest)), kind, number


def parse_address(line: str | None, city: str | None, postcode: str | None, subdivision: str | None) -> dict[str, str]:
    """The components of an address; an empty string is a missing one."""
    out = {"number": "", "street": "", "kind": "", "city": _letters(plain(city)), "postcode": normal_postcode(plain(postcode)), "subdivision": _letters(plain(subdivision))}
    rest: list[str] = []
    for part in (p.strip() for p in plain(line).split(",")):
        if not part or _UNIT.match(part):
            continue
        if _POSTCODE.match(part) and not (part.isdigit() and len(part) < 5) and part.split()[0] not in _KIND:
            out["postcode"] = out["postcode"] or normal_postcode(part)
        else:
            rest.append(_UNIT_WITHIN.sub(" ", part).strip())
    numbers = [p for p in rest if (m := _NUMBER.fullmatch(re.sub(r"^(?:n o|n\.o|no)\.?\s*", "no ", p))) and m]
    named = [p for p in rest if p and p not in numbers]
    if named:
        # the street is the part with a number or a word for a kind of street, else the first one
        scores = [bool(re.search(r"(?<!\w)\d", p)) * 2 + bool(_street(p)[1]) for p in named]
        at = scores.index(max(scores))
        out["street"], out["kind"], out["number"] = _street(named.pop(at))
    if numbers and out["number"] and out["street"] in _KIND:
        # nothing but a kind of street and a number is its name, where the house number stands apart
        out["kind"], out["street"], out["number"] = _KIND[out["street"]], f"{out['number']}#", ""
    if numbers and not out["number"]:
        out["number"] = re.sub(r"[^\da-z-]|^(?:nr|no|n)", "", re.sub(r"^(?:n o|nr|no|num|n)\b[\s.]*", "", numbers[0]))
    if named and not out["city"]:
        out["city"] = _letters(named[-1])
    return out


_CLASSES = str.maketrans("bfpvwcgjkqsxzdtlmnr", "AAAAABBBBBBBBCCDEEF")
_SILENT = frozenset("aeiouyh")


def street_sounds(street: str) -> list[str]:
    """Two keys: a code of consonant classes in order, and the sorted set of consonants (blind to swapped letters).

    Digits and letters of other scripts stand for themselves.
    """
    if not street:
        return []
    code, last = [], ""
    for c in street:
        x = "" if c in _SILENT else c.translate(_CLASSES)
        if x and x != last:
            code.append(x)
        last = x
    return ["o" + "".join(code), "s" + "".join(sorted(set(street) - _SILENT))]


def _ends(text: str) -> list[str]:
    """Its first three letters and its last three, each marked."""
    return ["<" + text[:3], text[-3:] + ">"]


def block_keys(street: str, kind: str, city: str, postcode: str, country: str) -> list[str]:
    """Keys of which records of one location share at least one, along with the digits of the house number.

    Each names the street (by its sounds, or by an end of it where a slip changes both sounds) together with the town (by an
    end of its sound, since names of towns come with and without appendix) or the postcode, so that a street name of
    every town is not one block. Records that lack the town or the postcode also meet by street, kind and country.
    """
    sounds = street_sounds(street)
    ends = _ends(street)
    keys = []
    if city:
        code = street_sounds(city)[0][1:]
        # short codes whole: towns of few consonants would all be alike
        towns = {"c" + code[:3], "d" + code[-3:]}
        keys += [f"{s}/{t}" for s in [*sounds, *ends] for t in towns]
    if postcode:
        keys += ["p" + postcode, "q" + "".join(sorted(postcode))]
        keys += [f"{s}/{t}" for s in [*sounds, *_ends(sounds[0][1:])] for t in ("<" + postcode[:2], postcode[-2:] + ">")]
    if not city or not postcode:
        keys += [f"{s}/{kind}/{country}" for s in [*sounds, *ends]]
    return keys


def alike_in_one(a: dict[str, str], b: dict[str, str]) -> bool:
    """Whether a pair has the postcode or a sound key of the whole street in common."""
    return bool(a["postcode"]) and a["postcode"] == b["postcode"] or any(x == y for x, y in zip(street_sounds(a["street"]), street_sounds(b["street"]), strict=False))


@lru_cache(maxsize=300_000)
def letter_bag(text: str) -> int:
    """The characters of a text as 64 bits: one for the first and one for the second time of a character (of 32 kinds).

    An edit changes two bits at most and a swap none, so texts whose bags differ in more than 2n bits differ by more than n.
    """
    bag = 0
    for c in text:
        bit = 1 << ord(c) % 32
        bag |= bit << 32 if bag & bit else bit
    return bag


def slips(a: str, b: str, most: int) -> int:
    """Edits, swaps of neighbours counting as one; more than `most` comes out as most + 1.

    Bit-parallel, a column of the table in one number (Hyyrö, A bit-vector algorithm for computing Levenshtein and Damerau
    edit distances, 2003).
    """
    n = len(a)
    if abs(n - len(b)) > most or (letter_bag(a) ^ letter_bag(b)).bit_count() > 2 * most:
        return most + 1
    if a == b or not n:
        return min(len(b), most + 1) if a != b else 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << n - 1
    up, down, diagonal, before, found = full, 0, 0, 0, n
    for y in b:
        here = places.get(y, 0)
        swap = (~diagonal & here) << 1 & before
        diagonal = ((here & up) + up ^ up | here | down | swap) & full
        right, left = down | full & ~(diagonal | up), diagonal & up
        found += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down, before = left | full & ~(diagonal | right), right & diagonal, here
    return min(found, most + 1)


def _text_level(a: str, b: str, most: int) -> int:
    """3 missing, 2 equal, 1 close, 0 different. Other numbers in a name are another name."""
    if not a or not b:
        return 3
    if a == b:
        return 2
    if _numbers(a) != _numbers(b):
        return 0
    return int(slips(a, b, min(most, max(len(a), len(b)) // 4)) <= min(most, max(len(a), len(b)) // 4))


def _numbers(text: str) -> list[str]:
    return re.findall(r"\d+#", text) if "#" in text else []


def house(number: str) -> str:
    """The digits that a house number begins with."""
    return re.match(r"\d*", number).group(0)


def _number_level(a: str, b: str) -> int:
    """3 missing, 2 equal, 1 one is a part of the other (12 and 12-14), 0 another house (12 and 12a too)."""
    if not a or not b:
        return 3
    if a == b:
        return 2
    x, y = (n.split("-") for n in (a, b))
    return int(x[0] == y[0] and (len(x) > 1) != (len(y) > 1))


def _city_level(a: str, b: str) -> int:
    """As texts; a town without its appendix (am See, les Bains, Springs) is close to the full name."""
    level = _text_level(a, b, 3)
    if level == 0:
        short, long = sorted((a, b), key=len)
        if len(short) > 4 and min(slips(short, long[:n], 1) for n in (len(short) - 1, len(short), len(short) + 1)) <= 1:
            return 1
    return level


def _subdivision_level(a: str, b: str) -> int:
    """Abbreviations keep some letters of the name in order."""
    if not a or not b:
        return 2
    short, long = sorted((a, b), key=len)
    it = iter(long)
    return int(short[0] == long[0] and all(c in it for c in short) or slips(a, b, 2) <= 2)


FIELDS = ("number", "street", "kind", "city", "postcode", "subdivision", "country")
#: Agreement levels of each field; the last is 'missing'.
LEVELS = {"number": 4, "street": 4, "kind": 3, "city": 4, "postcode": 4, "subdivision": 3, "country": 3}


def compare(a: dict[str, str], b: dict[str, str]) -> tuple[int, ...]:
    kind = 2 if not a["kind"] or not b["kind"] else int(a["kind"] == b["kind"])
    country = 2 if not a["country"] or not b["country"] else int(a["country"] == b["country"])
    return (_number_level(a["number"], b["number"]), _text_level(a["street"], b["street"], 3), kind, _city_level(a["city"], b["city"]), _text_level(a["postcode"], b["postcode"], 2), _subdivision_level(a["subdivision"], b["subdivision"]), country)


def fit_weights(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """(share of matches, m, u) by expectation-maximization over pattern counts; m and u are per field and level."""
    levels = [LEVELS[f] for f in FIELDS]
    x = np.array([p for p, _ in patterns], dtype=int).reshape(-1, len(FIELDS))
    n = np.array([c for _, c in patterns], dtype=float)
    # start: matches agree in nine of ten present values, other pairs in one of ten; missing values tell nothing
    agree = {4: ([0.05, 0.35, 0.5, 0.1], [0.8, 0.05, 0.05, 0.1]), 3: ([0.05, 0.75, 0.2], [0.5, 0.3, 0.2])}
    m = [np.array(agree[k][0]) for k in levels]
    u = [np.array(agree[k][1]) for k in levels]
    share = 0.5
    for _ in range(rounds):
        pm, pu = np.full(len(n), share), np.full(len(n), 1 - share)
        for f in range(len(levels)):
            pm, pu = pm * m[f][x[:, f]], pu * u[f][x[:, f]]
        g = pm / (pm + pu)
        new = float((g * n).sum() / n.sum())
        for f, k in enumerate(levels):
            # a prior of a few pairs at the start's values: rare levels and small tables do not run to extremes
            m[f] = (np.bincount(x[:, f], g * n, k) + PRIOR * np.array(agree[k][0])) / ((g * n).sum() + PRIOR)
            u[f] = (np.bincount(x[:, f], (1 - g) * n, k) + PRIOR * np.array(agree[k][1])) / (((1 - g) * n).sum() + PRIOR)
        if abs(new - share) < 1e-9:
            break
        share = min(max(new, 1e-6), 1 - 1e-6)
    return share, m, u


def probability(pattern: tuple[int, ...], share: float, m: list[np.ndarray], u: list[np.ndarray]) -> float:
    log = np.log(share / (1 - share)) + sum(np.log(m[f][v] / u[f][v]) for f, v in enumerate(pattern))
    return float(1 / (1 + np.exp(-log)))


def may_match(pattern: tuple[int, ...]) -> bool:
    """The exact check: a location is street, number and town. Another town needs the same postcode to be a slip."""
    number, street, kind, city, postcode, subdivision, country = pattern
    if number not in (1, 2) or street not in (1, 2) or city == 0 and (postcode != 2 or street != 2) or city == 3 and postcode == 0:
        return False
    # one names only the town, the other only the postcode: everything else must agree
    return not (city == 3 and postcode == 3) or kind == 1 and subdivision != 0 and country == 1


PARSED = "id long, number string, street string, kind string, city string, postcode string, subdivision string, country string"


def parsed_addresses(parties: DataFrame) -> DataFrame:
    """One parsed row per address_id, with `text`, the key of identical texts."""
    columns = ["address_line_1", "city", "postal_code", "subdivision"]
    one = parties.where("address_id is not null and trim(address_line_1) <> ''").groupBy(F.col("address_id").cast("long").alias("id"))
    one = one.agg(*[F.min(c).alias(c) for c in columns], F.max(F.upper(F.trim("country_code"))).alias("country"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, line, city, code, sub, country in batch[["id", *columns, "country"]].itertuples(index=False):
                p = parse_address(line, city, code, sub)
                rows.append((i, p["number"], p["street"], p["kind"], p["city"], p["postcode"], p["subdivision"], (country or "").lower(), "|".join(plain(x) for x in (line, city, code))))
            yield pd.DataFrame(rows, columns=["id", "number", "street", "kind", "city", "postcode", "subdivision", "country", "text"])

    return one.mapInPandas(run, PARSED + ", text string")


def address_links(parsed: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """(a, b) of address ids linked to one location; members of one class of equal components are chained to its first."""
    parts = ["number", "street", "kind", "city", "postcode", "subdivision", "country"]
    # copies are chained to the first of their class: by salted joins, since one text may be a third of all records
    shared = parsed.groupBy("text").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("text", "b")
    same_text = lookup_join(parsed.select("id", "text"), shared, ["text"], "id", "inner", small=False).select(F.col("id").alias("a"), "b")
    numbered = parsed.where("number <> '' and street <> ''")
    classes = store(numbered.groupBy(*parts).agg(F.min("id").alias("id")), "address-classes")
    copies = lookup_join(numbered.select("id", *parts), classes.withColumnRenamed("id", "b"), parts, "id", "inner", small=False).select(F.col("id").alias("a"), "b")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(number: pd.Series, *fields: pd.Series) -> pd.Series:
        return pd.Series([[f"{house(n)}/{k}" for k in block_keys(*f)] for n, *f in zip(number, *fields, strict=True)])

    # short numbers instead of the keys: two keys of one hash only add a pair to compare
    block = F.explode(F.array_distinct(keys("number", "street", "kind", "city", "postcode", "country")))
    pairs = block_pairs(classes.select(block.alias("block"), "id").select(F.xxhash64("block").alias("block"), "id").distinct())
    side = lambda s: classes.select(F.col("id").alias(s), F.struct(*parts).alias(f"p{s}"))

    @F.pandas_udf("pattern array<int>, basic boolean")
    def levels(pa: pd.DataFrame, pb: pd.DataFrame) -> pd.DataFrame:
        both = list(zip(pa.to_dict("records"), pb.to_dict("records"), strict=True))
        return pd.DataFrame({"pattern": [list(compare(x, y)) for x, y in both], "basic": [alike_in_one(x, y) for x, y in both]})

    compared = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", levels("pa", "pb").alias("levels"))
    compared = store(compared.select("a", "b", "levels.pattern", "levels.basic"), "address-pairs")
    counts = [(tuple(r["pattern"]), r["n"]) for r in compared.groupBy("pattern").agg(F.count_if("basic").alias("n")).collect()]  # at most 4*4*3*4*4*3*3 rows
    linked = []
    if counts:
        fit = fit_weights([c for c in counts if c[1]] or [(p, 1) for p, _ in counts])
        linked = [list(p) for p, _ in counts if may_match(p) and probability(p, *fit) >= min_probability]
    chosen = F.array(*[F.array(*[F.lit(v) for v in p]) for p in linked]) if linked else F.array().cast("array<array<int>>")
    found = compared.where(F.array_contains(chosen, F.col("pattern"))).select("a", "b")
    return found.unionByName(copies).unionByName(same_text).where("a <> b")


def address_groups(parties: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """(address_id, location) of every address record; `location` is the smallest address_id of its group."""
    parsed = store(parsed_addresses(parties), "addresses")
    components = connected_components(address_links(parsed, min_probability))
    out = parsed.select(F.col("id").alias("address_id")).join(components.withColumnRenamed("node", "address_id"), "address_id", "left")
    return out.select("address_id", F.coalesce("component", "address_id").alias("location"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of the records of each location, the smaller id first."""
    pairs = block_pairs(groups.select(F.col("location").alias("block"), F.col("address_id").alias("id")), distinct=False)
    return pairs.select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))
