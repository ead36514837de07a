"""Spellings of names of firms and people, linked by whom they name.

Each distinct spelling is parsed into a core (the distinctive words), a line of business or a first name, and what does
not tell apart (legal form, title, case, accents). Spellings of equal parts form a class. The padded q-grams of the
cores (padded with their own beginning, so that turned words keep them) are MinHashed and banded, with the number of bands taken from the collision curve; Monge-Elkan similarity and the
agreement of the other parts verify each candidate; star clustering groups the classes, the most complete and most
frequent spellings first, so that a short form joins one star only and never bridges two.

Results by case:
- null, blank and filler names ("N/A", "see attached") name nobody and are in no cluster;
- a spelling occurring once is a cluster of its own; repeated rows only weigh;
- ties between stars go to the higher weight, then the smaller key; empty tables give empty results;
- very long names are compared by their words like others; equal first words or surnames alone never link.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.addresses import letter_bag, slips
from ledgerloom.llm.blocking import block_pairs
from ledgerloom.session import store

Q = 3
ROWS_PER_BAND = 3
#: Jaccard similarity at which the bands must still find this share of pairs: about the lowest that the verifier accepts.
AIM_SIMILARITY = 0.35
AIM_RECALL = 0.95
MIN_SIMILARITY = 0.84

# Legal forms, titles, fillers, lines of business with their short forms, first names with pet forms.
LEGAL_FORMS = (
    "public limited company|private limited|pvt ltd|p ltd|sociedad anonima|sociedad limitada|aktiengesellschaft|gesellschaft mbh"
    "|gesellschaft mit beschrankter haftung|societe anonyme|limited liability company|incorporated|corporation|limited|company"
    "|ltd|ltee|limitee|inc|corp|llc|llp|lp|plc|gmbh|ag|kg|ug|sarl|sas|sasu|sa|sl|slu|bv|nv|co|pvt|mbh|s a r l|s a s|s a|s l|a g|l l p|l l c|p l c|g m b h|l t d"
)
TITLES = frozenset("mr mrs ms miss dr prof dipl ing herr frau mme mlle sr sra don dona ir".split())
FILLER = frozenset(
    ("", "na", "n a", "none", "null", "nil", "unknown", "see attached", "tbd", "to be confirmed", "same as above", "as above", "not available", "not applicable", "various", "test", "xxx", "see invoice", "customer", "supplier", "buyer", "name")
)
BUSINESSES = {
    "agricultural products": "agri prod|agricultural prod|agri products", "building supplies": "bldg supp|building supp|bldg supplies", "chemicals": "chem|chemical",
    "consulting": "cons", "electronics": "electr|electronic", "engineering": "eng|engg", "foods": "fds|food", "industries": "ind|inds", "international trading": "intl trdg|intl trading|international trdg",
    "laboratories": "labs|lab|laboratory", "logistics": "log", "manufacturing": "mfg|manuf", "metals": "met|metal", "office equipment": "off equip|office equip|off equipment", "packaging": "pkg|pack",
    "printing": "prtg", "services": "svcs|serv|svc", "technologies": "tech|technology|techn", "textiles": "text|textile", "transport": "transp|trans",
}
FIRST_NAMES = {
    "alexander": "alex sascha sandy", "andrew": "andy drew", "benedicte": "bene", "charles": "charlie chuck", "christopher": "chris kit", "dolores": "lola", "dorothy": "dot dottie dolly",
    "edward": "ted ed eddie ned", "elizabeth": "liz beth betty lizzie", "francisco": "paco pancho", "frederick": "fred freddie", "friedrich": "fritz", "guadalupe": "lupe", "heinrich": "heinz",
    "henry": "harry hank", "jennifer": "jenny jen", "johannes": "hannes", "jose": "pepe", "josephine": "josie jo", "katherine": "kate kathy katie", "margaret": "maggie peggy meg",
    "michael": "mike mick", "nikolaus": "klaus niko", "richard": "dick rick rich", "robert": "bob rob bobby", "susan": "sue susie", "theresa": "tess terry", "thomas": "tom tommy",
    "victoria": "vicky vicki", "william": "bill will billy", "james": "jim jimmy", "john": "jack johnny", "anna": "annie", "maria": "mia", "peter": "pete", "paul": "", "george": "", "david": "dave", "daniel": "dan",
}
_PET = {p: name for name, pets in FIRST_NAMES.items() for p in [name, *pets.split()]}
_BUSINESS = sorted(((form, b) for b, forms in BUSINESSES.items() for form in [b, *forms.split("|")]), key=lambda x: -len(x[0]))
_BUSINESS_RE = re.compile(r"\b(" + "|".join(re.escape(f).replace(r"\ ", r"\.?\s*") for f, _ in _BUSINESS) + r")\b\.?")
_LEGAL_RE = re.compile(r"(?:^|[\s,(])\(?(?:" + "|".join(re.escape(f).replace(r"\ ", r"[\s.)]*") for f in LEGAL_FORMS.split("|")) + r")\.?\)?(?=[\s,)]|$)")
_LOOKALIKES = str.maketrans("015", "ols")


#: A word is common, a trade or a first name rather than a part of one name, if it stands beside this share of the distinct
#: spellings' other words, at least `COMMON_LEAST`, of `COMMON_STARTS` beginnings (typos of one word begin alike).
COMMON_SHARE = 0.002
COMMON_LEAST = 8
COMMON_STARTS = 8


@dataclass(frozen=True)
class Learned:
    """Trades and first names learned from the names themselves, beside the listed ones."""

    trades: frozenset[str] = frozenset()
    firsts: frozenset[str] = frozenset()

    def trade_of(self, word: str) -> str | None:
        """The trade that a word is, with a slip or abbreviated; only if there is one such."""
        bare = word.rstrip(".")
        if bare in self.trades:
            return bare
        if word.endswith(".") and len(bare) > 2:
            like = [t for t in self.trades if t.startswith(bare)]
        else:
            like = [t for t in self.trades if len(bare) > 4 and abs(len(t) - len(bare)) < 2 and slips(bare, t, 1) <= 1]
        return like[0] if len(like) == 1 else None


NOTHING = Learned()


def _plain(name: str) -> str:
    text = unicodedata.normalize("NFKD", name.replace("ß", "ss"))
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c)).lower()).strip()


_BUSINESS_WORDS = sorted(b.split() for b in BUSINESSES)


def _slipped_business(words: list[str]) -> tuple[str, int, int] | None:
    """(business, from, to) of words that spell a line of business with one slip in a word."""
    for want in _BUSINESS_WORDS:
        n = len(want)
        for i in range(len(words) - n + 1):
            here = words[i : i + n]
            if len(words) > n and all(len(w) >= 4 and slips(w.rstrip("."), x, 1) <= 1 for w, x in zip(here, want, strict=True)):
                return " ".join(want), i, i + n
    return None


def parse_name(name: str | None, learned: Learned = NOTHING) -> tuple[str, str, str, str] | None:
    """(kind, core words, line of business or first name, initials) or None for filler.

    kind: firm or person. An abbreviated core word keeps its full stop. A person known by an initial only has an empty
    first name; `initials` are the letters that an initial of this first name can be.
    """
    text = _plain(name or "")
    if not re.search(r"[^\W\d_]", text) or re.sub(r"[\W\d_]", " ", text).strip() in FILLER or re.sub(r"[\W\d_]", "", text) in FILLER:
        return None
    text = re.sub(r"\w{4,}", lambda m: m.group(0).translate(_LOOKALIKES) if not m.group(0).isdigit() else m.group(0), text)
    body = re.sub(r"\bdipl\.?-?\s*ing\.?", " ", text)
    stripped = _LEGAL_RE.sub(" ", body)
    legal = stripped != body
    business = ""
    hits = list(_BUSINESS_RE.finditer(stripped))
    if hits:
        # a word for the business stands behind or before the core, never alone
        hit = hits[-1]
        rest = stripped[: hit.start()] + " " + stripped[hit.end() :]
        if re.search(r"[^\W\d_]{3}", rest):
            form = re.sub(r"[^a-z]+", " ", hit.group(1)).strip()
            squeezed = form.replace(" ", "")
            business = next(b for f, b in _BUSINESS if f.replace(" ", "") == squeezed)
            stripped = rest
    words = [w for w in re.findall(r"[^\W\d_]+\.?", re.sub(r"[&+/]|\band\b|\bund\b|\bet\b|\by\b", " ", stripped)) if w.rstrip(".") not in TITLES]
    if legal and not business and (found := _slipped_business(words)) or not business and len(words) > 2 and (found := _slipped_business(words)):
        business = found[0]
        words = words[: found[1]] + words[found[2] :]
    if not business and learned.trades and len(words) > 1:
        for at in (len(words) - 1, 0):
            if trade := learned.trade_of(words[at]):
                business, words = trade, words[:at] + words[at + 1 :]
                break
    if not words:
        return ("firm", business, business, "") if business else None
    if not (legal or business):
        singles = [w for w in words if len(w.rstrip(".")) == 1]
        rest = [w for w in words if len(w.rstrip(".")) > 1]
        firsts = [i for i in ([0, len(rest) - 1] if len(rest) > 1 else []) if rest[i].rstrip(".") in _PET or rest[i] in learned.firsts]
        if not firsts and len(rest) > 2:
            firsts = [i for i in (0, len(rest) - 1) if len(rest[i]) > 4 and any(slips(rest[i], n, 1) <= 1 for n in FIRST_NAMES)]
        if firsts:
            raw = rest.pop(firsts[0]).rstrip(".")
            full = _PET.get(raw) or (raw if raw in learned.firsts else next(n for n in FIRST_NAMES if slips(raw, n, 1) <= 1))
            return ("person", " ".join(rest), full, "".join(sorted({raw[0], full[0], *(p[0] for p in FIRST_NAMES.get(full, "").split())})))
        if singles and rest:
            return ("person", " ".join(rest), "", singles[0][0])
        words = rest or words
    return ("firm", " ".join(words), business, "")


def complete(kind: str, core: str, trait: str) -> bool:
    """Whether a spelling tells its whole name: no abbreviated word, with business or first name."""
    return bool(trait) and "." not in core


@lru_cache(maxsize=300_000)
def _likeness(a: str, b: str) -> float:
    if a.endswith(".") or b.endswith("."):
        short, long = sorted((a.rstrip("."), b.rstrip(".")), key=len)
        if len(short) >= 2 and long.startswith(short):
            return 0.95
        if len(short) >= 4 and slips(short, long[: len(short)], 1) <= 1:
            return 0.85
        a, b = a.rstrip("."), b.rstrip(".")
    most = max(len(a), len(b)) // 3
    n = slips(a, b, most)
    return 0.0 if n > most else 1 - n / max(len(a), len(b))


def monge_elkan(a: list[str], b: list[str], least: float = 0.7) -> float:
    """Mean of the best likeness of each word, the lower of both directions; 0 if a word has no like."""
    table, rows = [], []
    for x in a:
        row = [_likeness(x, y) for y in b]
        if max(row) < least:
            return 0.0
        table.append(row)
        rows.append(max(row))
    columns = [max(c) for c in zip(*table, strict=True)]
    if min(columns) < least:
        return 0.0
    return min(sum(rows) / len(rows), sum(columns) / len(columns))


def core_similarity(a: str, b: str, least: float = 0.0) -> float:
    """Monge-Elkan of the words, or likeness of the words written as one, in either order: split and joined words.

    What is below `least` may come out lower: the words written as one are then compared with no more edits than it allows.
    """
    x, y = a.split(), b.split()
    best = monge_elkan(x, y)
    if best < 1:
        joined = "".join(x).replace(".", "")
        whole = "".join(y).replace(".", "")
        longest = max(len(joined), len(whole))
        most = min(longest // 3, int((1 - least) * longest + 1e-9))
        # the letters in any order come first: most pairs are too far apart in all
        if abs(len(joined) - len(whole)) <= most and (letter_bag(joined) ^ letter_bag(whole)).bit_count() <= 2 * most:
            orders = [(joined, whole), *((joined, o) for o in _turned(y))]
            if len(x) > len(y) == 1:
                orders += [(o, whole) for o in _turned(x)]
            fewest = min(slips(one, other, most) for one, other in orders)
            best = max(best, 1 - fewest / longest if fewest <= most else 0.0)
        if "." in a or "." in b:  # an abbreviated first word, the rest joined to it or split
            best = max(best, _abbreviated(x, y), _abbreviated(y, x))
    return best


def _turned(words: list[str]) -> list[str]:
    """Two to four words written as one, each but the first in front once."""
    return ["".join(words[i:] + words[:i]).replace(".", "") for i in range(1, len(words))] if 1 < len(words) < 5 else []


def _abbreviated(x: list[str], y: list[str]) -> float:
    """x with one abbreviated word against the letters of y."""
    whole = "".join(y).replace(".", "")
    for i, w in enumerate(x):
        before, after = "".join(x[:i]), "".join(x[i + 1 :]).replace(".", "")
        if w.endswith(".") and len(before) + len(w) > 4:
            if len(after) > 3 and whole.startswith(before + w[:-1]) and len(whole) > len(after):
                return 0.95 * _likeness(whole[-len(after) :], after)
    return 0.0


def same_name(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> bool:
    """Whether two parsed names may be one: the traits do not contradict each other and the cores are alike."""
    if a[0] != b[0]:
        return False
    if a[0] == "firm":
        if a[2] and b[2] and a[2] != b[2]:
            return False
    elif a[2] and b[2]:
        if a[2] != b[2]:
            return False
    elif not set(a[3]) & set(b[3]):
        return False
    return core_similarity(a[1], b[1], MIN_SIMILARITY) >= MIN_SIMILARITY


def bands_for(similarity: float = AIM_SIMILARITY, rows: int = ROWS_PER_BAND, recall: float = AIM_RECALL) -> int:
    """Bands of `rows` hashes that collide for pairs of this similarity with this probability: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


_LETTERS = re.compile(r"[\W\d_]+")


def core_bag(core: str) -> int:
    """The letters of a core as signed 64 bits: the bits in which two differ are at most the letters by which the cores
    differ, in whatever order."""
    bag = letter_bag(_LETTERS.sub("", core))
    return bag - (1 << 64) if bag >> 63 else bag


#: Share of letters by which cores that the verifier accepts can differ at most: its mean likeness leaves 0.16 of the
#: letters to edits of two letters each, and somewhat more where long words differ and short ones do not; an abbreviated
#: core may lack any letters of the other, but has few that the other lacks.
MAX_APART = 0.4
MAX_LACKING = 0.3


def _band_keys(cores: list[str], bands: int, rows: int) -> list[list[int]]:
    rng = np.random.default_rng(20240229)
    odd = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    mix = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
    out = []
    for core in cores:
        text = _LETTERS.sub("", core) or "^"
        # padded with its own beginning: turned words keep all q-grams, joined and split ones too
        text += (text * Q)[: Q - 1]
        grams = np.array(sorted({(ord(text[i]) << 42) + (ord(text[i + 1]) << 21) + ord(text[i + 2]) for i in range(len(text) - Q + 1)}), dtype=np.uint64)
        mixed = _scramble(grams)
        low = _scramble(mixed[:, None] * odd[None, :]).min(axis=0).reshape(bands, rows)
        key = _scramble((low * mix[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
        out.append(key.view(np.int64).tolist())
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit mixing function; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PARSED = "name string, weight long, kind string, core string, trait string, initials string"


_KNOWN_WORDS = frozenset(w for f in LEGAL_FORMS.split("|") for w in f.split()) | TITLES | frozenset(_PET) | frozenset(w for f, _ in _BUSINESS for w in f.split())


def learn(spellings: DataFrame) -> Learned:
    """Common words of distinct spellings (name) that the lists lack, by where they stand: trades beside legal forms and
    last, first names first in names without one. There are at most a few per `COMMON_SHARE`, whatever the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                text = _plain(name)
                stripped = _LEGAL_RE.sub(" ", text)
                legal = stripped != text
                words = [w for w in re.findall(r"[^\W\d_]{3,}", stripped) if w not in TITLES]
                for i, w in enumerate(words):
                    near = words[i + 1] if i + 1 < len(words) else words[i - 1]
                    if w not in _KNOWN_WORDS and len(words) > 1:
                        rows.append((w, near, legal and i == len(words) - 1, not legal and i == 0))
            yield pd.DataFrame(rows, columns=["word", "near", "last", "first"])

    n = spellings.count()
    met = spellings.select("name").mapInPandas(run, "word string, near string, last boolean, first boolean")
    # two partial aggregates: no word's neighbours are gathered anywhere
    pairs = met.groupBy("word", "near").agg(F.count(F.lit(1)).alias("n"), F.count_if("last").alias("last"), F.count_if("first").alias("first"))
    words = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("near"), F.sum("n").alias("n"), F.sum("last").alias("last"), F.sum("first").alias("first"))
    common = words.where((F.col("near") >= COMMON_LEAST) & (F.col("near") >= COMMON_SHARE * n))
    starts = pairs.join(common.select("word"), "word").select("word", F.substring("near", 1, 2).alias("s")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("starts"))
    found = common.join(starts.where(F.col("starts") >= COMMON_STARTS), "word").collect()
    return Learned(frozenset(r["word"] for r in found if r["last"] > 0.3 * r["n"]), frozenset(r["word"] for r in found if r["first"] > 0.5 * r["n"]))


def parsed_names(sources: list[DataFrame]) -> DataFrame:
    """The distinct spellings of one-column tables, parsed, with their number of rows. Filler is left out."""
    rows = None
    for s in sources:
        one = s.toDF("name").where("name is not null")
        rows = one if rows is None else rows.unionByName(one)
    counted = store(rows.groupBy("name").agg(F.count(F.lit(1)).alias("weight")), "spellings")
    learned = learn(counted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(n, w, *p) for n, w in batch[["name", "weight"]].itertuples(index=False) if (p := parse_name(n, learned)) is not None]
            yield pd.DataFrame(found, columns=["name", "weight", "kind", "core", "trait", "initials"])

    return counted.repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name").mapInPandas(run, PARSED)


def name_links(classes: DataFrame) -> DataFrame:
    """(a, b), each unordered pair once, of ids of classes (id, kind, core, trait, initials) that may name the same."""
    bands = bands_for()

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(core: pd.Series) -> pd.Series:
        return pd.Series(_band_keys(core.tolist(), bands, ROWS_PER_BAND))

    @F.pandas_udf(T.LongType())
    def bag(core: pd.Series) -> pd.Series:
        return pd.Series([core_bag(c) for c in core], dtype="int64")

    # cores meet once, whatever trades or first names they occur with; those of firms and of people never meet
    numbered = classes.select("kind", "core").distinct().select(F.monotonically_increasing_id().alias("n"), "kind", "core")
    numbered = numbered.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n")
    cores = store(numbered.withColumns({"bag": bag("core"), "size": F.length(F.regexp_replace("core", r"[^\p{L}]", "")), "keys": keys("core")}), "name-cores")
    # pairs that merely share syllables fall here, before Python, by a bound that loses none: letters in any order
    a, b = F.col("bag_a"), F.col("bag_b")
    lacking = F.least(F.bit_count(a.bitwiseAND(F.bitwise_not(b))), F.bit_count(b.bitwiseAND(F.bitwise_not(a))))
    near = F.when(F.col("short_a") | F.col("short_b"), lacking <= MAX_LACKING * F.least("size_a", "size_b")).otherwise(F.bit_count(a.bitwiseXOR(b)) <= MAX_APART * F.greatest("size_a", "size_b"))
    carried = ("bag", "size", "short")
    met = block_pairs(cores.withColumn("short", F.col("core").contains(".")).select(F.explode("keys").alias("key"), "kind", F.col("n").alias("id"), *carried).select(F.xxhash64("key", "kind").alias("block"), "id", *carried), carry=carried, keep=near)
    core = lambda s: cores.select(*[F.col(c).alias(f"{c}_{s}") for c in ("n", "kind", "core")])

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([core_similarity(x, y, MIN_SIMILARITY) >= MIN_SIMILARITY for x, y in zip(a, b, strict=True)], dtype=bool)

    pairs = met.toDF("n_a", "n_b").join(core("a"), "n_a").join(core("b"), "n_b").where("kind_a = kind_b")
    pairs = store(pairs.where(alike("core_a", "core_b")).select(F.col("kind_a").alias("kind"), "core_a", "core_b"), "core-links")
    like = pairs.unionByName(cores.select("kind", F.col("core").alias("core_a"), F.col("core").alias("core_b")))
    side = lambda s: classes.select("kind", F.col("core").alias(f"core_{s}"), F.col("id").alias(s), F.col("trait").alias(f"trait_{s}"), F.col("initials").alias(f"initials_{s}"))
    full = like.join(side("a"), ["kind", "core_a"]).join(side("b"), ["kind", "core_b"])
    full = full.where("core_a <> core_b or a < b")
    agree = F.when((F.col("trait_a") != "") & (F.col("trait_b") != ""), F.col("trait_a") == F.col("trait_b")).when(F.col("kind") == "firm", F.lit(True))
    return full.where(agree.otherwise(F.arrays_overlap(F.split("initials_a", ""), F.split("initials_b", "")))).select("a", "b")


def star_clusters(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, star) by star clustering: in order of rank, each node not yet in a star becomes one with its free neighbours.

    `nodes` has id and rank (orderable, unique); `links` has a and b. Run in rounds: a free node whose rank is above
    those of all its free neighbours becomes a centre, which gives the same stars as one node after the other. A
    satellite next to several centres of one round joins the one of the highest rank.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = both.join(nodes.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(nodes.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    free = store(ranked.select("a", "ra", "b", "rb"), "star-links")
    parts: list[DataFrame] = []
    for _ in range(max_rounds):
        if free.isEmpty():
            break
        centres = store(free.groupBy("a").agg(F.first("ra").alias("ra"), F.max("rb").alias("most")).where("ra > most").select(F.col("a").alias("c"), F.col("ra").alias("rc")), "star-centres")
        satellites = free.join(centres.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.max_by("b", "rb").alias("star"))
        taken = store(satellites.select(F.col("a").alias("id"), "star").unionByName(centres.select(F.col("c").alias("id"), F.col("c").alias("star"))), "stars")
        parts.append(taken)
        gone = taken.select("id")
        free = store(free.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "star-links")
    else:
        raise RuntimeError("stars not settled")
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    alone = nodes.select("id")
    if found is None:
        return alone.withColumn("star", F.col("id"))
    return alone.join(found, "id", "left").select("id", F.coalesce("star", "id").alias("star"))


def name_clusters(sources: list[DataFrame]) -> DataFrame:
    """(name, weight, cluster) of every spelling that names someone."""
    parsed = store(parsed_names(sources), "names")
    parts = ["kind", "core", "trait", "initials"]
    classes = parsed.groupBy(*parts).agg(F.sum("weight").alias("weight"), F.min("name").alias("first"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "name-classes")
    whole = (F.col("trait") != "") & ~F.col("core").contains(".")
    nodes = classes.select("id", F.struct(whole.alias("whole"), "weight", F.col("first").alias("key")).alias("rank"))
    stars = star_clusters(nodes, store(name_links(classes), "name-links"))
    joined = parsed.join(classes.select(*parts, "id"), parts).join(stars, "id")
    return joined.select("name", F.col("weight"), F.col("star").alias("cluster"))


def name_pairs(clusters: DataFrame) -> DataFrame:
    """Pairs of different spellings of one cluster, ordered by code point."""
    pairs = block_pairs(clusters.select(F.col("cluster").alias("block"), F.col("name").alias("id")), distinct=False)
    return pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))
