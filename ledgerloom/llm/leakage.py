"""Held-out passages inside training documents: rare n-gram seeds and Smith-Waterman alignment.

Documents are tokenised once. Their word n-grams that some item has too are kept with their positions and counted over all
documents. Seeds are an item's rare n-grams and, so that every stretch of it has one however often it leaked, the
rarest n-gram of each `COVER` positions; documents and items meet in a join on seeds. Where enough n-grams of the item lie
around the seeds of a document, a local alignment of words with affine gaps scores the place. A document holds the passage
if the alignment spans at least `MIN_WORDS` words of the item, most of them and most of its names, codes and amounts
matched. An alignment that bridges an omitted stretch and fails is cut there and its pieces tested; then the text before
and after it is aligned.

What counts as rare is a share of the documents, so a corpus of any size is treated alike, and depends on no other item.
The n-grams of the items go to the tasks as numbers, in blocks of at most `GRAM_BLOCK`; items and seeds are broadcast only
where they are few, else joined by a salted shuffle.

Results by case:
- null and blank texts and items hold and are nothing; items under `MIN_WORDS` words cannot be held;
- case, accents, mojibake, markup, punctuation and line breaks do not matter; a word with one slip matches;
- plain prose without names or codes is found like any other: then only the words count;
- repeated documents each get their rows; repeated items too; an item comes once per document however often it is held;
- very long documents cost their words once plus the windows around seeds; empty tables give no rows.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import slips
from ledgerloom.session import is_small, lookup_join, store

N = 3
#: An n-gram in at most this share of the documents, or in one only, is rare.
RARE_SHARE = 0.0005
#: A capitalised word in at most this share of the documents, or in one only, is a name.
NAME_SHARE = 0.01
COVER = 10
#: Items that are broadcast; more are joined by a shuffle.
ITEMS_BROADCAST = 2000
#: n-grams of items that a task looks up at once: 8 bytes each.
GRAM_BLOCK = 2_000_000
MIN_WORDS = 25
#: Words that must match of the span of the alignment, and of its names, codes and amounts.
MIN_MATCHED = 0.7
MIN_MARKED = 0.6
#: Alignment scores of a word: equal, with a slip, another; names, codes and amounts weigh more, so that sentences of
#: one pattern with other names score below zero. Then opening a gap and each word of it.
MATCH, CLOSE, MISMATCH, MARKED, GAP, EXTEND = 1.0, 0.6, -1.0, 3.0, -2.0, -0.25
#: Longest stretch between two seeds of one window, and the words of the item that shared n-grams must cover in a window
#: to make it worth aligning: 25 words with six of them changed still have 15 in such n-grams.
REACH = 40
MIN_COVERED = 10
#: Unmatched words of the item in a row at which an alignment that fails is cut.
LONG_GAP = 8

_TAG = re.compile(r"<[^<>]*>")
_BROKEN = re.compile(r"[Â-ô][\u0080-¿Œœ-Ÿƒˆ˜–-™]{1,3}")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯­​]+")
_TOKEN = re.compile(r"[^\W_]+")


def _repair(m: re.Match[str]) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group(0).encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return m.group(0)


def repaired(text: str) -> str:
    """The text without markup and mojibake."""
    text = _TAG.sub(" ", html.unescape(text) if "&" in text else text) if "<" in text or "&" in text else text
    return text if text.isascii() else _BROKEN.sub(_repair, text)


def _bare(text: str) -> str:
    """Without accents and marks within words."""
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text.replace("ß", "ss")))


def clean(text: str) -> str:
    """Lower case without markup, mojibake and accents."""
    return _bare(repaired(text)).lower()


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(clean(text)) if text else []


def weighted_tokens(text: str) -> tuple[list[str], list[float], list[bool]]:
    """Tokens, the share of a word that each is (an amount of two tokens is one word), and whether it may be a name.

    A word may be a name if it has a capital or no case, and occurs nowhere in the text in lower case; with digits it is a
    code or an amount in any case.
    """
    out, share, cased = [], [], []
    for word in _bare(repaired(text)).split():
        parts = _TOKEN.findall(word)
        out += [p.lower() for p in parts]
        share += [1 / len(parts)] * len(parts)
        cased += [not p[0].islower() for p in parts]
    small = {w for w, c in zip(out, cased, strict=True) if not c}
    return out, share, [w not in small for w in out]


def word_codes(words: list[str]) -> np.ndarray:
    return np.fromiter((_code(w) for w in words), dtype=np.uint64, count=len(words))


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_codes(words: np.ndarray) -> np.ndarray:
    """A 64-bit code for each n-gram of words given as codes; wraps around."""
    n = len(words) - N + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(N):
        out = (out + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Item:
    """An item as the alignment needs it."""

    def __init__(self, words: list[str], share: list[float], marked: list[bool]) -> None:
        self.words, self.marked = words, marked
        self.share = np.array(share)
        self.grams: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for p in range(len(words) - N + 1):
            self.grams[tuple(words[p : p + N])].append(p)
        self.number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        self.codes = np.array([self.number[w] for w in words])
        #: words of four letters or more without digits, by themselves with any one letter left out
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.number:
            if len(w) > 3 and not any(c.isdigit() for c in w):
                for form in _shortened(w):
                    self.near[form].append(w)
        #: words that one with a slip may stand for
        self.slippery = {w for forms in self.near.values() for w in forms}
        n = len(words)
        before = np.concatenate([[0.0], np.cumsum(self.share)])
        self.spans = np.round(before[None, :] - before[:, None], 9)
        marks = np.concatenate([[0], np.cumsum(marked)])
        self.marks = marks[None, :] - marks[:, None]
        self.long = (self.spans >= MIN_WORDS - 0.5) & (np.arange(n + 1)[None, :] > np.arange(n + 1)[:, None])

    def slipped(self, words: set[str]) -> dict[str, list[str]]:
        """Words that the item lacks, with those of the item that they are but for one slip."""
        out = {}
        for w in words:
            if w not in self.number and len(w) > 3:
                like = {x for form in _shortened(w) for x in self.near.get(form, ()) if slips(w, x, 1) <= 1}
                if like:
                    out[w] = sorted(like)
        return out

    def possible(self, there: set[str]) -> bool:
        """Whether some stretch has enough words, and enough names, codes and amounts, among these in any order."""
        hit = np.array([w in there for w in self.words])
        matched = np.concatenate([[0.0], np.cumsum(self.share * hit)])
        marked = np.concatenate([[0], np.cumsum(hit & np.array(self.marked, dtype=bool))])
        enough = (matched[None, :] - matched[:, None] >= MIN_MATCHED * np.maximum(self.spans, MIN_WORDS) - 1e-9) & (marked[None, :] - marked[:, None] >= MIN_MARKED * self.marks - 1e-9)
        return bool((self.long & enough).any())

    def align(self, window: list[str], slipped: dict[str, list[str]]) -> list[tuple[int, int]]:
        """The best local alignment: (position in the item, in the window) of its matched words, in order."""
        b = np.array([self.number.get(w, -1) for w in window])
        score = np.where(self.codes[:, None] == b[None, :], MATCH, MISMATCH)
        for j in np.flatnonzero(b < 0):
            for like in slipped.get(window[j], ()):
                score[self.codes == self.number[like], j] = CLOSE
        score = score * np.where(self.marked, MARKED, 1.0)[:, None]
        n, m = score.shape
        h = np.zeros((n + 1, m + 1))
        up = np.full(m + 1, -1e9)
        steps = np.arange(m + 1) * EXTEND
        for i in range(1, n + 1):
            up = np.maximum(h[i - 1] + GAP, up) + EXTEND
            row = np.maximum(up, 0)
            row[1:] = np.maximum(row[1:], h[i - 1, :-1] + score[i - 1])
            left = np.maximum.accumulate(row - steps)
            row[1:] = np.maximum(row[1:], left[:-1] + steps[1:] + GAP)
            h[i] = row
        i, j = np.unravel_index(int(h.argmax()), h.shape)
        found = []
        while i > 0 and j > 0 and h[i, j] > 1e-9:
            if abs(h[i, j] - h[i - 1, j - 1] - score[i - 1, j - 1]) < 1e-6:
                if score[i - 1, j - 1] > 0:
                    found.append((int(i - 1), int(j - 1)))
                i, j = i - 1, j - 1
                continue
            back = h[i, :j] + GAP + EXTEND * (j - np.arange(j))
            k = int(back.argmax())
            if abs(back[k] - h[i, j]) < 1e-6:
                j = k
                continue
            back = h[:i, j] + GAP + EXTEND * (i - np.arange(i))
            i = int(back.argmax())
        return found[::-1]

    def score(self, found: list[tuple[int, int]]) -> tuple[float, float]:
        """(words of the item spanned, share matched) of an alignment, or of its best piece; zeros if none will do."""
        if not found:
            return 0.0, 0.0
        first, last = found[0][0], found[-1][0]
        span = float(self.spans[first, last + 1])
        matched = float(sum(self.share[i] for i, _ in found))
        marks = int(self.marks[first, last + 1])
        marked = sum(self.marked[i] for i, _ in found) / marks if marks else 1.0
        if span >= MIN_WORDS - 0.5 and matched >= MIN_MATCHED * max(span, MIN_WORDS) and marked >= MIN_MARKED:
            return span, matched / span
        skipped = [y[0] - x[0] - 1 for x, y in zip(found, found[1:], strict=False)]
        if not skipped or max(skipped) < LONG_GAP:
            return 0.0, 0.0
        cut = skipped.index(max(skipped)) + 1
        return max(self.score(found[:cut]), self.score(found[cut:]))

    def held(self, words: list[str], places: list[int]) -> tuple[int, float] | None:
        """(words of it in the alignment's span, share matched) if a document with seeds at these places holds the item."""
        best = (0.0, 0.0)
        parts = list(_windows(places, len(self.words), len(words)))
        while parts:
            lo, hi = parts.pop()
            window = words[lo:hi]
            covered = {q + k for g in zip(*(window[k:] for k in range(N)), strict=False) for q in self.grams.get(g, ()) for k in range(N)}
            if len(covered) < MIN_COVERED:
                continue
            there = set(window)
            if not self.possible(there | self.slippery):
                continue
            slipped = self.slipped(there)
            if not self.possible(there.union(*slipped.values())):
                continue
            found = self.align(window, slipped)
            score = self.score(found)
            best = max(best, score)
            if found and score[0] == 0:
                parts += [(lo, lo + found[0][1]), (lo + found[-1][1] + 1, hi)]
        return (round(best[0]), best[1]) if best[0] > 0 else None


@lru_cache(maxsize=2000)
def _item(described: str) -> Item:
    """Kept by the worker from task to task."""
    parts = json.loads(described)
    return Item([x["words"] for x in parts], [x["share"] for x in parts], [x["marked"] for x in parts])


@lru_cache(maxsize=100_000)
def _shortened(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def _windows(places: list[int], length: int, end: int) -> Iterator[tuple[int, int]]:
    start = last = places[0]
    for p in [*places[1:], None]:
        if p is None or p - last > REACH:
            yield max(0, start - length), min(end, last + N + length)
            if p is not None:
                start = p
        if p is not None:
            last = p


def _tokenised(documents: DataFrame) -> DataFrame:
    """(id, words): the tokens of every text with any, one blank between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "words": [" ".join(tokens(t)) for t in batch["text"]]})

    return documents.mapInPandas(run, "id long, words string").where("words <> ''")


_ITEM = "id long, words array<string>, share array<double>, cased array<boolean>, codes array<long>, grams array<long>"


def _stated(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                words, share, cased = weighted_tokens(text)
                codes = word_codes(words)
                rows.append((i, words, share, cased, codes.view(np.int64).tolist(), gram_codes(codes).tolist()))
            yield pd.DataFrame(rows, columns=["id", "words", "share", "cased", "codes", "grams"])

    return items.mapInPandas(run, _ITEM)


def _hits(documents: DataFrame, grams: np.ndarray, words: np.ndarray) -> DataFrame:
    """Per document (id, at, gram) of the n-grams that are among these; and, with a null id, how many documents of a batch
    have each n-gram (kind 1) and each word (kind 2): `gram` and, in `at`, the counts."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((grams, words))  # GRAM_BLOCK numbers at most, twice

    def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values

    def counted(found: list[np.ndarray], kind: int) -> tuple:
        values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
        return None, kind, counts.astype("int32"), values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, vocabulary = shared.value
        for batch in batches:
            rows, gram_sets, word_sets = [], [], []
            for i, text in zip(batch["id"], batch["words"], strict=True):
                codes = word_codes(text.split(" "))
                own = np.unique(codes.view(np.int64))
                word_sets.append(own[among(own, vocabulary)])
                values = gram_codes(codes)
                if len(values) and (at := np.flatnonzero(among(values, known))).size:
                    rows.append((i, 0, at.astype("int32"), values[at]))
                    gram_sets.append(np.unique(values[at]))
            rows += [counted(gram_sets, 1), counted(word_sets, 2)]
            out = pd.DataFrame(rows, columns=["id", "kind", "at", "gram"])
            out["id"] = out["id"].astype("Int64")
            yield out

    return documents.mapInPandas(run, "id long, kind int, at array<int>, gram array<long>")


def _blocks(numbers: DataFrame, size: int) -> Iterator[np.ndarray]:
    """The numbers of a one-column table in sorted arrays of at most `size`."""
    block: list[int] = []
    for row in numbers.toLocalIterator():
        block.append(row[0])
        if len(block) == size:
            yield np.sort(np.array(block, dtype=np.int64))
            block = []
    if block:
        yield np.sort(np.array(block, dtype=np.int64))


def _counts(hits: DataFrame, kind: int, name: str) -> DataFrame:
    pairs = hits.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("gram", "at")).alias("x"))
    return pairs.groupBy(F.col("x.gram").alias(name)).agg(F.sum("x.at").alias("df"))


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, matched) of every item that a document holds."""
    spark = documents.sparkSession
    some = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    stated = store(_stated(some(items, item_id)), "leak-items")
    held = store(_tokenised(some(documents, doc_id)), "leak-words")
    n_docs = held.count()
    hits = None
    vocabulary = list(_blocks(stated.select(F.explode("codes")).distinct(), GRAM_BLOCK)) or [np.zeros(1, np.int64)]
    for k, grams in enumerate(_blocks(stated.select(F.explode("grams")).distinct(), GRAM_BLOCK)):
        part = _hits(held, grams, vocabulary[k] if k < len(vocabulary) else np.zeros(1, np.int64))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_words int, matched double")
    hits = store(hits, "leak-hits")

    # names, codes and amounts
    words = stated.select(F.col("id").alias("item_id"), F.posexplode(F.arrays_zip("words", "share", "cased", "codes")).alias("at", "x")).select("item_id", "at", "x.*")
    digit = F.col("words").rlike(r"\p{N}")
    rare_word = F.coalesce("df", F.lit(0)) <= F.greatest(F.lit(1.0), F.lit(NAME_SHARE * n_docs))
    words = words.join(_counts(hits, 2, "codes"), "codes", "left").withColumn("marked", digit | F.col("cased") & rare_word)
    described = store(words.groupBy("item_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("at", "words", "share", "marked")))).alias("w")), "leak-described")

    # seeds
    placed = stated.select(F.col("id").alias("item_id"), F.size("grams").alias("n"), F.posexplode("grams").alias("q", "gram"))
    # n-grams that no document has count too: an intact stretch of a document has only others
    placed = placed.join(_counts(hits, 1, "gram"), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("least", F.min(F.struct("df", "gram")).over(Window.partitionBy("item_id").orderBy("q").rangeBetween(0, COVER - 1)))
    rare = placed.where(F.col("df") <= F.greatest(F.lit(1.0), F.lit(RARE_SHARE * n_docs))).select("item_id", "gram")
    covering = placed.where(F.col("q") <= F.greatest(F.lit(0), F.col("n") - COVER)).select("item_id", F.col("least.gram").alias("gram"))
    seeds = store(rare.unionByName(covering).distinct(), "leak-seeds")

    found = hits.where("kind = 0").select(F.col("id").alias("doc_id"), F.explode(F.arrays_zip("at", "gram")).alias("x")).select("doc_id", "x.at", "x.gram")
    met = lookup_join(found, seeds, ["gram"], "doc_id", "inner")
    candidates = store(met.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set("at")).alias("places")), "leak-candidates")
    # candidates of one document lie together: spread them before the alignment, which is what costs
    pairs = candidates.join(held.withColumnRenamed("id", "doc_id"), "doc_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "item_id")
    pairs = lookup_join(pairs, described, ["item_id"], "doc_id", "inner", small=is_small(described, ITEMS_BROADCAST))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, item, places, text, w in batch[["doc_id", "item_id", "places", "words", "w"]].itertuples(index=False):
                if hit := _item(w).held(text.split(" "), places.tolist()):
                    rows.append((doc, item, *hit))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "matched"])

    return pairs.mapInPandas(search, "doc_id long, item_id long, n_words int, matched double")
