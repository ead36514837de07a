"""Documents packed into containers of fixed capacity along a space-filling curve.

Each document's words are hashed into a vector of many dimensions, weighed by their rarity and scaled to length one, so that
its length in words does not matter; the vectors are projected onto the few directions in which they differ most (principal
components, from sums over all documents). The standardised coordinates make a cell of a grid whose Hilbert index
orders the corpus so that similar documents are neighbours. Ranges of the curve of about equal numbers of tokens, from exact
counts, are sorted and packed with best fit into a bounded number of open containers, so neighbours share containers, memory is
bounded, and every range leaves at most `OPEN` containers that later documents could not fill. The same documents give
the same containers, whatever the number of tasks.

Results by case:
- a document of more tokens than the capacity is cut into full pieces and a rest, which is packed like a document; no
  other document is cut; null and blank texts and texts without tokens are not packed;
- repeated documents are packed each; ties on the curve go by doc_id; an empty table gives no rows;
- texts are counted whole, by a public tokenizer whose file is a parameter.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import store

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS = 3
#: Dimensions of the hashed vectors.
HASHED = 256
BITS = 10
OPEN = 64
#: Containers of a range, and the cells (this many leading bits of the Hilbert index) that ranges are made of.
RANGE = 2000
CELL_BITS = 12
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hashed_words(text: str) -> np.ndarray:
    """The hashed codes of the distinct words of a text, sorted."""
    return np.unique(np.array([zlib.crc32(w.encode()) for w in set(_WORD.findall(text.lower()))], dtype=np.int64))


def vector(codes: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """A unit vector: each distinct word adds its slot's rarity with a random sign; zeros for a text without words."""
    out = np.zeros(HASHED)
    slots = codes % HASHED
    np.add.at(out, slots, rarity[slots] * (((codes * 2654435761 & 0xFFFFFFFF) >> 16 & 1) * 2 - 1))
    length = np.linalg.norm(out)
    return out / length if length else out


def hilbert_index(cell: list[int], bits: int = BITS) -> int:
    """The position of a grid cell on the Hilbert curve, by Skilling's transpose (AIP Conf. Proc. 707, 2004)."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ t) >> b & 1
    return key


class Packer:
    """Best fit into at most `keep` open containers; the fullest closes when there are more."""

    def __init__(self, capacity: int, keep: int) -> None:
        self.capacity, self.keep = capacity, keep
        self.room: dict[int, int] = {}
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """(container, offset) of an item of at most the capacity."""
        at = min((c for c, r in self.room.items() if r >= size), key=lambda c: (self.room[c], c), default=None)
        if at is None:
            at, self.made = self.made, self.made + 1
            self.room[at] = self.capacity
        offset = self.capacity - self.room[at]
        self.room[at] -= size
        if self.room[at] == 0:
            del self.room[at]
        elif len(self.room) > self.keep:
            del self.room[min(self.room, key=lambda c: (self.room[c], c))]
        return at, offset


def measured(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, codes) of every document with tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows = [(d, len(encoder.encode_ordinary(t)), hashed_words(t)) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "codes"])

    some = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("trim(text) <> ''")
    return some.mapInPandas(run, "doc_id long, n_tokens long, codes array<long>").where("n_tokens > 0")


def _directions(sized: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rarity of each slot, mean vector, directions) from all documents: HASHED squared sums reach the driver."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(HASHED + 1)
        for batch in batches:
            for codes in batch["codes"]:
                total[np.unique(codes % HASHED)] += 1
            total[HASHED] += len(batch)
        yield pd.DataFrame({"i": np.arange(HASHED + 1), "v": total})

    def summed(df: DataFrame) -> np.ndarray:
        rows = df.groupBy("i").agg(F.sum("v").alias("v")).collect()  # at most HASHED * (HASHED + 1) + 1 rows
        out = np.zeros(max((r["i"] for r in rows), default=-1) + 1)
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    counts = summed(sized.mapInPandas(slots, "i int, v double"))
    if not len(counts) or not counts[HASHED]:
        return np.ones(HASHED), np.zeros(HASHED), np.eye(DIMENSIONS, HASHED)
    rarity = np.log((counts[HASHED] + 1) / (counts[:HASHED] + 0.5))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mean = np.zeros((HASHED, HASHED)), np.zeros(HASHED)
        for batch in batches:
            x = np.array([vector(c, rarity) for c in batch["codes"]]).reshape(-1, HASHED)
            total += x.T @ x
            mean += x.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(HASHED * (HASHED + 1)), "v": np.concatenate([total.ravel(), mean])})

    sums = summed(sized.mapInPandas(products, "i int, v double"))
    mean = sums[HASHED * HASHED :] / counts[HASHED]
    # sums of parts come in any order: round away what that changes, so that the directions are the same each time
    spread = np.round(sums[: HASHED * HASHED].reshape(HASHED, HASHED) / counts[HASHED] - np.outer(mean, mean), 9)
    _, directions = np.linalg.eigh((spread + spread.T) / 2)
    top = directions[:, ::-1][:, :DIMENSIONS].T
    top *= np.where(top[np.arange(DIMENSIONS), np.abs(top).argmax(axis=1)] < 0, -1, 1)[:, None]
    return rarity, np.round(mean, 9), np.round(top, 6)


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, position, doc_id, piece, first_token, n_tokens): the contents of every container."""
    sized = store(measured(documents, tokenizer), "token-counts")
    rarity, mean, directions = _directions(sized)
    names = [f"c{i}" for i in range(DIMENSIONS)]

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([vector(c, rarity) for c in batch["codes"]]).reshape(-1, HASHED)
            y = np.round((x - mean) @ directions.T, 6)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": batch["n_tokens"], **{n: y[:, i] for i, n in enumerate(names)}})

    placed = store(sized.mapInPandas(projected, "doc_id long, n_tokens long, " + ", ".join(f"{n} double" for n in names)), "coordinates")
    spread = placed.agg(*[F.round(F.avg(c), 6).alias(f"m{c}") for c in names], *[F.round(F.stddev_pop(c), 6).alias(f"s{c}") for c in names], F.sum("n_tokens").alias("tokens")).first()
    centre = [(spread[f"m{c}"] or 0.0, spread[f"s{c}"] or 1.0) for c in names]
    top = (1 << BITS) - 1

    @F.pandas_udf("long")
    def curve(*coordinates: pd.Series) -> pd.Series:
        # the logistic of the standard score fills the grid evenly enough
        cells = [np.clip((top + 1) / (1 + np.exp(-1.7 * (c.to_numpy() - m) / s)), 0, top).astype(int) for c, (m, s) in zip(coordinates, centre, strict=True)]
        return pd.Series([hilbert_index(list(map(int, cell))) for cell in zip(*cells, strict=True)], dtype="int64")

    ordered = store(placed.select("doc_id", "n_tokens", curve(*names).alias("key")).withColumn("cell", F.shiftright("key", BITS * DIMENSIONS - CELL_BITS)), "curve")
    # ranges of about `RANGE` containers: what the last open containers of each waste stays small
    most = capacity * RANGE
    ranges, part, filled = [], 0, 0
    for row in ordered.groupBy("cell").agg(F.sum("n_tokens").alias("n")).orderBy("cell").collect():  # at most 2 ** CELL_BITS rows
        if filled and filled + row["n"] > most * 1.5:
            part, filled = part + 1, 0
        # a cell too full for one range is cut by document
        split = max(1, round(row["n"] / most))
        ranges.append((row["cell"], part, split))
        part, filled = (part + split - 1, filled + row["n"]) if split == 1 else (part + split, 0)
    table = documents.sparkSession.createDataFrame(ranges, "cell long, first int, split int")
    parts = ordered.join(F.broadcast(table), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("split"))).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, of = Packer(capacity, OPEN), None
        for batch in batches:
            rows = []
            for doc, total, at in batch[["doc_id", "n_tokens", "part"]].itertuples(index=False):
                if at != of:
                    packer, of = Packer(capacity, OPEN), at
                for piece, first in enumerate(range(0, total, capacity)):
                    size = min(capacity, total - first)
                    container, offset = packer.put(size)
                    rows.append(((int(at) << 32) + container, offset, doc, piece, first, size))
            yield pd.DataFrame(rows, columns=["container_id", "position", "doc_id", "piece", "first_token", "n_tokens"])

    ranged = parts.select("part", "key", "doc_id", "n_tokens").repartition("part").sortWithinPartitions("part", "key", "doc_id", "n_tokens")
    return ranged.mapInPandas(run, "container_id long, position int, doc_id long, piece int, first_token long, n_tokens int")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, documents and tokens, the share of capacity used, and documents cut."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"))
    totals = each.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    counts = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("pieces") > 1, 1)).alias("n_cut"))
    return totals.crossJoin(counts).select("n_containers", "n_documents", "n_cut", "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"))
