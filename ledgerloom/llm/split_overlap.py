"""Records of evaluation splits that the training split also holds, exactly or almost: an edit-distance segment join.

Manifest rows are the same if they name the same file (hash or path), the same ground-truth record, or records that
differ only in form or in a few slips; sameness is transitive. The text of a record is its supplier, currency, totals
and sorted lines, numbers in one notation. Every text is cut into k+1 segments; two texts within k edits share a segment
at an allowed position, so (length, segment number, segment) of one meets the substrings of the other. Banded dynamic
programming verifies each candidate, and an exact check keeps other invoices of the same parties apart.

Segments meet whatever number and date the records have, so slips in text, number and date at once are no loss; what is
too far apart in any of them is another invoice. Within a segment that many records have, only those meet that share a key
of their numbers or dates, of which all that may be one invoice share one (`invoice_keys`). Exact copies are collapsed
before the join, so a hot text costs one row.

Results by case:
- null or blank splits belong to neither side but still connect rows; blank keys, unreadable hashes connect nothing;
- records that cannot be read are linked by file and path only; of short texts a fifth of the letters may differ at most;
- a record without number and date is linked to none but its exact copies;
- repeated manifest rows each take part; an empty table gives no pairs; ties do not occur (a link needs no ranking).
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.addresses import letter_bag, slips
from ledgerloom.llm.blocking import CHUNK, crossed_pairs
from ledgerloom.llm.graph import connected_components
from ledgerloom.session import lookup_join, store

#: Edits between the texts of two forms of one record (and of a short text this share of its letters); slips (edits or a
#: transposition) in its number and in its date, and in the date of one without number.
MAX_EDITS = 4
MAX_SHARE = 0.2
MAX_NUMBER_SLIPS = 2
MAX_DATE_SLIPS = 2
MAX_LONE_DATE_SLIPS = 1
#: Numbers of more letters meet by segments: without two letters they would be too many texts.
LONG_NUMBER = 24
TRAINING = ("train", "trn", "training")

_PARTY = "struct<display_name:string,legal_name:string>"
_LINE = "struct<description:string,quantity:string,unit_price:string,line_net_amount:string>"
RECORD = f"""supplier {_PARTY}, buyer {_PARTY}, invoice struct<number:string,issue_date:string,currency:string>,
 totals struct<tax_exclusive_amount:string,total_tax_amount:string,payable_amount:string>, line_items array<{_LINE}>"""


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _number(text: Column) -> Column:
    """One notation of a decimal number: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _date(text: Column) -> Column:
    """yyyymmdd of ISO dates and timestamps, with dashes or slashes, and of day.month.year; else the digits."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^(\d{1,2})[./](\d{1,2})[./](\d{4}).*$", "$3-$2-$1"), r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2}).*$", "$1$2$3")


def record_texts(records: DataFrame, path: str = "ground_truth", record: str = "record_json") -> DataFrame:
    """(path, text, number, date) of every record that can be read."""
    r = records.select(normal_path(F.col(path)).alias("path"), F.from_json(F.col(record), RECORD).alias("r")).where("path is not null and r is not null")
    lines = F.array_sort(F.transform("r.line_items", lambda x: F.concat_ws("x", _number(x.quantity), _number(x.unit_price), _number(x.line_net_amount))))
    text = F.concat_ws(
        "|",
        _plain(F.coalesce("r.supplier.display_name", "r.supplier.legal_name")),
        F.lower("r.invoice.currency"),
        _number(F.col("r.totals.tax_exclusive_amount")),
        _number(F.col("r.totals.total_tax_amount")),
        _number(F.col("r.totals.payable_amount")),
        F.array_join(lines, "|"),
    )
    number = F.nullif(_plain(F.col("r.invoice.number")), F.lit(""))
    return r.select("path", text.alias("text"), number.alias("number"), F.nullif(_date(F.col("r.invoice.issue_date")), F.lit("")).alias("date")).where(F.length("text") > 0)


def normal_path(path: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(\./)+", ""), F.lit(""))


def normal_hash(value: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(value)), r"^sha-?256[:=]\s*", "")
    return F.when(plain.rlike("^[0-9a-f]{64}$"), plain)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k+1 nearly equal segments of a text."""
    short, longer = divmod(length, k + 1)
    sizes = [short] * (k + 1 - longer) + [short + 1] * longer
    out, at = [], 0
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def _hash(length: int, i: int, part: str) -> int:
    return xxhash.xxh64_intdigest(f"{length}/{i}/{part}") - 2**63


def own_keys(text: str, k: int) -> list[int]:
    """Keys of the segments of a text, as signed 64-bit hashes."""
    return [_hash(len(text), i, text[p : p + n]) for i, (p, n) in enumerate(segments(len(text), k))]


def looked_up_keys(text: str, k: int) -> set[int]:
    """Keys of the substrings that can be a segment of a text up to k shorter: the longer text of a pair looks up."""
    looked: set[int] = set()
    for length in range(max(1, len(text) - k), len(text) + 1):
        shift = len(text) - length
        for i, (p, n) in enumerate(segments(length, k)):
            lo = max(0, p - i, p + shift - (k - i))
            hi = min(len(text) - n, p + i, p + shift + (k - i))
            for at in range(lo, hi + 1):
                looked.add(_hash(length, i, text[at : at + n]))
    return looked


def edits_within(a: str, b: str, k: int) -> int | None:
    """The edit distance if it is at most k, by dynamic programming in a band of 2k+1 diagonals."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return None
    far = k + 1
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        if min(new.values()) > k:
            return None
        row = new
    return row[len(b)] if row[len(b)] <= k else None


def most_edits(length: int, k: int) -> int:
    """Edits allowed between two texts of which the longer has this length."""
    return min(k, int(MAX_SHARE * length))


def allowed_edits(a: str, b: str, k: int) -> int:
    return most_edits(max(len(a), len(b)), k)


def segment_keys(text: str, k: int) -> set[int]:
    """`own_keys` for as many edits as any longer partner of a text allows; the short ones allow fewer than k."""
    n = len(text)
    allowed = {most_edits(longer, k) for longer in range(n, n + k + 1) if most_edits(longer, k) >= longer - n}
    return {key for most in allowed for key in own_keys(text, most)}


def partner_keys(text: str, k: int) -> set[int]:
    """`looked_up_keys` for as many edits as a text allows; it shares one with `segment_keys` of each shorter partner."""
    return looked_up_keys(text, most_edits(len(text), k))


def same_invoice(number_a: str | None, date_a: str | None, number_b: str | None, date_b: str | None) -> bool:
    """Whether numbers and dates may belong to one invoice: each agrees but for slips, or is missing where the other tells."""
    dates = slips(date_a, date_b, MAX_DATE_SLIPS) if date_a and date_b else None
    if number_a and number_b:
        return slips(number_a, number_b, MAX_NUMBER_SLIPS) <= MAX_NUMBER_SLIPS and (dates is None or dates <= MAX_DATE_SLIPS)
    return dates is not None and dates <= (MAX_LONE_DATE_SLIPS if number_a or number_b else 0)


def shortened(text: str, most: int) -> set[str]:
    """A text without up to `most` of its letters. Texts within as many slips share one: a slip costs each a letter at most."""
    out = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def invoice_keys(number: str | None, date: str | None, asks: bool) -> set[int]:
    """Keys of which two records that `same_invoice` accepts share one, if one of them asks and the other does not.

    Two numbers meet by what is left of them without a letter or two, long ones by segments (a slip is two edits at most);
    a record without number meets others by its date. Two records with numbers do not meet by date.
    """
    keys: set[int] = set()
    if number:
        if len(number) <= LONG_NUMBER:
            keys |= {xxhash.xxh64_intdigest("n" + t) - 2**63 for t in shortened(number, MAX_NUMBER_SLIPS)}
        if len(number) > LONG_NUMBER - MAX_NUMBER_SLIPS:
            keys |= {*own_keys(number, 2 * MAX_NUMBER_SLIPS), *looked_up_keys(number, 2 * MAX_NUMBER_SLIPS)}
    if date:
        kinds = ["lone", *([] if number else ["numbered"])] if asks else ["numbered" if number else "lone"]
        keys |= {xxhash.xxh64_intdigest(kind + t) - 2**63 for t in shortened(date, MAX_LONE_DATE_SLIPS) for kind in kinds}
    return keys


def met_records(classes: DataFrame, k: int = MAX_EDITS, hot: int = CHUNK) -> DataFrame:
    """(n_a, n_b), n_a < n_b, each once, of records (n, text, number, date): all that may be within k edits and one invoice.

    Segments that no other record has fall in the join with their counts. In those that more than `hot` records have,
    records meet by `invoice_keys` as well.
    """
    spread = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n")

    def rows_of(keys) -> DataFrame:
        @F.pandas_udf(T.ArrayType(T.LongType()))
        def run(text: pd.Series) -> pd.Series:
            return pd.Series([list(keys(t, k)) for t in text])

        @F.pandas_udf(T.LongType())
        def bag(number: pd.Series) -> pd.Series:
            return pd.Series([b - (b >> 63 << 64) for b in map(letter_bag, number.fillna(""))], dtype="int64")

        return spread.select("n", F.when(F.col("number").isNotNull(), bag("number")).alias("bag"), F.explode(run("text")).alias("key"))

    own = store(rows_of(segment_keys), "segments")
    counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first"))
    # the hint: the planner takes what Python enlarges for a small side and would broadcast it
    asked = store(rows_of(partner_keys).join(counts.hint("merge"), "key").where("c > 1 or first <> n"), "segments-met")
    held = own.select("key", F.col("n").alias("m"), F.col("bag").alias("bag_m"))
    # the letters of the numbers, in any order: a bound that loses none
    near = F.coalesce(F.bit_count(F.col("bag").bitwiseXOR(F.col("bag_m"))) <= 2 * MAX_NUMBER_SLIPS, F.lit(True))
    met = asked.where(F.col("c") <= hot).join(held.hint("merge"), "key").where(near).select("n", "m")
    crowded = asked.where(F.col("c") > hot)
    if not crowded.isEmpty():

        def told(rows: DataFrame, asks: bool) -> DataFrame:
            @F.pandas_udf(T.ArrayType(T.LongType()))
            def run(number: pd.Series, date: pd.Series) -> pd.Series:
                return pd.Series([list(invoice_keys(x, y, asks)) for x, y in zip(_none(number), _none(date), strict=True)])

            facts = rows.select("n").distinct().join(classes.select("n", "number", "date").hint("merge"), "n").select("n", run("number", "date").alias("keys"))
            return rows.join(facts.hint("merge"), "n").select("key", F.explode("keys").alias("told"), F.col("n").alias("id")).select(F.xxhash64("key", "told").alias("block"), "id")

        shared = own.join(crowded.select("key").distinct().hint("merge"), "key").select("key", "n")
        met = met.unionByName(crossed_pairs(told(crowded.select("key", "n"), True), told(shared, False)).toDF("n", "m"))
    return met.where("n <> m").select(F.least("n", "m").alias("n_a"), F.greatest("n", "m").alias("n_b")).distinct()


def _none(values: pd.Series) -> pd.Series:
    return values.astype(object).where(values.notna(), None)


def near_links(texts: DataFrame, k: int = MAX_EDITS, hot: int = CHUNK) -> DataFrame:
    """(a, b) of records (path, text, number, date) whose texts are within k edits and that may be one invoice."""
    facts = ["text", "number", "date"]
    keyed = texts.withColumn("fact", F.xxhash64("text", F.coalesce("number", F.lit("")), F.coalesce("date", F.lit(""))))
    # exact copies become one row: the rest of the join sees every distinct record once, under a short number
    classes = store(keyed.groupBy("fact", *facts).agg(F.min("path").alias("path")).withColumn("n", F.monotonically_increasing_id()), "record-classes")
    first = classes.select("fact", F.struct(*facts).alias("facts"), F.col("path").alias("b"))
    copies = lookup_join(keyed, first, ["fact"], "path", "inner").where(F.struct(*facts).eqNullSafe(F.col("facts"))).select(F.col("path").alias("a"), "b").where("a <> b")
    met = met_records(classes, k, hot)
    side = lambda s: classes.select(F.col("n").alias(f"n_{s}"), F.col("path").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in facts])

    @F.pandas_udf(T.BooleanType())
    def same(text_a: pd.Series, number_a: pd.Series, date_a: pd.Series, text_b: pd.Series, number_b: pd.Series, date_b: pd.Series) -> pd.Series:
        columns = zip(text_a, _none(number_a), _none(date_a), text_b, _none(number_b), _none(date_b), strict=True)
        return pd.Series([same_invoice(na, da, nb, db) and edits_within(ta, tb, allowed_edits(ta, tb, k)) is not None for ta, na, da, tb, nb, db in columns], dtype=bool)

    @F.pandas_udf(T.BooleanType())
    def other(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([slips(x, y, MAX_NUMBER_SLIPS) > MAX_NUMBER_SLIPS for x, y in zip(a, b, strict=True)], dtype=bool)

    pairs = met.join(side("a"), "n_a").join(side("b"), "n_b").where(same(*[f"{c}_a" for c in facts], *[f"{c}_b" for c in facts]))
    pairs = store(pairs.withColumn("lone", F.when(F.col("number_a").isNull(), F.col("n_a")).when(F.col("number_b").isNull(), F.col("n_b"))).withColumn("slipped", F.col("lone").isNotNull() & (F.col("date_a") != F.col("date_b"))), "record-pairs")
    # a record without number that has the date of one invoice but for a slip is that one only if no other comes into
    # question; another record without number is no other invoice, nor is a number that differs by slips
    beside = pairs.withColumn("number", F.coalesce("number_a", "number_b")).where("lone is not null and number is not null").select("lone", "slipped", "number")
    told = beside.groupBy("lone").agg(F.bool_or(~F.col("slipped")).alias("exact"), F.min("number").alias("least"), F.max("number").alias("most"))
    several = beside.join(told.where("not exact and least <> most").select("lone", "least"), "lone").where(other("number", "least")).select("lone")
    unclear = told.where("exact").select("lone").unionByName(several.distinct()).withColumn("slipped", F.lit(True))
    return pairs.join(unclear, ["lone", "slipped"], "left_anti").select("a", "b").unionByName(copies)


def same_rows(manifest: DataFrame, records: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """(manifest_id, side, split, kind, component) of every manifest row that is the same as another."""
    split = F.nullif(F.lower(F.trim("split")), F.lit(""))
    rows = manifest.select(
        "manifest_id",
        split.alias("split"),
        F.lower("kind").alias("kind"),
        F.when(split.isin(*TRAINING), "training").when(split.isNotNull(), "evaluation").alias("side"),
        F.array_compact(F.array(F.concat(F.lit("h:"), normal_hash(F.col("sha256"))), F.concat(F.lit("g:"), normal_path(F.col("ground_truth"))), F.concat(F.lit("f:"), F.lower(normal_path(F.col("file")))))).alias("names"),
    ).where(F.size("names") > 0)
    named = rows.select(F.explode(F.filter("names", lambda x: x != F.col("names")[0])).alias("a"), F.col("names")[0].alias("b"))
    near = near_links(store(record_texts(records), "record-texts"), k)
    edges = named.unionByName(near.select(F.concat(F.lit("g:"), "a").alias("a"), F.concat(F.lit("g:"), "b").alias("b")))
    components = connected_components(edges)
    # a row all of whose names occur nowhere else in an edge is its own component
    out = rows.withColumn("node", F.col("names")[0]).join(components, "node", "left")
    return out.select("manifest_id", "side", "split", "kind", F.coalesce("component", "node").alias("component"))


def overlapping_pairs(same: DataFrame) -> DataFrame:
    """Pairs of a training and an evaluation row of one component, the smaller id first."""
    side = lambda name: same.where(F.col("side") == name).select(F.col("component").alias("block"), F.col("manifest_id").alias("id"))
    pairs = crossed_pairs(side("training"), side("evaluation"))
    return pairs.select(F.least("a", "b").alias("manifest_id_a"), F.greatest("a", "b").alias("manifest_id_b"))


def overlap_report(same: DataFrame) -> DataFrame:
    """Rows of each evaluation split and kind, and how many of them the training split also holds."""
    held = same.where("side = 'training'").select("component").distinct().withColumn("held", F.lit(1))
    rows = same.where("side = 'evaluation'").join(held, "component", "left")
    return rows.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count("held").alias("n_in_training"))
