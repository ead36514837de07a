"""The reading level of documents from vocabulary coverage and sentence complexity, calibrated on rated documents.

Words are ranked by frequency within their language over all documents. A document's coverage rank is the size of the
smallest such vocabulary that covers a fixed share of its words. Coverage ranks and measures of its sentences are
regressed on all ratings, per language, in SQL: only sums of products reach the driver.

Results by case:
- words of equal frequency share a rank; a word's rank counts the words that are more frequent, plus one;
- the language is the one most of whose function words a text has; without any, the given one, else English;
- null and blank texts and texts without words have no level; null ratings are ignored, several ratings each count;
- a language's regression is drawn to that over all, as if it had `SHRINK` ratings more; without any ratings levels are null;
- markup and broken encoding are mended before words are counted;
- repeated documents each get their row; very long texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.leakage import repaired
from ledgerloom.session import store

SHARES = (0.5, 0.8, 0.9)
LEVELS = 5
#: Weight, in ratings, of the regression over all languages within that of each.
SHRINK = 20
LONG_WORD = 10
#: A word above this share of a language's words is frequent: there are at most 1 / FREQUENT of them per language.
FREQUENT = 0.001
LANGUAGES = ("en", "de", "fr", "es")
FUNCTION_WORDS = {
    "en": "the of and is in to a for was that with not on by has",
    "de": "der die das und ist nicht den wurde mit eine von dem zu einer hat",
    "fr": "le la les des est et de un une du pour que au a ce",
    "es": "el la los las del que una es por con se de en y un",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?;:](?:\s|$)|\n+")


def language(counts: Counter[str], given: str | None) -> str:
    votes = {k: sum(counts[w] for w in words) for k, words in _FUNCTION.items()}
    best = max(LANGUAGES, key=lambda k: (votes[k], k == given))
    return best if votes[best] else given if given in LANGUAGES else "en"


def text_measures(text: str, given: str | None) -> tuple[str, int, float, float, float, float, list[tuple[str, int]]] | None:
    """(language, words, words a sentence, letters a word, share of long words, commas a sentence, counted words)."""
    plain = repaired(text)
    words = _WORD.findall(plain.lower())
    if not words:
        return None
    sentences = max(1, sum(1 for s in _SENTENCE.split(plain) if len(_WORD.findall(s)) > 1))
    counts = Counter(words)
    n = len(words)
    return (language(counts, (given or "").lower()[:2]), n, n / sentences, sum(map(len, words)) / n, sum(len(w) >= LONG_WORD for w in words) / n, plain.count(",") / sentences, list(counts.items()))


_MEASURED = "doc_id long, lang string, n_words long, sentence_words double, word_letters double, long_share double, commas double, words array<struct<word:string,n:long>>"


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *m) for d, t, g in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True) if (m := text_measures(t, g if isinstance(g, str) else None))]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "n_words", "sentence_words", "word_letters", "long_share", "commas", "words"])

    some = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("trim(text) <> ''")
    return some.mapInPandas(run, _MEASURED)


def word_ranks(counted: DataFrame) -> DataFrame:
    """(lang, word, rank, frequent) of counted words (lang, word, n). No language is sorted in one task.

    Only the distinct frequencies of a language are: at most the square root of twice its words.
    """
    words = store(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
    return words.sparkSession.sql(
        """
        with by_n as (select lang, n, count(*) as k, sum(n) as tokens from {words} group by lang, n),
        ranked as (
          select lang, n, coalesce(sum(k) over (partition by lang order by n desc rows between unbounded preceding and 1 preceding), 0) + 1 as rank,
                 n > {frequent} * sum(tokens) over (partition by lang) as frequent
          from by_n)
        select w.lang, w.word, r.rank, r.frequent from {words} w join ranked r on w.lang = r.lang and w.n = r.n
        """,
        words=words,
        frequent=FREQUENT,
    )


def coverage(measures: DataFrame) -> DataFrame:
    """(doc_id, n_words, cover_<share>...): coverage ranks of every document."""
    counted = measures.select("doc_id", "lang", F.explode("words").alias("w")).select("doc_id", "lang", "w.word", "w.n")
    ranks = store(word_ranks(counted), "ranks")
    # frequent words, a third of all rows or more, are few by definition; the others meet in a shuffle without hot keys
    few = ranks.where("frequent").select("lang", "word", "rank")
    many = ranks.where("not frequent").select("lang", "word", "rank")
    marked = counted.join(F.broadcast(few.select("lang", "word", F.col("rank").alias("top"))), ["lang", "word"], "left")
    known = marked.where("top is not null").select("doc_id", F.col("top").alias("rank"), "n")
    rest = marked.where("top is null").select("doc_id", "lang", "word", "n").join(many, ["lang", "word"]).select("doc_id", "rank", "n")
    by_rank = known.unionByName(rest).groupBy("doc_id", "rank").agg(F.sum("n").alias("n"))
    listed = by_rank.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("r"), F.sum("n").alias("n_words"))
    reach = "aggregate(r, struct(0L as c, 0L as k), (a, x) -> if(a.c >= {share} * n_words, a, struct(a.c + x.n as c, x.rank as k)), a -> a.k)"
    return listed.select("doc_id", *[F.expr(reach.format(share=f"{s}D")).alias(f"cover_{round(100 * s)}") for s in SHARES])


_FEATURES = ["1D", *[f"ln(cover_{round(100 * s)})" for s in SHARES], "sentence_words", "ln(sentence_words + 1)", "word_letters", "long_share", "ln(commas + 1)"]


def fit_levels(features: DataFrame, ratings: DataFrame) -> dict[str, np.ndarray]:
    """Regression coefficients per language, and over all under '', from sums of products over all ratings."""
    k = len(_FEATURES)
    sums = ", ".join([f"sum(x[{i}] * x[{j}])" for i in range(k) for j in range(i, k)] + [f"sum(x[{i}] * y)" for i in range(k)])
    rows = features.sparkSession.sql(
        f"""
        with rated as (
          select f.lang, array({", ".join(_FEATURES)}) as x, cast(r.reading_level as double) as y
          from {{ratings}} r join {{features}} f on r.doc_id = f.doc_id where r.reading_level is not null)
        select coalesce(lang, '') as lang, count(*) as n, array({sums}) as s from rated group by rollup(lang)
        """,
        ratings=ratings,
        features=features,
    ).collect()  # one row per language
    sums = {}
    for row in rows:
        if row["n"]:
            s = iter(row["s"])
            a = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    a[i, j] = a[j, i] = next(s)
            sums[row["lang"]] = (row["n"], a, np.array(list(s)))
    # a slight ridge keeps features that do not vary harmless
    ridge = np.diag([1e-6] + [1e-3] * (k - 1))
    out = {}
    if "" in sums:
        n, a, b = sums[""]
        out[""] = np.linalg.solve(a + ridge, b)
        for lang, (_, x, y) in sums.items():
            if lang:
                out[lang] = np.linalg.solve(x + SHRINK / n * a + ridge, y + SHRINK / n * (a @ out[""]))
    return out


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, cover_*, sentence_words, long_share, score, reading_level) of every document with words."""
    measures = store(measured(documents), "measures")
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "reading_level")
    covers = coverage(measures)
    features = store(measures.drop("words").join(covers, "doc_id"), "reading-features")
    fits = fit_levels(features, ratings)

    def line(w: np.ndarray) -> str:
        return " + ".join(f"({float(c)!r}D) * ({f})" for c, f in zip(w, _FEATURES, strict=True))

    if not fits:
        score = "cast(null as double)"
    else:
        cases = " ".join(f"when lang = '{lang}' then {line(w)}" for lang, w in fits.items() if lang)
        score = f"case {cases} else {line(fits[''])} end" if cases else line(fits[""])
    shown = ["doc_id", "lang", *[f"cover_{round(100 * s)}" for s in SHARES], "round(sentence_words, 6) as sentence_words", "round(long_share, 6) as long_share"]
    return features.selectExpr(*shown, f"round({score}, 6) as score").withColumn("reading_level", F.when(F.col("score").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.round("score").cast("int")))))


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per language, kind and level, with their mean coverage rank."""
    kinds = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("doc_kind")).alias("doc_kind"))
    joined = levels.join(kinds, "doc_id")
    return joined.groupBy("lang", "doc_kind", "reading_level").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("cover_80"), 3).alias("mean_cover_80"))
