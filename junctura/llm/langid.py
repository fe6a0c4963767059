"""Language identification: words first, then ever shorter character n-grams for words not seen in training.

A word that the model knows counts by its log frequency in each language; one it doesn't know by the mean log frequency
of its longest character n-grams that the model knows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, columns, small, text_of, unit_hash

UNDECIDED = "und"
LONGEST = 5
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LATIN = re.compile(r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")  # the same below U+0300, where there are no marks
_BEYOND = re.compile("[\u0300-\U0010ffff]")
_CACHED = 50_000


def words(text: str) -> Counter:
    """Runs of letters and their marks, lower-cased, with how often each occurs."""
    low = text.lower()
    return Counter((_WORD if _BEYOND.search(low) else _LATIN).findall(low))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of the word between two marks; for n = 1 its letters."""
    marked = word if n == 1 else f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """tokens[0]: words; tokens[n]: n-grams; scores: of each its log frequencies by language, in the same order.

    prior: log shares of the languages.
    """

    languages: list[str]
    prior: np.ndarray
    tokens: list[pa.Array]
    scores: list[np.ndarray]

    @cached_property
    def tables(self) -> list[dict[str, int]]:
        """Each token's place, made where it is needed: a process that only passes the model on holds arrays."""
        return [{t: i for i, t in enumerate(x.to_pylist())} for x in self.tokens]

    @cached_property
    def seen(self) -> dict[str, np.ndarray | None]:
        return {}

    def unseen(self, word: str) -> np.ndarray | None:
        """The mean of a word's longest known n-grams; None if not even a letter is known. Some words are remembered."""
        if word in self.seen:
            return self.seen[word]
        v, n = None, min(LONGEST, len(word) + 2)
        while v is None and n:
            get = self.tables[n].get
            known = [i for g in grams(word, n) if (i := get(g)) is not None]
            if known:
                v = np.add.reduce(self.scores[n][known]) / len(known)
            n -= 1
        if len(self.seen) >= _CACHED:
            self.seen.clear()
        self.seen[word] = v
        return v

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages:
            return UNDECIDED, 0.0
        found = words(text)
        if not found:
            return UNDECIDED, 0.0
        get, at, counts, others, times = self.tables[0].get, [], [], [], []
        for word, n in found.items():
            i = get(word)
            if i is not None:
                at.append(i)
                counts.append(n)
            elif (v := self.unseen(word)) is not None:
                others.append(v)
                times.append(n)
        total = np.zeros(len(self.languages))
        if at:
            total += np.array(counts, float) @ self.scores[0][at]
        if others:
            total += np.array(times, float) @ np.array(others)
        if not total.any():
            total = self.prior
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def labelled_sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str, docs_per_language: int) -> tuple[DataFrame, dict[str, int]]:
    """(_lang, _text) of at most docs_per_language ids of each language, those with the least hashes, and the languages' rows.

    Of several rows with one id and language the one with the least text counts. A filter on the hash leaves few more
    rows than are wanted before these are ranked.
    """
    rows = docs.select(column(id_column).alias("_id"), column(lang_column).cast("string").alias("_lang"), text_of(text_column).alias("_text")).where("_lang IS NOT NULL")
    n = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return rows.select("_lang", "_text"), n
    k, h = docs_per_language, unit_hash(F.col("_id"), seed=6)
    share = F.create_map(*[x for lang, m in n.items() for x in (F.lit(lang), F.lit((k + 6 * k**0.5 + 20) / m))])
    drawn = checkpoint(rows.where(h < share[F.col("_lang")]).groupBy("_lang", "_id").agg(F.min("_text").alias("_text")))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(h, "_id"))
    first = checkpoint(drawn.select("_lang", "_id").withColumn("_rank", rank).where(F.col("_rank") <= k).select(F.col("_lang").alias("_l"), F.col("_id").alias("_i")))
    kept = drawn.join(small(first, 1_000_000), (F.col("_lang") == F.col("_l")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    return kept.select("_lang", "_text"), n


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of a table (_lang, _text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*[(*key, k) for key, k in totals.items()], strict=True)) or [[], [], []]
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, k in words(text).items():
                    totals[lang, word] += k
                if len(totals) > 100_000:
                    yield out()
        yield out()

    return sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def token_counts(counted: DataFrame, words_at_once: int = 20_000) -> DataFrame:
    """(lang, size, token, n) of word_counts(): the words, with size 0, and the n-grams of each length in them."""
    names, kinds = ["lang", "size", "token", "n"], (pa.string(), pa.int32(), pa.string(), pa.int64())

    def out(totals: Counter) -> pa.RecordBatch:
        cols = list(zip(*[(*key, k) for key, k in totals.items()], strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = Counter(), 0
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        totals[lang, size, g] += n
                seen += 1
                if seen % words_at_once == 0:
                    yield out(totals)
                    totals = Counter()
        yield out(totals)

    return counted.select("lang", "word", "n").mapInArrow(run, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    docs_per_language: int = 6_000,
    words_per_language: int = 30_000,
    grams_per_language: int = 12_000,
) -> Model:
    """A model of the rows of docs that have a language.

    Words are counted in the whole texts of at most docs_per_language ids of each language (labelled_sample), and n-grams
    in the words so counted. The features of the model are the words_per_language most frequent words of each language
    and, of each length, its grams_per_language most frequent n-grams; ties go by the word. n-grams of three letters and
    more that occur once in a language are no features. So the model has at most words_per_language + LONGEST *
    grams_per_language entries for each language. Null and empty texts add nothing; without languages the model is empty.
    """
    sample, n = labelled_sample(docs, id_column, text_column, lang_column, docs_per_language)
    if not n:
        return Model([], np.zeros(0), [pa.array([], pa.string())] * (LONGEST + 1), [np.zeros((0, 0), np.float32)] * (LONGEST + 1))
    counted = checkpoint(token_counts(word_counts(sample)))
    totals = {(r["lang"], r["size"]): r["n"] for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    most = F.when(F.col("size") == 0, words_per_language).otherwise(grams_per_language)
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "token"))
    top = counted.where("n > 1 OR size < 3").withColumn("rank", rank).where(F.col("rank") <= most).select("size", "token").distinct()
    languages = sorted(n)
    # a word's counts in all languages, also in those where it is not among the most frequent
    by_language = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("float").alias(f"n{i}") for i, x in enumerate(languages)]
    chosen = counted.join(top, ["size", "token"], "left_semi").groupBy("size", "token").agg(*by_language).select("size", "token", F.array(*[f"n{i}" for i in range(len(languages))]).alias("by"))
    chosen = checkpoint(chosen)
    tokens, scores = [], []
    for size in range(LONGEST + 1):
        got = chosen.where(F.col("size") == size).select("token", "by").toArrow()
        names = got.column(0).combine_chunks()
        v = got.column(1).combine_chunks().flatten().to_numpy().reshape(len(names), len(languages)) + 0.1
        whole = np.array([totals.get((lang, size), 0) for lang in languages]) + 0.1 * len(names)
        tokens.append(names)
        scores.append(np.log(v / np.maximum(whole, 1)).astype(np.float32))
    all_rows = sum(n.values())
    return Model(languages, np.array([math.log(n[x] / all_rows) for x in languages]), tokens, scores)


def predictor(model: Model, docs: DataFrame):
    """A function of a text column that gives a struct (lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        got = [sent.value.predict(x) for x in texts]
        return pd.DataFrame(got, columns=["lang_pred", "score"])

    def of(text: str) -> Column:
        return predict(text_of(text))

    return of


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (the language's share of the likelihood, 0 to 1).

    Null and empty texts and texts without letters are UNDECIDED with score 0, as is everything without training rows.
    Text in letters that the model has never seen gets the most frequent language. Ties go to the first language in
    order. Repeated rows are predicted alike, long texts are read whole. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    rows = docs.select(column(id_column).alias("_id"), predictor(model, docs)(text_column).alias("_p"))
    return rows.select(F.col("_id").alias(id_column), "_p.lang_pred", "_p.score")


def reject_undecided(docs: DataFrame, model: Model, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is undecided or has a score of under ``least``; columns as they were.

    So null and empty texts and texts without letters go, and repeated rows go or stay together; long texts are read
    whole. Columns may have any names. An empty table stays empty, and an empty model rejects all.
    """
    rows = docs.select(F.struct(*columns(docs)).alias("row"), predictor(model, docs)(text_column).alias("p"))
    return rows.where((F.col("p.lang_pred") != UNDECIDED) & (F.col("p.score") >= least)).select("row.*")
