"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) is the logistic function of theta_k - w.x; the weights w are shared by all thresholds theta, which are
kept in order. x is sparse and hashed: the words of a text, whether they occur, and beginnings that many of its words
share, at two levels of frequency: insults are often built from one stem. The result is the expected grade.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import bounded_sample, checkpoint, column, text_of

_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 300_000
STEM_WORDS = 150
STEM_LEVELS = (1.5, 3.0)


def index(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dims


def stems(words: list[str]) -> list[str]:
    """Features of beginnings of 4 to 7 letters: how many words of each STEM_WORDS share one, at two levels.

    In texts shorter than that, words count as they are. A longer beginning is looked at if the shorter one is frequent.
    """
    unit = max(1.0, len(words) / STEM_WORDS)
    least = STEM_LEVELS[0] * unit
    out = []
    for size in range(4, 8):
        counts = Counter([w[:size] for w in words if len(w) >= size])
        often = {p: n for p, n in counts.items() if n >= least}
        out += [f"{p}*{k}" for p, n in often.items() for k, level in enumerate(STEM_LEVELS) if n >= level * unit]
        words = [w for w in words if w[:size] in often]
        if not words:
            break
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """grades: how many, from 0. weights by feature, thresholds in rising order, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    seen: dict[str, float] = field(default_factory=dict)

    def linear(self, text: str) -> float:
        total, seen = 0.0, self.seen
        words = _WORD.findall(text.lower())
        for word in [*set(words), *stems(words)]:
            v = seen.get(word)
            if v is None:
                if len(seen) >= _CACHED:
                    seen.clear()
                v = seen[word] = float(self.weights[index(word, len(self.weights))])
            total += v
        return total

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """A row for each value: the chance of each grade."""
        upto = sigmoid(self.thresholds[None, :] - np.asarray(linear, float)[:, None])
        edges = np.hstack([np.zeros((len(upto), 1)), upto, np.ones((len(upto), 1))])
        return np.diff(edges, axis=1)


def telling(rows: np.ndarray, cols: np.ndarray, bad: np.ndarray, dims: int) -> np.ndarray:
    """For each feature by how many standard errors its share of bad rows is off that of the others, less three; 0 at least."""
    n1, n0 = max(bad.sum(), 1), max((~bad).sum(), 1)
    p, q = np.bincount(cols[bad[rows]], minlength=dims) / n1, np.bincount(cols[~bad[rows]], minlength=dims) / n0
    all_ = (p * n1 + q * n0) / (n1 + n0)
    return np.maximum(np.abs(p - q) / np.sqrt(np.maximum(all_ * (1 - all_), 1e-12) * (1 / n1 + 1 / n0)) - 3, 0)


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """theta_0 and the logs of the steps between thresholds, as thresholds in rising order."""
    return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))


def ordinal_loss(theta: np.ndarray, rows: np.ndarray, col: np.ndarray, value: np.ndarray, grades: np.ndarray, levels: int, penalty: float) -> tuple[float, np.ndarray]:
    """(mean negative log likelihood with an L2 penalty on the weights, its gradient) at theta: weights, then thresholds_of's."""
    n, k = len(grades), len(theta) - (levels - 1)
    w, t = theta[:k], thresholds_of(theta[k:])
    hot = np.arange(levels)[None, :] == grades[:, None]
    upto = sigmoid(t[None, :] - np.bincount(rows, w[col] * value, n)[:, None])
    slope = np.hstack([np.zeros((n, 1)), upto * (1 - upto), np.zeros((n, 1))])
    edges = np.hstack([np.zeros((n, 1)), upto, np.ones((n, 1))])
    p = np.maximum((np.diff(edges, axis=1) * hot).sum(1), 1e-9)
    high = (slope[:, 1:] * hot).sum(1) / p  # d log p / d upper threshold
    low = (slope[:, :-1] * hot).sum(1) / p
    by_x = (high - low) / n  # of the loss
    by_t = np.zeros(levels - 1)
    np.add.at(by_t, np.minimum(grades, levels - 2), -high * (grades < levels - 1) / n)
    np.add.at(by_t, np.maximum(grades - 1, 0), low * (grades > 0) / n)
    tail = by_t[::-1].cumsum()[::-1]
    gradient = np.concatenate((np.bincount(col, by_x[rows] * value, k) + penalty * w, tail[:1], tail[1:] * np.exp(theta[k + 1 :])))
    return float(-np.log(p).mean() + penalty / 2 * (w @ w)), gradient


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, dims: int, levels: int, penalty: float = 1e-5, steps: int = 1000, rate: float = 0.05) -> Ordinal:
    """Weights and thresholds by Adam on ordinal_loss.

    (rows, cols): which features are set. A feature is scaled by how telling it is, so that the penalty holds back
    chance words most. Grades are from 0 to levels - 1.
    """
    n = len(grades)
    scale = telling(rows, cols, grades > 0, dims)
    scale /= max(scale.max(), 1e-9)
    rows, cols = rows[scale[cols] > 0], cols[scale[cols] > 0]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    used, col = np.unique(cols, return_inverse=True)
    value = np.sqrt(scale[cols])
    theta = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if n else 1):
        _, g = ordinal_loss(theta, rows, col, value, grades, levels, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(dims, np.float32)
    weights[used] = theta[: len(used)] * np.sqrt(scale[used])
    return Ordinal(weights, thresholds_of(theta[len(used) :]))


def features(texts: DataFrame, dims: int) -> DataFrame:
    """(_id, _label, _x) of (_id, _label, _text): the features that are set in each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_WORD.findall(x.lower()) for x in batch.column(2).to_pylist()]
            xs = pa.array([sorted({index(w, dims) for w in [*set(x), *stems(x)]}) for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), xs], names=["_id", "_label", "_x"])

    return texts.select("_id", "_label", "_text").mapInArrow(run, f"_id {texts.schema['_id'].dataType.simpleString()}, _label int, _x array<int>")


def severity(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, dims: int, levels: int = 4, folds: int = 2) -> np.ndarray:
    """Grades from binary labels: 0 for rows that are not toxic, else 1 to levels - 1 by the number of telling features.

    A feature tells when it is ten times as frequent in toxic rows. Which ones tell is learned, for each fold of the
    rows, from the other folds, so a row's grade never rests on its own label. Toxic rows are cut at quantiles.
    """
    found = np.zeros(len(toxic))
    for k in range(folds):
        other = np.arange(len(toxic)) % folds != k
        n1, n0 = (toxic[other] == 1).sum(), (toxic[other] == 0).sum()
        bad = np.bincount(cols[(toxic[rows] == 1) & other[rows]], minlength=dims) / max(n1, 1)
        good = np.bincount(cols[(toxic[rows] == 0) & other[rows]], minlength=dims) / max(n0, 1)
        tells = (bad > 0.01) & (bad > 10 * good)
        found += np.where(other, 0, np.bincount(rows, tells[cols], len(toxic)))
    if not (toxic == 1).any():
        return np.zeros(len(toxic), int)
    edges = np.quantile(found[toxic == 1], np.arange(1, levels - 1) / (levels - 1))
    return np.where(toxic == 1, 1 + np.searchsorted(edges, found, side="left"), 0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample_rows: int = 12_000,
    dims: int = 1 << 20,
    levels: int = 4,
    graded: bool = False,
) -> Ordinal:
    """A model of the labelled ids, at most sample_rows of them, chosen by a hash of the id.

    The labels are grades from 0 to levels - 1 if graded, else 0 and 1, of which severity() makes grades. Null labels
    and ids are left out; of several labels of an id the greatest counts, and of several rows the one with the least
    text, so an id is one row of the sample however often it stands. Whole texts are read. Without labels all weights
    are 0. Other columns are not read, whatever their names.
    """
    known = labels.where(column(id_column).isNotNull() & column(label_column).isNotNull()).groupBy(column(id_column).alias("_lid")).agg(F.max(column(label_column)).cast("int").alias("_label"))
    chosen = F.broadcast(checkpoint(bounded_sample(known, "_lid", sample_rows, seed=1)))  # sample_rows at most
    texts = docs.select(column(id_column).alias("_id"), text_of(text_column).alias("_text")).join(chosen, F.col("_id") == F.col("_lid"))
    got = features(texts.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), dims).toPandas()
    got = got.sort_values("_id").reset_index(drop=True)
    n = len(got)
    cols = np.concatenate([np.asarray(x, np.int64) for x in got["_x"]]) if n else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(n), [len(x) for x in got["_x"]]) if n else np.zeros(0, np.int64)
    common = np.bincount(cols, minlength=dims) >= min(5, max(1, n // 50))
    rows, cols = rows[common[cols]], cols[common[cols]]
    label = got["_label"].to_numpy(int) if n else np.zeros(0, int)
    grades = np.clip(label, 0, levels - 1) if graded else severity(rows, cols, label, dims, levels)
    return fit_ordinal(rows, cols, grades, dims, levels)


def score(docs: DataFrame, model: Ordinal, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, severity (expected grade), grade (the likeliest, ties to the lower), p_toxic, toxic.

    p_toxic is the chance of any grade over 0; toxic whether it is at least 0.5. Every word of a text counts, whatever
    its length. Null and empty texts have no features. Repeated rows score alike. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def run(texts: pd.Series) -> pd.DataFrame:
        p = sent.value.probabilities(np.array([sent.value.linear(x) for x in texts]))
        return pd.DataFrame({"severity": p @ np.arange(p.shape[1]), "grade": p.argmax(axis=1).astype(np.int32), "p_toxic": 1 - p[:, 0]})

    rows = docs.select(column(id_column).alias("_id"), run(text_of(text_column)).alias("_s"))
    return rows.select(F.col("_id").alias(id_column), "_s.severity", "_s.grade", "_s.p_toxic", (F.col("_s.p_toxic") >= 0.5).cast("int").alias("toxic"))
