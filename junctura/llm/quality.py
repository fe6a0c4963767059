"""Quality by Bradley-Terry pairwise ranking.

From pairs of a better and a worse document a linear score is learned by logistic loss on the difference of their
features. Features are statistics of a text, each cut at quantiles. The cut between good and bad is a quantile of the
scores of labelled documents: the share of bad ones among them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import bounded_sample, checkpoint, column, text_of

CUT = 0.3
_MARKS = re.compile(r"[^\w\s]{2,}")
_CLASS = np.zeros(256, np.int64)  # 0 other signs, 1 lower case and letters past ASCII, 2 upper case, 3 digits, 4 blanks, 5 line ends
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5


def statistics(text: str) -> list[float]:
    """Numbers that a reader's first glance would go by; all 0 for the empty text."""
    data = text.encode("utf-8", "surrogatepass")
    sign, low, up, digit, _, ends = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6).tolist()
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * 16
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x]
    letters = max(low + up, 1)
    alike = sum(a == b for a, b in zip(found, found[1:], strict=False))
    doubles = len(_MARKS.findall(text))
    bare = sum(k for w, k in counts.items() if len(w) == 1 and not w.isalnum())
    return [
        np.log1p(len(data)),
        sign / len(data),
        up / letters,
        digit / len(data),
        letters / len(data),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        (low + up) / n,
        1 - len(set(lines)) / len(lines),
        ends / n,
        alike / n,
        doubles / n,
        bare / n,
        sum(map(text.count, (".", "?", "!"))) / n,
        max(map(len, found)) / 20,
        np.log1p(n / len(lines)),
    ]


def table_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], float).reshape(len(texts), 16)


@dataclass
class Ranking:
    """edges: where each statistic is cut; weights: of each statistic's parts; middle and spread turn scores to 0 to 1."""

    edges: list[np.ndarray]
    weights: np.ndarray
    middle: float = 0.0
    spread: float = 1.0

    def expand(self, table: np.ndarray) -> np.ndarray:
        """Each statistic as 0 or 1 for each edge that it passes."""
        return np.hstack([(table[:, i : i + 1] > e[None, :]) for i, e in enumerate(self.edges)]).astype(np.float32)

    def raw(self, table: np.ndarray) -> np.ndarray:
        return self.expand(table) @ self.weights

    def score(self, table: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the middle."""
        x = (self.raw(table) - self.middle) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def pair_loss(w: np.ndarray, diff: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(mean of log(1 + exp(-w.diff)) with an L2 penalty, its gradient); a row of diff is a better document less a worse one."""
    x = np.clip(diff @ w, -40, 40)
    gradient = -(diff.T @ (1 / (1 + np.exp(x)))) / len(diff) + penalty * w
    return float(np.log1p(np.exp(-x)).mean() + penalty / 2 * (w @ w)), gradient


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Bradley-Terry weights: pair_loss made least by Adam."""
    diff = (better - worse).astype(np.float32)
    w, m, v = (np.zeros(diff.shape[1]) for _ in range(3))
    for step in range(1, steps + 1 if len(diff) else 1):
        _, g = pair_loss(w, diff, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample_rows: int = 8_000,
    pairs: int = 30_000,
    parts: int = 12,
    seed: int = 10,
) -> Ranking:
    """A ranking from the labelled ids, at most sample_rows of them, chosen by a hash of the id.

    Null labels and ids are left out; an id with several labels counts as bad if one of them is 0, and with several rows
    as the one with the least text, so it is one row of the sample however often it stands. At most ``pairs`` pairs of a
    good and a bad row are drawn. With one label only, or without rows, all weights are 0. Other columns are not read,
    whatever their names.
    """
    known = labels.where(column(id_column).isNotNull() & column(label_column).isNotNull()).groupBy(column(id_column).alias("_lid")).agg(F.min(column(label_column)).cast("int").alias("_label"))
    chosen = checkpoint(bounded_sample(known, "_lid", sample_rows, seed=seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array(list(table_of(batch.column(2).to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], names=["_id", "_label", "_stats"])

    texts = docs.select(column(id_column).alias("_did"), text_of(text_column).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_did") == F.col("_lid"))  # sample_rows at most
    rows = rows.groupBy("_lid", "_label").agg(F.min("_text").alias("_text"))
    kind = labels.schema[id_column].dataType.simpleString()
    got = rows.mapInArrow(run, f"_id {kind}, _label int, _stats array<double>").toPandas().sort_values("_id")
    table = np.array(got["_stats"].tolist(), float).reshape(len(got), 16)
    label = got["_label"].to_numpy(int)
    edges = [np.unique(np.quantile(c, np.arange(parts) / parts)) if len(c) else np.zeros(1) for c in table.T]
    model = Ranking(edges, np.zeros(sum(map(len, edges))))
    good, bad = np.flatnonzero(label > 0), np.flatnonzero(label <= 0)
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        x = model.expand(table)
        model.weights = fit_pairs(x[rng.choice(good, pairs)], x[rng.choice(bad, pairs)])
        raw = model.raw(table)
        model.middle = float(np.quantile(raw, len(bad) / len(label)))
        model.spread = max(float(raw.std()) / 3, 1e-6)
    return model


def score(docs: DataFrame, model: Ranking, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1, higher is better), predicted (1 if the score is CUT or more, else 0).

    Null texts count as empty, and empty ones have all statistics 0; long texts are read whole. Equal texts, and so
    repeated rows, score alike. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(table_of(list(texts))), dtype=float)

    rows = docs.select(column(id_column).alias("_id"), run(text_of(text_column)).alias("score"))
    return rows.select(F.col("_id").alias(id_column), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
