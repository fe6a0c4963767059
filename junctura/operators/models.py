"""Telling natural junctions from artificial ones: features of sequences, linear classifiers, folds, scores.

The classifiers are Spark's own, trained on one-hot letters where Spark partitions the rows. A model is a vector of
weights for each place and letter, so scoring is an expression of the JVM or, for other models, a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import one_hot
from junctura.operators.ranks import auc, folds
from junctura.operators.sampling import balanced_split


def features(rows: DataFrame, seq: str = "seq", length: int = 201) -> DataFrame:
    """rows with features: the one-hot letters of the sequence, cut or padded with N to one length, as a vector."""
    hot = F.flatten(one_hot(F.rpad(F.col(seq), length, "N")))
    return rows.withColumn("features", array_to_vector(F.transform(hot, lambda x: x.cast("double"))))


def labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(seq, name, label) of both kinds."""
    return positive.select("seq", "name", F.lit(1).alias("label")).unionByName(negative.select("seq", "name", F.lit(0).alias("label")))


def split(rows: DataFrame, train_percent: int = 70, seed: int = 0) -> DataFrame:
    """As many rows of each label, with part: train or test, dealt by a hash of the sequence."""
    distinct = rows.groupBy("seq").agg(F.min("name").alias("name"), F.max("label").alias("label"))
    return balanced_split(distinct, "label", [F.xxhash64(F.lit(seed), F.col("seq")), F.col("seq")], train_percent)


def train(rows: DataFrame, kind: str = "logistic", rounds: int = 50, penalty: float = 0.01):
    """A classifier of rows (seq, label): 'logistic' with probabilities, or 'svm' with margins."""
    data = features(rows).select("features", F.col("label").cast("double").alias("label"))
    make = LogisticRegression(maxIter=rounds, regParam=penalty) if kind == "logistic" else LinearSVC(maxIter=rounds, regParam=penalty)
    return make.fit(data)


def score(rows: DataFrame, model, name: str = "natural_score") -> DataFrame:
    """rows with the chance of label 1; for a model without probabilities the margin."""
    out = model.transform(features(rows))
    value = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")[1]
    return out.withColumn(name, value).select(*rows.columns, name)


def score_by(rows: DataFrame, run: Callable[[list[str]], list[float]], seq: str = "seq", name: str = "natural_score") -> DataFrame:
    """rows with the score that any function of a batch of sequences gives, such as a network in a runtime of its own."""

    def of(batch: pd.Series) -> pd.Series:
        return pd.Series(run(batch.tolist()), dtype=float)

    return rows.withColumn(name, F.pandas_udf(of, "double")(F.col(seq)))


def evaluate(scored: DataFrame, score: str = "natural_score", cut: float = 0.5) -> DataFrame:
    """(accuracy, positives, negatives, auc) of rows with label and score."""
    right = scored.agg(F.avg((F.col("label") == (F.col(score) > cut).cast("int")).cast("int")).alias("accuracy")).scalar()
    return auc(scored, "label", score).withColumn("accuracy", right)


def cross_validate(rows: DataFrame, k: int = 5, kind: str = "svm") -> list[tuple[int, float]]:
    """(fold, auc) for each fold, the best first. Each model learns from the other folds."""
    dealt = folds(rows, [F.xxhash64("seq"), F.col("seq"), F.col("name")], k, ("label",))
    out = []
    for i in range(k):
        model = train(dealt.where(F.col("fold") != i), kind)
        out.append((i, auc(score(dealt.where(F.col("fold") == i), model), "label", "natural_score").first()["auc"]))
    return sorted(out, key=lambda x: (-x[1], x[0]))
