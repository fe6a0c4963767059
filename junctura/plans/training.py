"""The filter of artificial junctions: its training sequences, its training, and the scores it gives to candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.operators import chimeras, junctions, mapping, models
from junctura.operators.ranks import mode_of
from junctura.session import checkpoint


def negative_sequences(alignments: DataFrame, genome: DataFrame, chunks: DataFrame, exons: DataFrame, anchored: list[str], homologs: DataFrame, share: float = 0.8) -> DataFrame:
    """(seq, name) of chimeric reads, one for each pair of genes.

    alignments: SAM rows with SA tags. Reads of which one place of the genome explains ``share`` of the usual length go.
    The usual length is the most frequent one among chimeric reads, before any is left out.
    """
    found = checkpoint(chimeras.chimeric(alignments))
    pairs = checkpoint(chimeras.gene_pairs(chimeras.distant(found), exons, anchored, homologs))
    usual = mode_of(found, "read_length", []).first()["read_length"]
    if usual is None:
        return pairs.select(F.lit("").alias("seq"), F.lit("").alias("name")).where(F.lit(False))
    hits = mapping.map_queries(pairs.select(F.col("read_name").alias("query"), "seq"), genome, most=None, min_words=3, min_score=int(share * usual), min_identity=0.9)
    return junctions.negatives(pairs, exons, chunks, hits.select(F.col("query").alias("read_name")))


def train_filter(positive: DataFrame, negative: DataFrame, kind: str = "logistic", seed: int = 0):
    """(model, evaluation on the rows held back): as many positives as negatives, seven in ten to learn from."""
    rows = checkpoint(models.split(models.labelled(positive, negative), seed=seed))
    model = models.train(rows.where("part = 'train'"), kind)
    return model, models.evaluate(models.score(rows.where("part = 'test'"), model))


def scorer(model, anchor: DataFrame, exons: DataFrame, chunks: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What fusion.predict takes as score: each candidate's sequence around its best position, judged by the model."""

    def score(candidates: DataFrame, best: DataFrame) -> DataFrame:
        key = ["sample", "anchored_gene", "candidate"]
        typed = best.join(candidates.select(*key, "type"), key)
        return models.score(junctions.scoring_sequences(typed, anchor, exons, chunks), model).drop("seq")

    return score
