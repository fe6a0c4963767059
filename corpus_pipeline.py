"""A corpus pipeline over documents: language, exact copies, near copies, mixture, packing.

Each stage takes what the one before kept, as a table, and calls one operator of junctura.llm. Stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from junctura.llm import exact_dedup, langid, mixing, packing, simhash
from junctura.llm.common import held_out, remove, shared_folder, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is undecided (no letters, or a score of under a half) go.

    So null and empty texts go; long ones are read whole, and repeated rows go or stay together. Columns stay as they
    are, whatever their names. An empty table stays empty.
    """
    small_batches(spark)
    return langid.reject_undecided(docs, langid.train(docs.where(~held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the one with the most code points, then the smallest id, then any of repeated rows.

    Null and empty texts are equal; long ones are compared whole. Columns stay as they are, whatever their names. An empty
    table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 on five-word shingles that with the smallest id stays.

    Null and empty texts are one group, rows without an id stay, and rows that share the smallest id stay together; long
    texts are compared whole. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated so that sources get their target weights; copies have the same doc_id.

    Texts aren't looked at. A null source is a source, and rows of one id get the same number. Columns stay as they are,
    whatever their names. An empty table stays empty.
    """
    return mixing.replicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens.

    Null and empty texts are a piece of one token; long ones are cut. Repeated rows are packed each for itself. Other
    columns are not read, whatever their names. An empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packed),
]

#: A trained language model and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last a Parquet table in the shared folder.

    A stage's table goes when the next one is written; the last stage reads its own as long as its result is in use.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
            if k:
                remove(spark, f"{at}/{STAGES[k - 1][0]}")
    return docs
