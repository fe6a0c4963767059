"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

A first scan keeps two numbers of each row, its length and the hash of its beginning. Rows alone with their length are
settled; of the rest, those alone with their length and prefix hash; only the surviving groups have their whole content
hashed. No text is ever shuffled, and rows are counted by length, by length and prefix and by hash before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, columns, join_frequent, small, text_of

#: Characters that comparison ignores: space, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def surviving(narrow: DataFrame, broadcast_lengths: int = 1_000_000) -> DataFrame:
    """(_len, _prefix): the groups of more than one row of narrow (_len, _prefix).

    Lengths that stand alone are left out first, as long as the others are few enough to be sent to all tasks; that only
    spares work, as a row alone with its length is alone with its prefix too.
    """
    lengths = checkpoint(narrow.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_len"))
    shared = narrow.join(F.broadcast(lengths), "_len", "left_semi") if lengths.count() <= broadcast_lengths else narrow
    return shared.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_len", "_prefix")


def progressive_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    prefix_chars: int = 256,
    broadcast_groups: int = 200_000,
    digest_all: bool = False,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting IGNORED. Of equal texts the one with the most code points stays, then
    the smallest id (null last), then one of the repeated rows. text_sha256 is null for rows that were settled before
    the full hash, unless digest_all asks for it. Null and empty texts are equal and form one group; long texts are
    hashed whole. Other columns of docs are not read, whatever their names. An empty table gives an empty result.

    The surviving groups are sent to all tasks only up to broadcast_groups (16 bytes each); beyond that every row is
    hashed where it lies, and only the hashes are joined.
    """
    key = ["_len", "_prefix"]
    scan = docs.select(column(id_column).alias("_id"), F.length(text_of(text_column)).alias("_cp"), normalised(text_of(text_column)).alias("_norm"))
    scan = scan.select("_id", "_cp", "_norm", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix"))
    groups = checkpoint(surviving(checkpoint(scan.select(*key))).withColumn("_open", F.lit(True)))

    still_open = F.coalesce(F.col("_open"), F.lit(False))
    if groups.count() <= broadcast_groups:
        rows = scan.join(F.broadcast(groups), key, "left").withColumn("_sha", F.when(still_open | F.lit(digest_all), F.sha2("_norm", 256)))
    else:
        rows = scan.withColumn("_sha", F.sha2("_norm", 256)).drop("_norm").join(groups, key, "left")
        rows = rows.withColumn("_sha", F.when(still_open | F.lit(digest_all), F.col("_sha")))
    rows = rows.select("_id", "_cp", still_open.alias("_open"), F.unhex("_sha").alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    rows = checkpoint(rows)

    order = F.struct((-F.col("_cp")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col("_row").alias("d"))
    best = checkpoint(rows.where("_open").groupBy("_sha").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n")))
    settled = rows.where("NOT _open").select(
        F.col("_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha"
    )
    grouped = join_frequent(rows.where("_open"), best, "_sha", "_n").select(
        F.col("_id"), F.col("_best.c").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_row") == F.col("_best.d")).alias("kept"), "_sha"
    )
    return settled.unionByName(grouped).select(
        F.col("_id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast_ids: int = 500_000) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were, whatever their names.

    Which row stays is told by progressive_dedup; null and empty texts are one group of which one row stays, and long
    texts are compared whole. Where one id (or null) stands on several rows of which only some stay, those rows are told
    apart by their text; of rows alike in id and text the one with the most code points stays, then any. Ids with rows to
    drop are sent to all tasks up to broadcast_ids of them, and shuffled beyond that. An empty table stays empty.
    """
    found = checkpoint(progressive_dedup(docs, id_column, text_column))
    ids = found.groupBy(column(id_column).alias("_i")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("kept").cast("long")).alias("_k"))
    ids = checkpoint(ids.where("_k < _n"))
    own = docs[f"`{id_column}`"]
    drop = small(checkpoint(ids.select("_i")), broadcast_ids)
    whole = docs.join(drop, own.eqNullSafe(drop["_i"]), "left_anti")
    partly = checkpoint(ids.where("_k > 0").select("_i"))
    if partly.isEmpty():
        return whole
    partly = small(partly, broadcast_ids)
    mixed = docs.join(partly, own.eqNullSafe(partly["_i"]), "left_semi")
    mixed = mixed.select(F.struct(*columns(docs)).alias("row"), column(id_column).alias("_i"), F.sha2(normalised(text_of(text_column)), 256).alias("_s"), F.length(text_of(text_column)).alias("_cp"))
    gone = found.where(~F.col("kept") & ~F.col("keep_id").eqNullSafe(column(id_column))).select(column(id_column).alias("_gi"), F.col("text_sha256").alias("_gs"))
    mixed = mixed.join(gone, F.col("_i").eqNullSafe(F.col("_gi")) & (F.col("_s") == F.col("_gs")), "left_anti")
    mixed = mixed.groupBy("_i", "_s").agg(F.max_by("row", "_cp").alias("row")).select("row.*")
    return whole.unionByName(mixed)
