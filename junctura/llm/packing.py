"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily with the longest pieces that still fit; then its smallest piece is replaced by two unpacked
ones if these fill the gap so expanded more tightly. Pieces of one length are alike, so the bins are found on the
histogram of lengths, which has at most ``capacity`` entries whatever the input; a bin that can be repeated is repeated
as often as its lengths last, just as the same steps one bin at a time would do. The pieces then take the places made
for their length by their rank among the pieces of this length, which is counted in salted parts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm.common import checkpoint, column, text_of

#: Texts that tiktoken isn't trusted with: letters whose class depends on the version of Unicode, and parts without a
#: break, or breaks, that are so long that its merging is slow. The tokenizers library encodes these.
_ODD = re.compile(r"[^\x00-\u04ff\u2010-\u2027\u2030-\u205e\u20ac]|\S{1000}|\s{1000}")


def byte_of_letters() -> dict[str, int]:
    """How vocabularies of byte-level BPE write bytes: printable ones as themselves, others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Text to token ids, as bytes of little-endian unsigned 32-bit numbers, then the end's id.

    The ids are those of the tokenizers library with the tokenizer as its file has it. In this kind of vocabulary an id is
    the rank of its merge, so tiktoken, which is several times as fast, gives the same ids from the same file; it gets all
    but the odd texts and those in which a token of the tokenizer's own, such as an end mark, is written out.
    """

    #: Fixed value: how byte-level BPE splits a text.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        letters = byte_of_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([end], "<u4").tobytes()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            odd = _ODD.search(text) or self.special and self.special.search(text)
            ids = self.whole(text) if odd else self.fast.encode_ordinary(text)
            yield np.array(ids, "<u4").tobytes() + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One for each worker process."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of the capacity, only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each document; with keep_ids also ids, the tokens."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end).encode
        for batch in batches:
            rows, out, ids = [], [], []
            for row, data in enumerate(encode(batch.column(1).to_pylist())):
                for piece, (start, n) in enumerate(cuts(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + n)]
                    rows.append(row)
                    out.append((piece, start, n, zlib.crc32(part)))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names=schema.names)

    return docs.select(column(id_column).alias("_id"), text_of(text_column).alias("_text")).mapInArrow(run, schema)


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, the lengths in the bin) for each kind of bin, in the order in which they are filled."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []

    def below(counts: np.ndarray) -> np.ndarray:
        """For each g the greatest length of at most g that is left, 0 for none."""
        return np.maximum.accumulate(np.where(counts > 0, np.arange(capacity + 1), 0))

    while left.any():
        now, used, gap = left.copy(), [], capacity
        fits = below(now)
        while gap and (x := int(fits[gap])):
            k = min(gap // x, int(now[x]))
            used += [x] * k
            now[x] -= k
            gap -= x * k
            if not now[x]:
                fits = below(now)
        need = np.bincount(used, minlength=capacity + 1)
        if gap and len(used) > 1:
            small = used[-1]
            room = gap + small
            lengths = np.flatnonzero(now[: room + 1])
            if len(lengths):
                one = np.where(now > 1, np.arange(capacity + 1), 0)
                pair = fits[room - lengths]
                clash = (pair == lengths) & (one[lengths] == 0)  # the only one of this length cannot go twice
                other = np.array([int(below(np.where(np.arange(capacity + 1) == x, 0, now))[room - x]) if c else int(p) for x, p, c in zip(lengths, pair, clash, strict=True)])
                total = np.where(other > 0, lengths + other, 0)
                best = int(total.argmax())
                if total[best] > small:
                    need[lengths[best]] += 1
                    need[other[best]] += 1
                    used = [*used[:-1], *sorted((int(lengths[best]), int(other[best])), reverse=True)]
        final = np.bincount(used, minlength=capacity + 1)
        times = 1 + int(min((left[x] - need[x]) // final[x] for x in np.flatnonzero(final)))
        left -= times * final
        out.append((times, used))
    return out


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the ranks at which runs of places begin, and each run's first bin, places in a bin, offsets."""
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, used in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in used:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, where in offsets.items():
            runs.setdefault(x, []).append((ranks.get(x, 0), base, len(where), where))
            ranks[x] = ranks.get(x, 0) + times * len(where)
        base += times
    out = {}
    for x, rows in runs.items():
        first, bin0, each, where = zip(*rows, strict=True)
        starts = np.concatenate(([0], np.cumsum(each)[:-1]))
        out[x] = (np.array(first, np.int64), np.array(bin0, np.int64), np.array(each, np.int64), starts.astype(np.int64), np.concatenate([np.array(w, np.int64) for w in where]))
    return out


def place(rows: DataFrame, capacity: int = 1024, share: int | None = None) -> DataFrame:
    """rows (with a column length, 1 to capacity) with sequence_id and offset.

    Rows of one length are ranked in parts of about ``share`` rows, by default a thousandth of all, 500 at least and
    100,000 at most, chosen by a hash of the row: each part counts by itself and starts where the parts before it end.
    Rows alike in all columns may stand for each other.
    """
    cols = rows.columns
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity entries at most
    share = share or min(100_000, max(500, sum(counts.values()) // 1000))
    salts = max(1, -(-max(counts.values(), default=1) // share))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(_window("length", "_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), before.alias("_before"))
    rank = F.row_number().over(_window(["length", "_salt"], cols)) - 1
    ranked = salted.withColumn("_rank", rank).join(parts, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.select(*cols, (F.col("_rank") + F.col("_before")).alias("_rank"))
    table = rows.sparkSession.sparkContext.broadcast(places(best_two_fit(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def settle(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for x in np.unique(n):
            first, bin0, each, starts, where = table.value[int(x)]
            own = np.flatnonzero(n == x)
            run = np.searchsorted(first, r[own], side="right") - 1
            k = r[own] - first[run]
            seq[own] = bin0[run] + k // each[run]
            off[own] = where[starts[run] + k % each[run]]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_at", settle("length", "_rank")).select(*cols, "_at.sequence_id", "_at.offset")


def _window(by, order):
    return Window.partitionBy(by).orderBy(order)


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs gives at least one piece, as the end's id follows each text; null texts count as empty, and long
    ones are cut into pieces of the capacity. Repeated rows are packed each for itself. Null ids stay null. Other columns
    are not read, whatever their names. An empty table gives no pieces.
    """
    rows = checkpoint(pieces(docs, tokenizer, id_column, text_column, capacity, end))
    return place(rows, capacity).withColumnRenamed("_id", id_column)


def sequences(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most capacity tokens), doc_ids and lengths in their order."""
    rows = place(checkpoint(pieces(docs, tokenizer, id_column, text_column, capacity, end)), capacity)
    ids = pieces(docs, tokenizer, id_column, text_column, capacity, end, keep_ids=True).dropDuplicates(["_id", "piece", "ids_crc32", "length"])
    same = [rows["_id"].eqNullSafe(ids["_id"]), rows["piece"] == ids["piece"], rows["ids_crc32"] == ids["ids_crc32"], rows["length"] == ids["length"]]
    whole = rows.join(ids, same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", rows["_id"].alias("doc"), rows["length"].alias("n"), "ids"))).alias("s"))
    return whole.select("sequence_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"), F.transform("s", lambda x: x["doc"]).alias("doc_ids"), F.transform("s", lambda x: x["n"]).alias("lengths"))
