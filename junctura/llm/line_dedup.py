"""Lines that many documents share are dropped from all but one, by a sharded minimal perfect hash over line hashes.

Lines are hashed where they lie and counted by hash; no line is shuffled. The distinct hashes of frequent lines go into
shards, each a minimal perfect hash that numbers its keys 0 to n - 1 and arrays that are indexed by this number: a
fingerprint of 64 bits, the count of documents, and the document that keeps the line. Documents look their lines up in
the arrays: hash, slot, and a comparison of fingerprints, which tells lines that aren't in the shard.

The most frequent lines' shards go to all tasks, at most ``broadcast_lines`` of them whatever the corpus. Where there are
more, the others' shards stay on the executors, and documents' hashes (not their lines) are sent to them; as no rare line
holds a large part of all hashes, no shard gets one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, columns, small, text_of

#: White space that is stripped from a line's ends.
BLANK = b" \t\n\x0b\x0c\r"
#: Bits that a level of a perfect hash has for each key that it is to place.
_SPARE = 2
_LEVELS = 64


def line_key(line: bytes) -> bytes:
    """What lines are compared by: without white space at the ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def long_keys(lines: list[bytes], least_chars: int) -> tuple[list[int], np.ndarray]:
    """The places of lines whose keys have at least least_chars code points, and the keys' hashes (n, 2): key and fingerprint."""
    at, hashes = [], bytearray()
    for i, line in enumerate(lines):
        if len(line) < least_chars:
            continue
        key = line_key(line)
        if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
            at.append(i)
            hashes += xxhash.xxh3_128_digest(key)
    return at, np.frombuffer(bytes(hashes), "<u8").reshape(-1, 2)


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where a level puts keys: a multiplicative mix of key and level, modulo the level's bits."""
    with np.errstate(over="ignore"):
        x = (keys ^ np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, a bit set where one key alone was put.

    A key's slot is the number of bits set before its own, over all levels in turn. Keys that share a bit go on to the next
    level, so about three bits a key are kept. Keys that it wasn't made of get any slot, or -1.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], keys
        while len(left):
            if len(levels) == _LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            bits = max(64, _SPARE * len(left))
            at = _place(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            taken = np.zeros(bits, bool)
            taken[at[alone]] = True
            levels.append(np.packbits(taken))
            sizes.append(bits)
            left = left[~alone]
        return cls(levels, sizes)

    @cached_property
    def _ranks(self) -> list[np.ndarray]:
        """For each level the number of bits set before each of its bytes, all earlier levels included."""
        out, before = [], 0
        for level in self.levels:
            ends = before + np.cumsum(np.bitwise_count(level), dtype=np.int64)
            out.append(np.concatenate(([before], ends[:-1])))
            before = int(ends[-1])
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (level, rank, size) in enumerate(zip(self.levels, self._ranks, self.sizes, strict=True)):
            at = _place(keys[todo], k, size)
            byte, bit = at >> 3, at & 7
            there = (level[byte] >> (7 - bit)) & 1 == 1
            before = np.bitwise_count(level[byte[there]].astype(np.int64) >> (8 - bit[there]))
            out[todo[there]] = rank[byte[there]] + before
            todo = todo[~there]
            if not len(todo):
                break
        return out


class Shard:
    """A perfect hash and the arrays that it indexes."""

    def __init__(self, levels: list[bytes], sizes: list[int], arrays: bytes):
        table = pa.ipc.open_stream(arrays).read_all().combine_chunks()
        self.index = PerfectHash([np.frombuffer(x, np.uint8) for x in levels], sizes)
        self.fingerprints, self.counts = (table.column(c).to_numpy() for c in ("fingerprint", "count"))
        self.keepers = table.column("keeper").combine_chunks()

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """For each (key, fingerprint) its slot, or -1 where the line is none of the shard's."""
        slot = self.index.slots(hashes[:, 0])
        hit = slot >= 0
        hit[hit] = self.fingerprints[slot[hit]] == hashes[hit, 1]
        return np.where(hit, slot, -1)


def built(keys: pa.Table) -> pa.Table:
    """A shard of a table (_shard, _h, _f, _docs, _keeper): one row (shard, levels, sizes, arrays)."""
    h = keys.column("_h").to_numpy().view(np.uint64)
    # two lines with one key hash and different fingerprints (in 2^64) share no slot: the later ones are found by none
    _, first = np.unique(h, return_index=True)
    keys, h = keys.take(pa.array(first)), h[first]
    index = PerfectHash.of(h)
    slot = index.slots(h)
    order = np.argsort(slot)
    arrays = pa.table({
        "fingerprint": pa.array(keys.column("_f").to_numpy().view(np.uint64)[order]),
        "count": pa.array(keys.column("_docs").to_numpy()[order].astype(np.uint32)),
        "keeper": keys.column("_keeper").combine_chunks().take(pa.array(order)),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrays.schema) as out:
        out.write_table(arrays.combine_chunks())
    return pa.table({
        "shard": pa.array([keys.column("_shard")[0].as_py()], pa.int64()), "levels": pa.array([[x.tobytes() for x in index.levels]], pa.list_(pa.binary())),
        "sizes": pa.array([index.sizes], pa.list_(pa.int64())), "arrays": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
    })


SHARD = "shard long, levels array<binary>, sizes array<long>, arrays binary"


def frequent_lines(docs: DataFrame, id_column: str, text_column: str, least_chars: int, least_docs: int) -> DataFrame:
    """(_h, _f, _docs, _keeper): the hashes of lines in at least least_docs rows, and the largest id that has each."""
    kind = docs.select(column(id_column).alias("_id")).schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                _, found = long_keys(text.encode("utf-8", "surrogatepass").split(b"\n"), least_chars)
                found = np.unique(found, axis=0) if len(found) > 1 else found
                parts.append(found)
                rows.append(np.full(len(found), i))
            both = np.concatenate([np.zeros((0, 2), np.uint64), *parts])
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64))
            h, f = (pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([h, f, batch.column(0).take(at)], names=["_h", "_f", "_id"])

    lines = docs.select(column(id_column).alias("_id"), text_of(text_column).alias("_text")).mapInArrow(run, f"_h long, _f long, _id {kind}")
    return lines.groupBy("_h", "_f").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper")).where(F.col("_docs") >= least_docs)


def shards(lines: DataFrame, total: int, shard_lines: int) -> DataFrame:
    """A row (SHARD) for each shard of frequent lines; a shard has about shard_lines of them."""
    n = max(1, -(-total // shard_lines))
    return lines.withColumn("_shard", F.pmod(F.col("_h"), F.lit(n)).cast("long")).groupBy("_shard").applyInArrow(built, SHARD)


def dropped_by(found: dict[int, Shard], n: int, hashes: np.ndarray, owner: pa.Array) -> np.ndarray:
    """Which of the lines (hashes; owner: their documents' ids) go by these shards of n."""
    out = np.zeros(len(hashes), bool)
    of = np.mod(np.ascontiguousarray(hashes[:, 0]).view(np.int64), n)
    for k in np.unique(of):
        if (shard := found.get(int(k))) is None:
            continue
        here = np.flatnonzero(of == k)
        slot = shard.probe(hashes[here])
        here, slot = here[slot >= 0], slot[slot >= 0]
        mine, keeper = owner.take(pa.array(here)), shard.keepers.take(pa.array(slot))
        same = pc.fill_null(pc.equal(mine, keeper), False).to_numpy(zero_copy_only=False)
        none = pc.and_(pc.is_null(mine), pc.is_null(keeper)).to_numpy(zero_copy_only=False)
        out[here] = ~(same | none)
    return out


def routed(docs: DataFrame, lines: DataFrame, total: int, id_column: str, text_column: str, least_chars: int, shard_lines: int) -> DataFrame:
    """(_of, _hashes): for documents by the hash of their id and text the key hashes of those lines that go by ``lines``.

    Documents' hashes are sent to the task that has the shard, which reads its arrays first and then hash after hash.
    """
    n = max(1, -(-total // shard_lines))
    kind = docs.select(column(id_column).alias("_id")).schema["_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                _, found = long_keys(text.encode("utf-8", "surrogatepass").split(b"\n"), least_chars)
                if len(found):
                    at = pa.array(np.full(len(found), i))
                    h, f = (pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), h, f], names=["_of", "_id", "_h", "_f"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, k = None, -1
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
                part = batch.slice(int(cut[0]), len(cut)) if len(cut) else batch.slice(0, 0)
                if not part.num_rows:
                    continue
                if part.column("arrays")[0].is_valid:
                    k = part.column(0)[0].as_py()
                    shard, part = Shard(**part.slice(0, 1).select(["levels", "sizes", "arrays"]).to_pylist()[0]), part.slice(1)
                if shard is None or not part.num_rows or part.column(0)[0].as_py() != k:
                    continue
                h = np.stack([part.column(x).to_numpy().view(np.uint64) for x in ("_h", "_f")], axis=1)
                gone = dropped_by({k: shard}, n, h, part.column("_id"))
                yield part.select(["_of", "_h"]).filter(pa.array(gone))

    rows = docs.select(column(id_column).alias("_id"), text_of(text_column).alias("_text"))
    probes = rows.select("_id", "_text", F.xxhash64(F.col("_id"), "_text").alias("_of")).mapInArrow(hashes, f"_of long, _id {kind}, _h long, _f long")
    arrays = shards(lines, total, shard_lines)
    both = arrays.unionByName(probes.select(F.pmod(F.col("_h"), F.lit(n)).cast("long").alias("shard"), "_of", "_id", "_h", "_f"), allowMissingColumns=True)
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("arrays").isNull())
    gone = dealt.mapInArrow(look_up, "_of long, _h long")
    return gone.groupBy("_of").agg(F.collect_set("_h").alias("_hashes"))


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = 40,
    least_docs: int = 5,
    broadcast_lines: int = 2_000_000,
    shard_lines: int = 1 << 16,
) -> DataFrame:
    """docs with two columns more, n_lines and n_dropped, and the text without lines that many documents share.

    A text is split at line feeds (null and empty: one empty line). Lines whose keys (white space stripped at both ends, A-Z
    lower-cased) have at least least_chars code points and are in at least least_docs rows go everywhere but in the rows
    with the largest id that has them; a null id is smaller than any. Other lines stay, joined by line feeds; a text of which
    nothing is left is empty, and so is a null one. A line that stands several times in a row counts once, and goes or
    stays as often as it stands. Repeated rows are documents of their own and keep or lose the same lines. Long texts are
    read whole. Columns of docs named n_lines or n_dropped are replaced, others stay, whatever their names. An empty table
    stays empty.

    At most broadcast_lines lines' arrays (20 bytes each for a long id) go to all tasks, the most frequent ones; see the
    module for the rest.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    lines = checkpoint(frequent_lines(docs, id_column, text_column, least_chars, least_docs))
    total = lines.count()
    hot, rest = lines, None
    if total > broadcast_lines:
        # the least count with which no more than broadcast_lines lines are left
        by_count = lines.groupBy("_docs").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_docs"))
        level, sum_n = None, 0
        for r in by_count.limit(broadcast_lines + 1).toLocalIterator():
            sum_n += r["n"]
            if sum_n > broadcast_lines:
                break
            level = r["_docs"]
        hot = lines.where(F.col("_docs") >= level) if level is not None else lines.where(F.lit(False))
        rest = lines.where(F.col("_docs") < level) if level is not None else lines
    n_hot = hot.count()
    n = max(1, -(-n_hot // shard_lines))
    sent = spark.sparkContext.broadcast({r["shard"]: {k: r[k] for k in ("levels", "sizes", "arrays")} for r in shards(hot, n_hot, shard_lines).collect()})
    opened: dict[int, Shard] = {}

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def cleaned(ids: pa.Array, texts: pa.Array, known: pa.Array) -> pa.Array:
        if not opened:
            opened.update({k: Shard(**row) for k, row in sent.value.items()})
        out, n_lines, n_dropped, spots, parts = [], [], [], [], []
        rows = [x.encode("utf-8", "surrogatepass").split(b"\n") for x in texts.to_pylist()]
        for row in rows:
            at, found = long_keys(row, least_chars)
            spots.append(at)
            parts.append(found)
        both = np.concatenate([np.zeros((0, 2), np.uint64), *parts])
        owner = ids.take(pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in spots])))
        gone, low = dropped_by(opened, n, both, owner), 0
        for row, at, found, more in zip(rows, spots, parts, known.to_pylist(), strict=True):
            drop = gone[low : low + len(at)]
            low += len(at)
            if more:
                drop = drop | np.isin(np.ascontiguousarray(found[:, 0]).view(np.int64), more)
            lost = {i for i, x in zip(at, drop, strict=True) if x}
            out.append(b"\n".join(x for i, x in enumerate(row) if i not in lost).decode("utf-8", "surrogatepass"))
            n_lines.append(len(row))
            n_dropped.append(len(lost))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    row = F.struct(*columns(docs)).alias("_row")
    rows = docs.select(row, column(id_column).alias("_id"), text_of(text_column).alias("_text"))
    if rest is None:
        rows = rows.withColumn("_hashes", F.lit(None).cast("array<long>"))
    else:
        more = checkpoint(routed(docs, rest, total - n_hot, id_column, text_column, least_chars, shard_lines))
        rows = rows.withColumn("_of", F.xxhash64("_id", "_text")).join(small(more, 100_000), "_of", "left")
    done = rows.select("_row", cleaned("_id", "_text", "_hashes").alias("_new"))
    same = [F.col("_row").getField(c).alias(c) if c != text_column else F.col("_new.text").alias(c) for c in docs.columns]
    return done.select(*same, "_new.n_lines", "_new.n_dropped")
