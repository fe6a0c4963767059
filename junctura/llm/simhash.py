"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link when they differ in at most ``max_bits``. Bits that go together are grouped into m
partitions; thresholds t_i with sum max_bits - m + 1 are allotted to the partitions by dynamic programming over
estimated candidate counts (-1 leaves a partition out). Any two fingerprints that link agree within t_i on some
partition i, so probing partition i with all keys at distance t_i or less finds them; each pair found is verified on
all bits. Only distinct fingerprints are compared: copies of a fingerprint share its group from the start.

A key under which more than ``bucket`` distinct fingerprints stand is not paired up. Its fingerprints go an exact way
whose work is linear (crowd_links): for two bits, each is filed under itself and every fingerprint one bit away, and two
that meet there differ in at most two bits; they are linked to the least of their key.

Near copies are dropped by near_texts: Jaccard similarity of sets of shingles, which fingerprints can only estimate. Sets
with close fingerprints are compared first; what these can't see is found by common shingles in the sets' prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, join_frequent, keep_rows, small, text_of

BITS = 64
_BLOCK = 1 << 16


def shingles(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles in their order, repeats included; none for a text without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a text of fewer words is one shingle. A shingle
    is hashed with XXH64.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    k, line = min(words, len(found)), b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A signed 64-bit number; a bit is set when it is set in over half the hashes, so 0 without any."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    return fingerprint_of(shingles(text, words, seed))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of their texts is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fingerprints(docs: DataFrame, id_column: str, text_column: str, words: int, seed: int = 42) -> DataFrame:
    """A row (id, fp) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(x, words, seed) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["_id", "_fp"])

    rows = docs.select(column(id_column).alias("_id"), text_of(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_column].dataType.simpleString()}, _fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set. 4096 sums reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), _BLOCK):
                total += (bits[at : at + _BLOCK].T @ bits[at : at + _BLOCK]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for row in fps.select("_fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row.cell] = row.n
    return out.reshape(BITS, BITS)


def partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m groups of like size; a group is grown by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m, 0, -1):
        width = -(-len(left) // k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def ball(bits: list[int], radius: int) -> list[int]:
    """All changes of at most radius of these bits, the empty one first."""
    out: list[tuple[int, ...]] = [()]
    for r in range(1, radius + 1):
        out += [c + (b,) for c in out if len(c) == r - 1 for b in bits if not c or b > c[-1]]
    return [mask(list(c)) for c in out]


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least cost and thresholds t_i >= -1 with that sum. costs[i][t + 1] is what partition i costs at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best[total]


def choose(n: int, k: int) -> int:
    """How many changes of at most k of n bits there are."""
    return sum(math.comb(n, i) for i in range(k + 1))


def plan(groups: DataFrame, n: int, max_bits: int, sizes: tuple[int, ...] | None = None) -> list[tuple[list[int], int]]:
    """(bits of a partition, its threshold) for the cheapest of some numbers of partitions, 2 to max_bits + 1 by default.

    The candidates of threshold 0 are counted over all fingerprints: the sum of the squares of the keys' counts. For
    higher ones that count is scaled by the ratio that independent bits of the measured frequencies would show.
    """
    both = bit_counts(groups)
    p = np.diag(both) / max(n, 1)
    choices = [partitions(both, n, m) for m in sizes or range(2, max_bits + 2) if m <= max_bits + 1]
    keyed = [F.struct(F.lit(f"{i}.{j}").alias("part"), F.col("_fp").bitwiseAND(F.lit(mask(g))).alias("key")) for i, c in enumerate(choices) for j, g in enumerate(c)]
    pairs = {
        r.part: float(r.pairs)
        for r in groups.select(F.inline(F.array(*keyed))).groupBy("part", "key").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).collect()
    }
    found = []
    for i, choice in enumerate(choices):
        costs = []
        for j, g in enumerate(choice):
            agree, row = [1.0], [0.0]
            for b in g:
                q = p[b] ** 2 + (1 - p[b]) ** 2
                agree = [q * x + (1 - q) * y for x, y in zip([*agree, 0], [0, *agree], strict=True)]
            for t in range(max_bits + 1):
                row.append(n * (1.0 + choose(len(g), t)) + pairs.get(f"{i}.{j}", 0.0) * sum(agree[: t + 1]) / max(agree[0], 1e-30))
            costs.append(row)
        found.append((*allot(costs, max_bits - len(choice) + 1), choice))
    _, thresholds, choice = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(choice, thresholds, strict=True) if t >= 0]


def even(bits: list[int], max_bits: int, m: int = 3) -> list[tuple[list[int], int]]:
    """The bits in m partitions dealt out in turn, with thresholds as even as the pigeonhole sum allows."""
    m = min(m, max_bits + 1)
    total = max_bits - m + 1
    return [(bits[i::m], total // m + (i < total % m)) for i in range(m)]


def changed(name: str, bits: list[int], radius: int, kept: list[int]) -> Column:
    """The array of all keys that a fingerprint's own key on the bits ``kept`` becomes by at most radius changes of ``bits``."""
    own = F.col(name).bitwiseAND(F.lit(mask(kept)))
    return F.transform(F.array(*[F.lit(x).cast("long") for x in ball(bits, radius)]), lambda x: own.bitwiseXOR(x))


def filed(rows: DataFrame, parts: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """(cell, part, _fp) of rows (cell, _fp): under a fingerprint's own key in each partition, or all keys that it probes."""
    one = lambda j, g, t: F.transform(changed("_fp", g, t if probing else 0, g), lambda k: F.struct(F.xxhash64("cell", F.lit(j), k).alias("cell"), F.lit(j).alias("part")))
    return rows.select("_fp", F.inline(F.concat(*[one(j, g, t) for j, (g, t) in enumerate(parts)])))


def sorted_out(entries: DataFrame, probes: DataFrame, exact: bool, max_bits: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs that link, entries and probes under cells of more than ``bucket`` entries). exact: probes are the entries."""
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    hot = checkpoint(sizes.where(F.col("n") > bucket).select("cell"))
    cold = checkpoint(sizes.where(F.col("n").between(2 if exact else 1, bucket)).select("cell"))
    left = probes.join(cold, "cell", "left_semi").select("cell", F.col("_fp").alias("u"))
    right = entries.join(cold, "cell", "left_semi").select("cell", F.col("_fp").alias("v"))
    # where probes reach other keys, of a pair the smaller may be the one that is filed under a crowded key
    once = F.col("u") > F.col("v") if exact else F.col("u") != F.col("v")
    met = left.join(right, "cell").where(once & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), entries.join(hot, "cell", "left_semi"), probes.join(hot, "cell", "left_semi")


def crowd_links(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (u, v) within max_bits that connect what is so linked in crowd (_fp), in work linear in the crowd.

    Each is filed under itself and all changes of at most half of max_bits, and looks under all changes of at most the
    other half: two that link meet under some key, and whoever meets one that is filed there is within max_bits of it.
    All under a key are linked to the least that is filed there.
    """
    low, every = max_bits // 2, list(range(BITS))
    places = lambda radius: crowd.select("_fp", F.explode(changed("_fp", every, radius, every)).alias("key"))
    seek = checkpoint(places(max_bits - low))
    centres = places(low).groupBy("key").agg(F.min("_fp").alias("v"))
    centres = checkpoint(seek.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(centres, "key"))
    return join_frequent(seek, centres, "key", "n").where("_fp <> v").select(F.greatest("_fp", "v").alias("u"), F.least("_fp", "v").alias("v"))


def links(groups: DataFrame, n: int, max_bits: int = 2, bucket: int = 48) -> DataFrame:
    """Pairs (u, v), u > v, of fingerprints with which the groups of linked fingerprints are those of all links.

    From three bits on, crowded keys are partitioned once more over the bits that they leave open; what is crowded still
    goes the way of crowd_links, which files choose(64, half of max_bits) keys for each fingerprint.
    """
    chosen = plan(groups, n, max_bits) if max_bits else []
    if not chosen:
        return groups.select(F.col("_fp").alias("u"), F.col("_fp").alias("v")).where(F.lit(False))
    rows = groups.select(F.lit(0).cast("long").alias("cell"), "_fp")
    exact = all(t == 0 for _, t in chosen)
    found, entries, probes = sorted_out(filed(rows, chosen, False), filed(rows, chosen, True), exact, max_bits, bucket)
    if max_bits > 2:
        parts = [even([b for b in range(BITS) if b not in g], max_bits) for g, _ in chosen]
        again = lambda df, probing: reduce(DataFrame.unionByName, [filed(df.where(F.col("part") == j), p, probing) for j, p in enumerate(parts)])
        entries, probes = checkpoint(entries), checkpoint(probes)
        more, entries, probes = sorted_out(again(entries, False), again(probes, True), False, max_bits, bucket)
        found = found.unionByName(more)
    crowd = checkpoint(probes.select("_fp").distinct())
    return (found if crowd.isEmpty() else found.unionByName(crowd_links(crowd, max_bits))).distinct()


def components(edges: DataFrame, rounds: int = 60, large_edges: int = 2_000_000) -> DataFrame:
    """(node, root) for each node of the edges (u, v); root is the least node that can be reached.

    Alternating large-star and small-star steps, each a grouped minimum and a join, until the edges form stars. Beyond
    large_edges, nodes with a large part of the edges, such as centres of stars, are joined by themselves; a task can
    hold fewer edges than that, whosever they are.
    """
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before: tuple | None = None
    for _ in range(rounds):
        n = edges.count()
        if not n:
            break
        met = (lambda rows, table: join_frequent(checkpoint(rows), checkpoint(table), "u", "n")) if n > large_edges else (lambda rows, table: rows.join(table, "u"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = met(both, least).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        edges = checkpoint(met(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, max_bits: int = 2, bucket: int = 48) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the smallest id reachable over links, the row's own included; null ids are passed over, and a group
    of nothing but null ids gets null. Null and empty texts and texts without words have fingerprint zero and link like
    any other; long texts are read whole. Repeated rows share their group. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    fps = checkpoint(fingerprints(docs, id_column, text_column, words))
    groups = checkpoint(fps.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    found = components(links(groups, groups.count(), max_bits, bucket))
    rooted = groups.join(found, groups["_fp"] == found["node"], "left").select("_fp", "_least", "_n", F.coalesce("root", "_fp").alias("_root"))
    label = checkpoint(labelled(checkpoint(rooted)))
    return join_frequent(fps, label, "_fp", "_n").select(F.col("_id").alias(id_column), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(rooted: DataFrame) -> DataFrame:
    """(_fp, _n, component_id) of rooted (_fp, _n, _least, _root): the least id of all that have the root."""
    named = checkpoint(rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_c")))
    return join_frequent(rooted, named, "_root", "_c").select("_fp", "_n", "component_id")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order, as signed numbers."""
    return np.unique(shingles(text, words).view(np.int64))


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit number that stands for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes))).view(np.int64))


def shingle_sets(docs: DataFrame, text_column: str, words: int) -> DataFrame:
    """A row (_fp, _set) for each row of docs: the set's name and its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(x, words) for x in batch.column(0).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(h) for h in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([pa.array([set_name(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["_fp", "_set"])

    return docs.select(text_of(text_column).alias("_text")).mapInArrow(run, "_fp long, _set array<long>")


def common_shingles(docs: DataFrame, text_column: str, words: int, rows: int = 20_000, most: int = 1 << 16) -> np.ndarray:
    """Hashes that stand in several documents of a sample, rarest first.

    They only order the shingles, so that rare ones are looked up. Any order finds the same pairs.
    """
    total = docs.count()
    part = docs.sample(rows / total, seed=7) if total > rows else docs
    counts = shingle_sets(part, text_column, words).select(F.explode("_set").alias("h")).groupBy("h").count().where("count > 2")
    return np.array([r.h for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()][::-1], np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of some buckets, a byte each; empty if a byte is too small.

    The sum of the smaller counts of two sets' buckets is no less than what the sets have in common. There are about as
    many buckets as a quarter of the set, so that strangers of like size stay well below what similar sets have.
    """
    size = 1 << max(4, min(12, (max(len(hashes), 1) // 4).bit_length()))
    counts = np.bincount(hashes & (size - 1), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 255 else b""


def common_at_most(a: bytes, b: bytes) -> int:
    """What two sets can have in common by their sketches."""
    if not a or not b:
        return 1 << 40
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    while len(x) != len(y):
        x, y = (v.reshape(2, -1).sum(0) if len(v) > min(len(x), len(y)) else v for v in (x, y))
    return int(np.minimum(x, y).sum())


def minima(hashes: np.ndarray, parts: int = 6) -> np.ndarray:
    """The least hash of each part of a set, parts by hash, with the part worked in: similar sets share most of them."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed, mixed % np.uint64(parts)))
    part = (mixed % np.uint64(parts))[order]
    first = np.concatenate(([True], part[1:] != part[:-1]))
    return mixed[order][first].view(np.int64)


def prefixes(docs: DataFrame, id_column: str, text_column: str, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(_id, _fp, _sim, _n, _sketch, _mins, _prefix): the set's name, fingerprint, size, sketch, minima and first shingles in the order of common_shingles.

    Two sets of at least this similarity have a shingle in both prefixes, of |set| - ceil(similarity |set|) + 1 each.
    """
    order = np.argsort(common)
    names = common[order]

    def prefix(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        rank = np.zeros(len(h), np.int64)
        if len(names):
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            rank = np.where(names[at] == h, order[at] + 1, 0)
        return h[np.lexsort((h, rank))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(x, words) for x in batch.column(1).to_pylist()]
            numbers = [pa.array([f(h) for h in sets], pa.int64()) for f in (set_name, lambda h: fingerprint_of(h.view(np.uint64)), len)]
            lists = [pa.array([f(h) for h in sets], pa.list_(pa.int64())) for f in (minima, prefix)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(map(sketch, sets), pa.binary()), *lists], names=["_id", "_fp", "_sim", "_n", "_sketch", "_mins", "_prefix"])

    rows = docs.select(column(id_column).alias("_id"), text_of(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_column].dataType.simpleString()}, _fp long, _sim long, _n long, _sketch binary, _mins array<long>, _prefix array<long>")


def possible(pairs: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (_fp, _n, _sketch) may have at least this similarity by their sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m, a, b = (c.to_pylist() for c in batch.columns)
            keep = [common_at_most(x, y) >= similarity / (1 + similarity) * (k + j) - 1e-6 for k, j, x, y in zip(n, m, a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one, two = (groups.select(F.col("_fp").alias(x), F.col("_n").alias(f"_n{x}"), F.col("_sketch").alias(f"_s{x}")) for x in "uv")
    met = pairs.join(one, "u").join(two, "v").where(F.least("_nu", "_nv") >= similarity * F.greatest("_nu", "_nv") - 1e-9)
    return met.select("u", "v", "_nu", "_nv", "_su", "_sv").mapInArrow(run, "u long, v long")


def similar(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_column: str, text_column: str, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of sets with at least this similarity, whose shingles are read again from a document of each."""
    named = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("_fp")).distinct())
    ids = rows.join(small(named, 500_000), "_fp", "left_semi").groupBy("_fp").agg(F.min("_id").alias("_mid")).select("_mid").distinct()
    ids = small(checkpoint(ids), 500_000)
    again = docs.join(ids, docs[f"`{id_column}`"].eqNullSafe(ids["_mid"]), "left_semi")
    sets = shingle_sets(again, text_column, words).join(small(named, 500_000), "_fp", "left_semi")
    sets = checkpoint(sets.groupBy("_fp").agg(F.first("_set").alias("_set")))
    a, b = (sets.select(F.col("_fp").alias(x), F.col("_set").alias(f"_{x}")) for x in "uv")
    both = F.size(F.array_intersect("_u", "_v")).cast("double")
    return pairs.join(a, "u").join(b, "v").where(both >= similarity * (F.size("_u") + F.size("_v") - both) - 1e-9).select("u", "v")


def close_sets(sets: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """Pairs (u, v) of sets (_fp, _sim) that links() and equal fingerprints suggest: candidates, to be compared in full."""
    groups = checkpoint(sets.groupBy("_sim").agg(F.min("_fp").alias("_rep"), F.count(F.lit(1)).alias("_c")))
    same = join_frequent(sets, groups, "_sim", "_c").where("_fp <> _rep").select(F.col("_fp").alias("u"), F.col("_rep").alias("v"))
    met = links(groups.select(F.col("_sim").alias("_fp")), groups.count(), max_bits, bucket)
    one, two = (groups.select(F.col("_sim").alias(x), F.col("_rep").alias(f"_{x}")) for x in "uv")
    return same.unionByName(met.join(one, "u").join(two, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def near_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8,
    max_bits: int = 2, bucket: int = 48, pairs_a_set: int = 64, rounds: int = 5, crowd: int = 32,
) -> DataFrame:
    """One row per row of docs: id, component_id as in near_duplicates, where texts link from this Jaccard similarity on.

    Shingles are compared as sets. First, sets whose fingerprints differ in at most max_bits are compared in full. That
    finds copies of which little differs; a fingerprint of 64 bits can't tell a similarity of 0.8 (about ten bits) from
    strangers at a bearable number of candidates, so links beyond max_bits come from another way, and none is missed.

    Sets that are similar enough share a shingle of their prefixes, early enough in both (shared_keys). Those that meet so
    under a shingle of at most ``crowd`` sets are compared. Of a shingle that more sets have, each set is first compared with
    the one that has it earliest, and then only sets that aren't connected yet. Where that is more than ``pairs_a_set``
    pairs for each set, they are connected before, in rounds of work linear in the crowd: the sets that share one of their
    minima, then those that share a shingle, are compared with one of their own, another in each round, as long as a round
    spares a fifth of the pairs. What is left is compared, however much it is: rounds are a choice of the way, and the
    links are the same with none.

    Null and empty texts and texts without words are one set, and a group; repeated rows share their group. Of equal ids the
    least counts as any. Null ids, other columns and empty tables are treated as in near_duplicates. Long texts are
    compared whole.
    """
    common = common_shingles(docs, text_column, words)
    rows = checkpoint(prefixes(docs, id_column, text_column, words, similarity, common))
    groups = checkpoint(rows.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    sets = distinct_sets(rows, groups)
    entries = shared_keys(sets, similarity)
    members = checkpoint(entries.select("_fp").distinct())
    parts = checkpoint(sets.join(small(members, 500_000), "_fp", "left_semi").select("_fp", "_sim", "_n", "_sketch", "_mins"))
    true_pairs = lambda pairs: similar(checkpoint(possible(pairs.distinct(), parts, similarity)), docs, rows, id_column, text_column, words, similarity)

    few, live = entries.where(F.col("_k") <= crowd), checkpoint(entries.where(F.col("_k") > crowd))
    pairs = close_sets(parts.select("_fp", "_sim"), max_bits, bucket).unionByName(_all_pairs(few, similarity))
    edges = checkpoint(true_pairs(pairs.unionByName(_hub_pairs(live, similarity, 0)) if rounds else pairs))
    roots = _roots(members, edges)
    bound, turn, minimal = pairs_a_set * members.count(), 0, None
    live, work = _unconnected(live, roots)
    for by_minima in (True, False):
        before = None
        while work > bound and turn < rounds and (before is None or work < 0.8 * before):
            before, turn = work, turn + 1
            if by_minima:
                if minimal is None:
                    minimal = parts.join(live.select("_fp").distinct(), "_fp", "left_semi").select("_fp", "_n", F.explode("_mins").alias("_key"))
                minimal = _unconnected(minimal, roots)[0]
            edges = checkpoint(edges.unionByName(true_pairs(_hub_pairs(minimal if by_minima else live, similarity, turn))))
            roots = _roots(members, edges)
            # keys that are of one root stay so: what was left before is all that can be left
            live, work = _unconnected(live, roots)
    if work:
        edges = checkpoint(edges.unionByName(true_pairs(_all_pairs(live, similarity))))
        roots = _roots(members, edges)

    rooted = groups.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    label = checkpoint(labelled(checkpoint(rooted)))
    return join_frequent(rows.select("_id", "_fp"), label, "_fp", "_n").select(F.col("_id").alias(id_column), "component_id")


def shared_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(_fp, _n, _at, _key, _k) of the prefixes of sets by which two similar ones can meet; _k sets have the key in theirs.

    What two sets have in common stands at or after their first common shingle. So the smaller has this among its first
    |set| - ceil(2 s / (1 + s) |set|) + 1, and each has it early enough for a partner of the least size that there is.
    """
    entries = sets.select("_fp", "_n", F.posexplode("_prefix").alias("_at", "_key"))
    least = lambda size: F.ceil(similarity / (1 + similarity) * size - 1e-9)
    early = F.when(F.col("_n") - F.col("_at") >= least(2 * F.col("_n")), F.col("_n"))
    shared = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("_k"), F.min(early).alias("_m")).where("_k > 1 AND _m IS NOT NULL")
    met = entries.join(small(checkpoint(shared), 500_000), "_key")
    return checkpoint(met.where(F.col("_n") - F.col("_at") >= least(F.col("_n") + F.greatest(F.col("_m"), similarity * F.col("_n")))).drop("_m"))


def _unconnected(entries: DataFrame, roots: DataFrame) -> tuple[DataFrame, float]:
    """entries with _root, those under keys of several roots, and how many pairs of unlike roots they make."""
    live = entries.drop("_root").join(roots, "_fp")
    crowd = live.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("c")).groupBy("_key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).where("s * s > q")
    crowd = checkpoint(crowd.select("_key", ((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2).alias("_w")))
    return checkpoint(live.join(crowd.select("_key"), "_key", "left_semi")), crowd.agg(F.coalesce(F.sum("_w"), F.lit(0.0))).first()[0]


def distinct_sets(rows: DataFrame, groups: DataFrame, broadcast_sets: int = 500_000) -> DataFrame:
    """rows with one row for each _fp; only those of sets that groups (_fp, _n) counts several times are shuffled."""
    several = small(checkpoint(groups.where("_n > 1").select("_fp")), broadcast_sets)
    rest = [F.first(c).alias(c) for c in rows.columns if c != "_fp"]
    return rows.join(several, "_fp", "left_anti").unionByName(rows.join(several, "_fp", "left_semi").groupBy("_fp").agg(*rest))


def _roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges)
    return checkpoint(members.join(found, members["_fp"] == found["node"], "left").select("_fp", F.coalesce("root", "_fp").alias("_root")))


def _apart(live: DataFrame, one: str, other: str) -> Column:
    """That two rows of live have unlike roots; any two where it has none."""
    return F.col(f"{one}_root") != F.col(f"{other}_root") if "_root" in live.columns else F.lit(True)


def _all_pairs(live: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of live (_key, _fp, _n, _at) under one key that aren't connected by _root and may be similar enough."""
    a, b = (live.select(*[F.col(c).alias(f"{x}{c}") for c in live.columns]) for x in "ab")
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_fp") < F.col("b_fp")))
    # from the first common place on, enough must be left of both sets
    need = F.ceil(similarity / (1 + similarity) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    cond = (F.col("a_key") == F.col("b_key")) & _apart(live, "a", "b") & smaller
    return a.join(b, cond & (F.col("a_n") >= similarity * F.col("b_n") - 1e-9) & (room >= need)).select(F.col("a_fp").alias("u"), F.col("b_fp").alias("v"))


def _hub_pairs(live: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (u, v) of each set with the one under its key that this turn's hash makes the least.

    In turn 0 that is the one with the key at the first place: as rare shingles come first, it has the least of its own.
    """
    order = F.xxhash64("_fp", F.pmod(F.col("_key"), F.lit(16)), F.lit(turn)) if turn else F.col("_at").cast("long")
    draw = F.struct(order.alias("h"), *[c for c in ("_fp", "_n", "_root") if c in live.columns])
    hub = checkpoint(live.groupBy("_key").agg(F.min(draw).alias("_hub"), F.count(F.lit(1)).alias("_c")))
    near = (F.least("_n", "_hub._n") >= similarity * F.greatest("_n", "_hub._n") - 1e-9) & _apart(live, "", "_hub.")
    return join_frequent(live, hub, "_key", "_c").where(near & (F.col("_fp") != F.col("_hub._fp"))).select(F.col("_hub._fp").alias("u"), F.col("_fp").alias("v"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near_texts, that with the smallest id; rows that share this id stay together.

    Columns stay as they are, whatever their names. Rows without an id stay. Null and empty texts are one group, long
    texts are compared whole, and an empty table stays empty.
    """
    found = checkpoint(near_texts(docs, id_column, text_column, words, similarity))
    kept = column(id_column).eqNullSafe(F.col("component_id")) | column(id_column).isNull()
    return keep_rows(docs, found.select(column(id_column).alias(id_column), kept.alias("kept")), id_column)
