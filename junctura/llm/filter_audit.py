"""How filters interact: what each removes, alone and in every order, by fingerprint-routed texts and counts of masks.

A row's failures are a mask of bits. Whether its text stands under a smaller id is told by routing: rows are dealt out by
the XXH64 of their texts, and each part keeps a chain of (text, smallest id so far) for a fingerprint, so equal
fingerprints of different texts never mix. A row is sent on as a copy as soon as a smaller id is known, and what holds the
smallest ids at the end is sent on as first. The same is done within a part of the input before anything is shuffled,
so of a text that a third of all rows have a part sends few.

Masks are then counted by combineByKey in vectors, one for each part of the result; all orders are read off these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, text_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
#: Filters by mask, and the three counts of each mask: rows, good rows, toxic rows.
_MASKS = 1 << len(FILTERS)
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str, raw: bytes) -> int:
    """The mask of A (under 200 words), B (under half of the words distinct), C (over 3 % capitals), D (marks)."""
    words = raw.split()
    short, few = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 3 * len(text)
    return int(short) | few << 1 | loud << 2 | (_MARKS.search(raw) is not None) << 3


def _later(a, b) -> bool:
    """Whether id a comes after id b."""
    return a is not None and b is not None and a > b or a is None and b is not None


class Chains:
    """For each fingerprint a chain of [text, smallest id, {(part, mask): rows with this id}]."""

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, fingerprint: int, text: bytes, row_id, rows: dict) -> Iterator[tuple]:
        """Takes rows of one id in; gives those of which it is now known that their text has a smaller id."""
        chain = self.by_print.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == text:
                if _later(row_id, link[1]):
                    yield from ((row_id, part, mask | COPY, n) for (part, mask), n in rows.items())
                elif _later(link[1], row_id):
                    yield from ((link[1], part, mask | COPY, n) for (part, mask), n in link[2].items())
                    link[1:] = row_id, dict(rows)
                else:
                    for key, n in rows.items():
                        link[2][key] = link[2].get(key, 0) + n
                return
        chain.append([text, row_id, dict(rows)])
        self.held += len(text) + 200

    def rest(self) -> Iterator[tuple]:
        """(fingerprint, text, id, rows) of what is held, which is let go."""
        for fingerprint, chain in self.by_print.items():
            for link in chain:
                yield (fingerprint, *link)
        self.by_print, self.held = {}, 0


def routed_masks(docs: DataFrame, id_column: str, text_column: str, part_column: str, part_bytes: int = 32 << 20) -> DataFrame:
    """(_id, _part, _mask, _rows): masks of all rows of docs; rows alike in these may be one row with their number.

    A task holds about part_bytes of different texts.
    """
    rows = docs.select(column(id_column).alias("_id"), F.coalesce(column(part_column).cast("string"), F.lit("")).alias("_part"), text_of(text_column).alias("_text"))
    held = docs.agg(F.sum(F.octet_length(text_of(text_column)))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // part_bytes))

    def near(found: Iterator) -> Iterator[tuple]:
        """Keyed texts with the rows of their smallest id, and, under any keys, rows that are copies already."""
        chains, copies = Chains(), 0
        for row_id, part, text in found:
            raw = text.encode("utf-8", "surrogatepass")
            known = chains.add(xxhash.xxh64_intdigest(raw), raw, row_id, {(part, failures(text, raw)): 1})
            for x in known:
                copies += 1
                yield copies, x
            if chains.held > part_bytes:
                yield from ((f, (text, row_id, rows)) for f, text, row_id, rows in chains.rest())
        yield from ((f, (text, row_id, rows)) for f, text, row_id, rows in chains.rest())

    def far(found: Iterator) -> Iterator[tuple]:
        chains = Chains()
        for fingerprint, x in found:
            if len(x) == 4:
                yield x
            else:
                yield from chains.add(fingerprint, *x)
        for _, _, row_id, same in chains.rest():
            yield from ((row_id, part, mask, n) for (part, mask), n in same.items())

    kind = rows.schema["_id"].dataType.simpleString()
    routed = rows.rdd.mapPartitions(near).partitionBy(parts, lambda key: key % parts).mapPartitions(far)
    return docs.sparkSession.createDataFrame(routed, f"_id {kind}, _part string, _mask int, _rows long")


def mask_counts(rows: RDD) -> RDD:
    """An RDD of (part, vector) of an RDD of (part, mask, rows, good, toxic): three counts for each mask."""

    def add(vector: list[int], x: tuple) -> list[int]:
        mask, n, good, toxic = x
        vector[mask] += n
        vector[_MASKS + mask] += n * good
        vector[2 * _MASKS + mask] += n * toxic
        return vector

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    return rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda x: add([0] * (3 * _MASKS), x), add, merge)


def all_orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """The rows of RESULT of a part, from its counts of masks."""
    counts = [vector[k * _MASKS : (k + 1) * _MASKS] for k in range(3)]
    over = lambda which, test: sum(n for mask, n in enumerate(counts[which]) if test(mask))
    removed, shapley = {}, dict.fromkeys(FILTERS, 0)
    for f in FILTERS:
        own = 1 << FILTERS.index(f)
        for before in range(_MASKS):
            if not before & own:
                removed[f, before] = [over(k, lambda m: m & own and not m & before) for k in range(3)]  # noqa: B023
    every = list(permutations(FILTERS))
    steps = []
    for order in every:
        before = 0
        for step, f in enumerate(order, 1):
            gone, good, toxic = removed[f, before]
            shapley[f] += gone
            own = 1 << FILTERS.index(f)
            failing = over(0, lambda m: m & own)  # noqa: B023
            before |= own
            kept = over(0, lambda m: not m & before)  # noqa: B023
            steps.append((f, "".join(order), step, kept, gone, failing - gone, counts[0][own], good, toxic))
    for f, *x in steps:
        yield (part, *x, shapley[f])


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """The rows of RESULT: for each part and each of the 120 orders of the five filters, what each step keeps and removes.

    A to D are failures(); E fails where a smaller id has the same text. Rows with one id (repeated rows) are no copies of
    each other, and a null id comes after all others. Null and empty texts are equal and have no words; long texts are
    compared whole. A null part is the empty one. labels (id, quality, toxic): an id that has several rows is good or
    toxic if one of them says so; ids without labels are neither. Other columns are not read, whatever their names. An
    empty table gives an empty result.
    """
    masks = checkpoint(routed_masks(docs, id_column, text_column, part_column))
    one = lambda name: F.max(F.coalesce((column(name) == 1).cast("int"), F.lit(0)))
    known = labels.groupBy(column(id_column).alias("_label")).agg(one("quality").alias("_good"), one("toxic").alias("_toxic")).where("_label IS NOT NULL")
    flag = lambda name: F.coalesce(name, F.lit(0)).cast("int")
    named = masks.where("_id IS NOT NULL").join(known, F.col("_id") == F.col("_label"), "left")
    nameless = masks.where("_id IS NULL")
    joined = named.unionByName(nameless, allowMissingColumns=True).select("_part", "_mask", "_rows", flag("_good"), flag("_toxic"))
    vectors = mask_counts(joined.rdd)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: all_orders(*x)), RESULT)
