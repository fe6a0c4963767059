import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from junctura.llm import line_dedup, queries
from tests.llm.edges import documents, nothing


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, least_chars=40, least_docs=5):
    held = defaultdict(list)
    for row, (i, text) in enumerate(docs):
        for k in {key_of(x) for x in (text or "").split("\n")}:
            held[k].append((row, i))
    low = lambda i: (i is not None, i or 0)
    keeper = {k: max((i for _, i in v), key=low) for k, v in held.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest())) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect())


LINE = "A line that is long enough to be looked for, ünïcödé or not"


def made(spark, n=300, seed=3):
    rng = random.Random(seed)
    common = [f"{LINE} number {k}" for k in range(60)]
    vary = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f" \t{x} \r", x + "\x0b"])
    rows = []
    for i in range(n):
        lines = [vary(rng.choice(common)) for _ in range(rng.randrange(6))] + ["short line"] * rng.randrange(3) + [f"a line that only this document has, namely {i}"]
        if i % 3 == 0:
            lines += [LINE] * rng.randrange(1, 3)  # a third of all rows
        rng.shuffle(lines)
        rows.append((i if i % 17 else None, "\n".join(lines)))
    rows += rows[:20] + [(5, rows[5][1] + "\n" + LINE * 500)] * 6
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


@pytest.mark.parametrize("options", [{}, {"broadcast_lines": 10}, {"broadcast_lines": 0, "shard_lines": 7}, {"shard_lines": 9}])
def test_ways_agree(spark, options):
    docs, rows = made(spark)
    assert rows_of(line_dedup.dedup_lines(docs, **options)) == brute(rows)


def test_null_ids_and_text_ids(spark):
    same = [(None, LINE)] * 6
    assert rows_of(line_dedup.dedup_lines(spark.createDataFrame(same, "doc_id long, text string"))) == brute(same)
    named = [(f"id{k}", f"x\n{LINE}") for k in range(7)]
    got = line_dedup.dedup_lines(spark.createDataFrame(named, "doc_id string, text string"))
    assert {r.doc_id for r in got.where("n_dropped = 0").collect()} == {"id6"}


@pytest.mark.parametrize("broadcast_lines", [100, 0])
def test_edges(spark, broadcast_lines):
    docs = documents(spark)
    got = line_dedup.dedup_lines(docs, least_chars=1, least_docs=2, broadcast_lines=broadcast_lines)
    assert set(got.columns) == set(docs.columns) | {"n_lines", "n_dropped"}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(got) == brute(rows, 1, 2)
    assert all(r["a.b"] == r["_row"] == "clash" for r in got.collect())
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        index = line_dedup.PerfectHash.of(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
        others = index.slots(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
        assert ((others >= -1) & (others < max(len(keys), 1))).all()
        if n >= 1000:
            assert sum(8 * len(x) for x in index.levels) < 4.5 * n
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.of(np.array([7, 7], np.uint64))


def test_query(spark, sf, same_as_sql):
    got = queries.QUERIES["op12_line_dedup"](spark, sf)
    same_as_sql(got, queries.SQL["op12_line_dedup"])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == brute(docs)
