import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from junctura.operators import breakpoints, similarity
from junctura.plans import catalogue, planted, showcase
from junctura.streaming import rollup

SQL = catalogue.SQL | rollup.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, same_as_sql):
    queries = catalogue.QUERIES | rollup.QUERIES
    same_as_sql(queries[name](spark, sf), SQL[name])


def test_all_others_have_a_brute_force_version():
    assert set(catalogue.QUERIES) - set(SQL) == {"seed_extend", "cluster_leader", "candidate_chain", "network_scores"}


def naive_stretches(same, least):
    """Best runs by trying all ends: 1 for a match, -3 for a mismatch; the last begin and first end of those that tie."""
    n = len(same)
    if n < least:
        return []
    total = [0]
    for x in same:
        total.append(total[-1] + (1 if x else -3))
    best = max(((total[e] - total[s], -e, s) for s in range(n) for e in range(s + 1, n + 1)), default=(0, 0, 0))
    start, end = best[2], -best[1]
    matches = sum(same[start:end])
    if 2 * matches - (end - start) < least:
        return []
    return [*naive_stretches(same[:start], least), (start, end, matches), *[(s + end, e + end, m) for s, e, m in naive_stretches(same[end:], least)]]


def naive_hits(queries, targets, k, min_score, min_identity):
    out = Counter()
    for q, whole in queries:
        for strand, text in (("+", whole), ("-", whole[::-1].translate(str.maketrans("ATGC", "TACG")))):
            for t, other in targets:
                words = {}
                for j in range(len(other) - k + 1):
                    words.setdefault(other[j : j + k], []).append(j)
                for d in {j - i for i in range(len(text) - k + 1) for j in words.get(text[i : i + k], ())}:
                    lo, hi = max(0, -d), min(len(text), len(other) - d)
                    for s, e, m in naive_stretches([a == b for a, b in zip(text[lo:hi], other[lo + d : hi + d], strict=True)], min(k, min_score)):
                        if 2 * m - (e - s) >= min_score and m >= min_identity * (e - s):
                            q0, q1 = (s + lo, e + lo) if strand == "+" else (len(text) - e - lo, len(text) - s - lo)
                            out[q, t, strand, m, q0, q1, s + lo + d, e + lo + d] += 1
    return out


def found(hits):
    return Counter((r["query"], r.target, r.strand, r.matches, r.q_start, r.q_end, r.t_start, r.t_end) for r in hits.collect())


def test_seed_extend_is_the_naive_search(spark, sf):
    """The query's own tables, and planted sequences with changed letters on both strands."""
    rows = catalogue.QUERIES["seed_extend"](spark, sf)
    letters = lambda name, key: [(r.k, r.s) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key.alias("k"), catalogue.as_sequence(F.col("text")).alias("s")).collect()]
    targets = letters("conversations", F.col("conv_id") * 1000 + F.col("turn"))
    assert found(rows) == naive_hits(letters("benchmark", F.col("item_id")), targets, 12, 20, 0.9)
    rng = random.Random(11)
    base = ["".join(rng.choices("ACGT", k=90)) for _ in range(6)]
    change = lambda s, n: "".join(rng.choice("ACGT") if i in set(rng.sample(range(len(s)), n)) else c for i, c in enumerate(s))
    targets = [(f"t{i}", base[i] + base[(i + 1) % 6][:40]) for i in range(6)]
    queries = [(f"q{i}", change(base[i], 4)[10:80]) for i in range(6)] + [(f"r{i}", change(base[i], 3)[5:70][::-1].translate(str.maketrans("ATGC", "TACG"))) for i in range(6)]
    for least, identity in ((20, 0.9), (12, 0.0)):
        hits = similarity.align(spark.createDataFrame(queries, "query string, seq string"), spark.createDataFrame(targets, "target string, seq string"), 8, min_score=least, min_identity=identity, most=None, gap=0)
        want = naive_hits(queries, targets, 8, least, identity)
        assert found(hits) == want and len(want) >= 12


def naive_clusters(rows, least, within):
    """(reads, head breakpoint, head's number) a row at a time, a cluster at a time."""
    by = {}
    for r in rows:
        by.setdefault((r["sample"], r.chrom, r.type, r.breakpoint), []).append(r)
    leaders, of = [], {}
    for key, own in sorted(by.items()):
        mine = []
        for r in sorted(own, key=lambda r: (-r.cnt, r.seq_left, r.seq_right)):
            k = next((k for k in mine if breakpoints.alike(leaders[k][1], leaders[k][2], r.seq_left, r.seq_right, least)), None)
            if k is None:
                k = len(leaders)
                leaders.append([key, r.seq_left, r.seq_right, 0, len(mine)])
                mine.append(k)
            leaders[k][3] += r.cnt
            of[tuple(r.reads)] = k
    order = sorted(range(len(leaders)), key=lambda k: (-leaders[k][3], leaders[k][0][3], leaders[k][4], leaders[k][0][:3]))
    into = {}
    for k in order:
        if k in into:
            continue
        into[k] = k
        for j in order:
            d = leaders[j][0][3] - leaders[k][0][3]
            if j not in into and leaders[j][0][:3] == leaders[k][0][:3] and 0 < abs(d) <= within and breakpoints.alike(*leaders[k][1:3], *leaders[j][1:3], least, d):
                into[j] = k
    return sorted((reads, leaders[into[k]][0][3], leaders[into[k]][4]) for reads, k in of.items())


def dense_splits(rng, n):
    """Reads of a few junctions with changed letters, at breakpoints that form one chain."""
    rows, texts = [], ["".join(rng.choices("ACGT", k=80)) for _ in range(4)]
    for i in range(n):
        text, at = rng.choice(texts), 40 + rng.randint(-6, 6)
        text = "".join(rng.choice("ACGT") if rng.random() < 0.04 else c for c in text)
        rows.append(("s", f"r{i:04d}", "g", 1000 + at, "SM", text[at - rng.randint(15, 30) : at], text[at : at + rng.randint(15, 30)]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_leader_clusters_are_the_naive_ones(spark, seed):
    rows = spark.createDataFrame(dense_splits(random.Random(seed), 120), "sample string, read_name string, chrom string, breakpoint long, type string, seq_left string, seq_right string")
    merged = breakpoints.merge_compatible(rows)
    got = sorted((tuple(r.reads), r.breakpoint, r.cluster) for r in breakpoints.leader_clusters(merged).collect())
    assert got == naive_clusters(merged.collect(), 0.9, 3)


def test_cluster_leader_has_all_reads(spark, sf):
    """The query's clusters hold each turn once, in the clusters of the naive way."""
    rows = catalogue.QUERIES["cluster_leader"](spark, sf).collect()
    turns = [f"{r.conv_id}/{r.turn}" for r in spark.read.parquet(f"{sf}/conversations.parquet").where("text rlike '[A-Za-z]'").collect()]
    assert sorted(x for r in rows for x in r.reads) == sorted(turns)
    assert all(r.cnt == len(r.reads) for r in rows)


def test_planted_fusions(spark, sf, same_as_sql):
    same_as_sql(showcase.QUERIES["fusion_cells"](spark, sf), planted.CELLS_SQL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["fusion", "spanning_count", "breakpoint_count", "cell_count", "distinct_cells", "cells"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
