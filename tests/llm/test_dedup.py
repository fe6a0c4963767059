import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from junctura.llm import exact_dedup, queries, simhash
from junctura.llm.common import join_frequent, keep_rows
from tests.llm.edges import documents, nothing


def strip(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        g = sorted(groups[strip(t)])
        out.append((i, None if g[0][1] else g[0][2], len(g), hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_edges(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for groups in (200_000, 0):  # both ways
        got = exact_dedup.progressive_dedup(docs, digest_all=True, broadcast_groups=groups).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_exact(rows)
        assert sum(r.kept for r in got) == len({strip(t) for _, t in rows})
    assert exact_dedup.progressive_dedup(nothing(spark)).count() == 0


def test_exact_drop(spark):
    docs = documents(spark)
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(strip(r.text) for r in got.collect()) == sorted({strip(r.text) for r in docs.collect()})
    assert exact_dedup.drop_exact_copies(nothing(spark)).count() == 0


def test_exact_query(spark, sf, same_as_sql):
    same_as_sql(queries.QUERIES["op9_exact_dedup"](spark, sf), queries.SQL["op9_exact_dedup"])


def brute_fingerprint(text, words=3):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    k = min(words, len(found))
    hs = [xxhash.xxh64_intdigest(" ".join(found[i : i + k]).encode(), 42) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, bits=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


def check_groups(got, rows):
    want = {}
    roots = brute_roots({brute_fingerprint(t or "") for _, t in rows})
    for i, t in rows:
        r = roots[brute_fingerprint(t or "")]
        if i is not None:
            want[r] = min(want.get(r, i), i)
    expected = sorted(((i, f"{brute_fingerprint(t or ''):016x}", want.get(roots[brute_fingerprint(t or "")])) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == expected


def test_simhash_edges(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_groups(simhash.near_duplicates(docs).collect(), rows)
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.drop_near_copies(nothing(spark)).count() == 0


def test_simhash_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_groups(queries.QUERIES["op4_simhash"](spark, sf).collect(), rows)


@pytest.mark.parametrize(("bits", "bucket"), [(0, 48), (1, 3), (2, 3), (2, 48), (3, 3), (4, 3)])
def test_links_are_complete(spark, bucket, bits):
    """Chains of fingerprints, dense clouds around a few, and strangers: the same groups as with all pairs."""
    rng = random.Random(bucket * 10 + bits)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(15):
            fps.add(x)
            x ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
    heart = rng.getrandbits(64)
    fps |= {heart ^ 1 << b for b in range(30)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    groups = spark.createDataFrame([(f,) for f in signed], "_fp long")
    found = simhash.components(simhash.links(groups, len(fps), bits, bucket))
    root = {r.node: r.root for r in found.collect()}
    classes = defaultdict(set)
    for f in signed:
        classes[root.get(f, f)].add(f % (1 << 64))
    want = defaultdict(set)
    for f, r in brute_roots(fps, bits).items():
        want[r].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_allotment_is_least():
    rng = random.Random(1)
    costs = [[rng.random() for _ in range(4)] for _ in range(3)]
    best = min((sum(costs[i][t + 1] for i, t in enumerate(ts)), ts) for ts in [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)] if sum(ts) == 0)
    cost, ts = simhash.allot(costs, 0)
    assert abs(cost - best[0]) < 1e-9 and sum(ts) == 0


def test_fingerprint_of_copies(spark):
    docs = documents(spark, [(i, "same text of a few words", "en", "a") for i in range(500)])
    got = simhash.near_duplicates(docs)
    assert got.agg(F.count_distinct("component_id"), F.min("component_id"), F.count("*")).first() == (1, 0, 500)


def brute_texts(rows, words=5, least=0.8):
    """Ids that stay when texts link from this Jaccard similarity on."""
    sets = {}
    for i, t in rows:
        found = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").split()
        k = min(words, len(found))
        s = frozenset(tuple(found[j : j + k]) for j in range(len(found) - k + 1)) if found else frozenset()
        sets[s] = min(sets.get(s, i), i)
    order = sorted(sets, key=sets.get)
    root = {s: sets[s] for s in order}
    for x, a in enumerate(order):
        for b in order[:x]:
            if root[a] != root[b] and len(a & b) >= least * len(a | b) and a and b:
                r, old = min(root[a], root[b]), max(root[a], root[b])
                root = {s: r if v == old else v for s, v in root.items()}
    return sorted(set(root.values()))


def edited(rng, count):
    """Texts of 60 random words and copies of them with one or two words changed, beginnings among them."""
    rows = []
    for _ in range(count):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for places in ((), (0,), (59,), (30,), (20, 40), (10, 30, 50)):
            copy = list(base)
            for p in places:
                copy[p] = f"x{rng.randrange(1 << 30)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("pairs_a_set", "rounds"), [(0, 3), (64, 10), (10**6, 0)])
def test_near_copies_with_edited_words_go(spark, pairs_a_set, rounds):
    rows = edited(random.Random(5), 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_texts(rows)
    assert len(want) <= len(rows) / 2
    got = simhash.near_texts(docs, pairs_a_set=pairs_a_set, rounds=rounds).where("doc_id = component_id")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_a_large_group_is_compared_in_linear_work(spark, monkeypatch):
    """2,000 copies of one text with a word changed, and some dozens of candidate pairs for each, not a thousand."""
    rng, made = random.Random(9), []
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(2000):
        copy = list(base)
        for p in rng.sample(range(60), 1):
            copy[p] = f"x{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(copy)))
    plain = simhash.possible

    def counted(pairs, *rest):
        made.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "possible", counted)
    got = simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}  # dozens have each place changed
    assert sum(made) < 60 * len(rows), made


@pytest.mark.parametrize(("pairs_a_set", "rounds"), [(0, 3), (64, 5), (10**6, 0)])
def test_crowded_shingles_lose_no_copies(spark, pairs_a_set, rounds):
    """Groups of copies with up to five words changed, and others around them, of which each shingle has a crowd."""
    rng, rows = random.Random(11), []
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(80)]
        for _ in range(25):
            copy = list(base)
            for p in rng.sample(range(80), rng.randrange(6)):
                copy[p] = f"x{rng.randrange(1 << 30)}"
            rows.append((len(rows), " ".join(copy[: rng.randrange(65, 81)])))
    want = brute_texts(rows)
    assert 8 < len(want) < len(rows) - 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_texts(docs, pairs_a_set=pairs_a_set, rounds=rounds, crowd=2).where("doc_id = component_id")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_a_large_group_and_its_surroundings_are_connected_at_once(spark, monkeypatch):
    """800 copies of a text with none to seven words changed: most link to the text, others to nothing."""
    rng, made = random.Random(3), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 800):
        copy = list(base)
        for p in rng.sample(range(150), rng.randrange(8)):
            copy[p] = f"x{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(copy)))
    plain = simhash.possible

    def counted(pairs, *rest):
        made.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "possible", counted)
    got = simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = component_id")
    assert sorted(r.doc_id for r in got.collect()) == brute_texts(rows)
    assert len(made) <= 2 and sum(made) < 10 * len(rows), made


def test_keys_that_come_too_late_are_left_out(spark):
    """A key in the last places of all prefixes can't be the first of what similar sets have in common."""
    sets = spark.createDataFrame([(1, 10, [1, 2, 9]), (2, 10, [3, 4, 9]), (3, 10, [5, 6]), (4, 10, [5, 7]), (5, 12, [8, 6, 7]), (6, 10, [11, 2])], "_fp long, _n int, _prefix array<long>")
    got = simhash.shared_keys(sets, 0.8)
    assert sorted((r._key, r._fp, r._at, r._k) for r in got.collect()) == [(2, 1, 1, 2), (2, 6, 1, 2), (5, 3, 0, 2), (5, 4, 0, 2), (6, 3, 1, 2), (6, 5, 1, 2), (7, 4, 1, 2), (7, 5, 2, 2)]


def test_minima():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(-(1 << 62), 1 << 62, 300))
    b = np.unique(np.concatenate((a[:270], rng.integers(-(1 << 62), 1 << 62, 30))))
    assert len(simhash.minima(a)) == len(set(simhash.minima(a).tolist())) == 6 and len(simhash.minima(a[:0])) == 0
    assert len(set(simhash.minima(a).tolist()) & set(simhash.minima(b).tolist())) >= 2


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(3)
    for n in (0, 1, 15, 70, 300, 5000, 40_000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.concatenate((a[: int(share * len(a))], rng.integers(-(1 << 62), 1 << 62, n // 7))))
            assert simhash.common_at_most(simhash.sketch(a), simhash.sketch(b)) >= len(np.intersect1d(a, b))
    strangers = [rng.integers(-(1 << 62), 1 << 62, 300) for _ in range(2)]
    assert simhash.common_at_most(*map(simhash.sketch, strangers)) < 0.889 * 300


def test_near_copies_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == brute_texts(rows)


def test_joins_with_frequent_keys(spark):
    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then 7L else id end as k", "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for share in (1, 10, 100_000):  # none, one, all keys are frequent
        assert sorted(map(tuple, join_frequent(rows, table, "k", "n", share).collect())) == want


def test_both_ways_of_keeping_rows(spark):
    docs = documents(spark)
    decisions = spark.createDataFrame([(1, True), (1, False), (2, False), (None, False), (77, False)], "doc_id long, kept boolean")
    want = sorted((r.doc_id for r in docs.collect() if r.doc_id not in (2, None)))
    for most in (500_000, 0):
        got = keep_rows(docs, decisions, broadcast_ids=most)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_exact_drop_tells_rows_of_one_id_apart(spark):
    rows = [(1, "aaa", None, None), (1, "bbb", None, None), (2, "a a a", None, None), (None, "bbb", None, None), (3, "ccc", None, None), (3, "ccc", None, None)]
    for most in (500_000, 0):
        got = exact_dedup.drop_exact_copies(documents(spark, rows), broadcast_ids=most).collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(1, "bbb"), (2, "a a a"), (3, "ccc")]
