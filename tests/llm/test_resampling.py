import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from junctura.llm import queries, resampling
from tests.llm.edges import documents, nothing


def grams(text, orders):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return w, [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, orders=2, buckets=10_000, least_words=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in grams(x, orders)[1]) for texts in ([d[1] for d in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, fs = grams(text, orders)
        gain = [math.floor(1000 * math.log(((t[bucket(f)] + 1) * float(total_s + buckets)) / ((s[bucket(f)] + 1) * float(total_t + buckets)))) for f in fs]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least_words])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = percent * len(able) // 100
    return out, {(x[0], k) for k, x in enumerate(able[:drawn], 1)}


def compare(got, docs, target, **options):
    want, ranks = brute(docs, target, **options)
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(repr, (tuple(x[:4]) for x in want)))
    assert {(r.doc_id, r["rank"]) for r in got if r["rank"] is not None} == ranks


def test_edges(spark):
    docs = documents(spark)
    target = spark.createDataFrame([("this world and text",), (None,), ("",), ("HELLO WORLD",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for options in ({"least_words": 0, "percent": 50}, {"orders": 3, "buckets": 50, "least_words": 3, "percent": 40}, {"orders": 1, "percent": 100}):
        compare(resampling.resample(docs, target, **options).collect(), rows, [r.text for r in target.collect()], **options)
    none = resampling.resample(docs, target.where("false"), least_words=0)
    assert none.count() == docs.count()
    empty = resampling.resample(nothing(spark), target)
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and empty.count() == 0


def test_draw(spark):
    docs = documents(spark)
    target = spark.createDataFrame([("ünïcödé token",)], "text string")
    found = resampling.resample(docs, target, least_words=1, percent=50)
    ids = {r.doc_id for r in found.where("rank IS NOT NULL").collect()}
    got = resampling.draw(docs, target, least_words=1, percent=50)
    assert got.columns == docs.columns and {r.doc_id for r in got.select("doc_id").collect()} == ids


def test_small_parts(spark, sf):
    """Texts dealt out to many parts give the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [resampling.positions(docs, "doc_id", "text", 2, 100, part_bytes=n) for n in (1 << 24, 10_000)]
    one, two = (t.groupBy("_id", "_b1", "_b2").count() for t in tables)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert tables[1].rdd.getNumPartitions() > 8


def test_query(spark, sf, same_as_sql):
    got = queries.QUERIES["op11_resampling"](spark, sf)
    same_as_sql(got, queries.SQL["op11_resampling"])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(got.collect(), docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text")).collect()])
