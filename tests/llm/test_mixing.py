import math
import random
from collections import Counter

from pyspark.sql import functions as F

from junctura.llm import mixing, queries
from tests.llm.edges import documents, nothing


def brute_poisson(u, rate):
    p = c = math.exp(-rate)
    k = 0
    while u >= c and k < math.ceil(rate + 12 * math.sqrt(rate) + 30):
        k += 1
        p *= rate / k
        c += p
    return k


def test_inverse(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.choice([0.0, 0.01, 0.5, 1.0, 3.7, 40.0, 499.0])) for _ in range(500)] + [(0.0, 1.0), (1 - 2.0**-52, 1.0), (0.5, 0.0)]
    got = spark.createDataFrame(rows, "u double, rate double").withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("rate"))).collect()
    assert all(r.k == brute_poisson(r.u, r.rate) for r in got)


def test_edges(spark):
    docs = documents(spark)
    got = mixing.mix(docs, epochs=40.0)
    assert set(got.columns) == set(docs.columns) | {"copy", "shuffle_key"}
    rows = got.collect()
    per = Counter((r.doc_id, r.text) for r in rows)
    assert per[4, "Hello world this is text"] % 2 == 0  # repeated rows are repeated alike
    assert None in {r.source for r in rows} and None in {r.doc_id for r in rows}
    assert sorted(r["copy"] for r in rows if r.doc_id == 9) == list(range(sum(r.doc_id == 9 for r in rows)))
    assert mixing.mix(nothing(spark)).count() == 0
    again = mixing.mix(docs.repartition(3), epochs=40.0, broadcast_sources=0)  # the other way
    assert Counter((r.doc_id, r["copy"], r.shuffle_key) for r in again.collect()) == Counter((r.doc_id, r["copy"], r.shuffle_key) for r in rows)


def test_weights(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "case when id % 10 < 7 then 'big' when id % 10 < 9 then 'mid' else 'small' end as source", "'t' as text")
    got = {r.source: r.n for r in mixing.mix(docs, weights={"big": 1, "mid": 1, "small": 2}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(got.values())
    assert abs(total / 30_000 - 1) < 0.03
    for source, share in (("big", 0.25), ("mid", 0.25), ("small", 0.5)):
        assert abs(got[source] / total - share) < 0.02
    only = mixing.mix(docs, weights={"small": 1.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"small"}
    few = spark.createDataFrame([(1, "x", "rare")], "doc_id long, text string, source string").unionByName(docs)
    assert abs(mixing.mix(few, weights={"rare": 1.0}).count() - 30_001) < 1_000  # a rate far over 500


def test_query(spark, sf, same_as_sql):
    same_as_sql(queries.QUERIES["op7_mixing"](spark, sf), queries.SQL["op7_mixing"])


def test_replicated_rows_keep_their_columns(spark):
    docs = documents(spark)  # with columns named copy and shuffle_key
    got = mixing.replicated(docs, epochs=3.0)
    assert got.columns == docs.columns and all(r["copy"] == r["a.b"] == "clash" for r in got.collect())
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in mixing.mix(docs, epochs=3.0).collect())
    assert mixing.replicated(nothing(spark)).count() == 0
