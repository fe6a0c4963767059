from collections import Counter

import corpus_pipeline as pipeline
from junctura.llm import exact_dedup, langid, mixing, simhash
from junctura.llm.common import held_out
from tests.llm.edges import CLASHES, documents, nothing
from tests.llm.test_dedup import brute_texts, strip
from tests.llm.test_packing import check


def test_stages(spark, sf):
    """Each stage against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    _, (a, b, c, d, e) = zip(*pipeline.STAGES, strict=True)

    kept = a(spark, docs, sf)
    model = langid.train(docs.where(~held_out()))
    want = {r.doc_id for r in docs.collect() if (lambda p: p[0] != "und" and p[1] >= 0.5)(model.predict(r.text or ""))}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)

    texts = [(r.doc_id, r.text) for r in kept.collect()]
    kept = b(spark, kept, sf)
    best = {}
    for i, t in texts:
        best[strip(t)] = min(best.get(strip(t), (0, 1 << 60)), (-len(t or ""), i))
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in best.values())

    texts = [(r.doc_id, r.text) for r in kept.collect()]
    kept = c(spark, kept, sf)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == brute_texts(texts)

    before = {r.doc_id for r in kept.collect()}
    kept = d(spark, kept, sf)
    rows = kept.collect()
    assert kept.columns == columns and {r.doc_id for r in rows} <= before and 0.7 < len(rows) / len(before) < 1.3

    placed = e(spark, kept, sf).collect()
    check(placed, [(r.doc_id, r.text) for r in rows])


def test_run(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_on_awkward_tables(spark, sf):
    """Every stage keeps columns of any name, and does what its docstring says with nulls, empty texts and repeated rows."""
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(pipeline.STAGES)
    for name in ("language", "exact_copies", "near_copies", "mixture"):
        for table in (docs, nothing(spark)):
            got = stages[name](spark, table, sf)
            assert got.schema.names == table.schema.names
            kept = got.collect()
            assert all(r[c] == "clash" for r in kept for c in CLASHES) and {(r.doc_id, r.text) for r in kept} <= set(rows)
            if table is not docs:
                assert kept == []
    exact = Counter((r.doc_id, strip(r.text)) for r in stages["exact_copies"](spark, docs, sf).collect())
    assert sorted(t for _, t in exact.elements()) == sorted({strip(t) for _, t in rows}) and (5, "Helloworldthisistext") in exact
    near = Counter(r.doc_id for r in stages["near_copies"](spark, docs, sf).collect())
    assert near == {1: 1, 4: 2, 6: 1, 7: 1, 8: 1, None: 2}  # 4 and 9, and the empty ones, are one group each
    pieces = stages["packing"](spark, docs, sf).collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows) and [r.length for r in pieces if r.doc_id == 1] == [1]
    assert stages["packing"](spark, nothing(spark), sf).count() == 0


def test_the_operators_agree_with_the_stages(spark):
    docs = documents(spark)
    assert Counter(r.doc_id for r in pipeline.exact_copies(spark, docs, "").collect()) == Counter(r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect())
    assert Counter(r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()) == Counter(r.doc_id for r in simhash.drop_near_copies(docs).collect())
    assert Counter(r.doc_id for r in pipeline.mixture(spark, docs, "").collect()) == Counter(r.doc_id for r in mixing.mix(docs).collect())
