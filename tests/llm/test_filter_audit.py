import re
from itertools import permutations

from junctura.llm import filter_audit, queries
from tests.llm.edges import documents, nothing


def failing(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(w) < 200 else set()
    out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def brute(docs, labels):
    """docs: (id, part, text); labels: id to (quality, toxic)."""
    rows = []
    for i, part, text in docs:
        copy = any(text == t and (i is None and j is not None or i is not None and j is not None and j < i) for j, _, t in docs)
        rows.append((part, failing(text) | ({"E"} if copy else set()), *labels.get(i, (0, 0))))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                steps.append((f, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, *x[1:], shapley[x[0]]) for x in steps]
    return sorted(out)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_edges(spark):
    docs = documents(spark)
    labels = labelled(spark, [(1, 1, 0), (4, 0, 1), (4, 1, 0), (9, 1, 1), (None, 1, 1), (77, 1, 1), (8, None, None)])
    rows = [(r.doc_id, r.lang or "", r.text or "") for r in docs.select("doc_id", "lang", "text").collect()]
    got = filter_audit.audit(docs, labels)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, {1: (1, 0), 4: (1, 1), 9: (1, 1)})
    empty = filter_audit.audit(nothing(spark), labels)
    assert empty.count() == 0 and empty.columns == got.columns
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_copies_over_many_parts(spark):
    """A text that a third of all rows have, ids in any order and repeated, parts too small for more than a text or two."""
    texts = ["many copies of this", "few copies", "a $ sign", ""] + [f"text {k}" for k in range(40)]
    rows = [((i * 37) % 300 // 2 if i % 11 else None, "xy"[i % 2], texts[0] if i % 3 == 0 else texts[i % len(texts)]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(13)
    masks = filter_audit.routed_masks(docs, "doc_id", "text", "lang", part_bytes=300)
    got = sorted(x for r in masks.collect() for x in [(repr(r["_id"]), r["_part"], r["_mask"] >> 4 & 1)] * r["_rows"])
    want = sorted((repr(i), p, int(any(t == u and (i is None and j is not None or i is not None and j is not None and j < i) for j, _, u in rows))) for i, p, t in rows)
    assert got == want
    assert sorted(tuple(r) for r in filter_audit.audit(docs, labelled(spark, [(3, 1, 1), (5, 1, 0)])).collect()) == brute(rows, {3: (1, 1), 5: (1, 0)})


def test_equal_fingerprints_of_different_texts():
    chains = filter_audit.Chains()
    found = [x for i, t in enumerate([b"a", b"b", b"a", b"b", b"c"]) for x in chains.add(1, t, i, {("", 0): 1})]
    assert [x[0] for x in found] == [2, 3] and [x[2] for x in chains.rest()] == [0, 1, 4]


def test_query(spark, sf, same_as_sql):
    same_as_sql(queries.QUERIES["op13_filter_audit"](spark, sf), queries.SQL["op13_filter_audit"])
