import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from junctura.llm import langid, quality, queries, toxicity
from junctura.llm.common import bounded_sample, held_out
from tests.llm.edges import documents, nothing


def share(df, condition):
    return df.agg(F.avg(condition.cast("int"))).first()[0]


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op6_language"](spark, sf).join(docs, "doc_id")
    assert share(got.where("held_out AND lang IS NOT NULL"), F.col("lang") == F.col("lang_pred")) > 0.97
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_edges(spark):
    docs = documents(spark)
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == docs.count()
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (7, "de")} <= by
    assert len({r.lang_pred for r in got if r.doc_id == 4}) == 1
    kept = langid.reject_undecided(docs, model)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    empty = langid.train(nothing(spark))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(nothing(spark), model).count() == 0


def test_language_backs_off(spark):
    rows = [(i, w, lang, None) for i, (w, lang) in enumerate([("strasse schnell", "de"), ("rapide vitesse", "fr")] * 5)]
    model = langid.train(documents(spark, rows, clash=False))
    assert model.tables[0].keys() == {"strasse", "schnell", "rapide", "vitesse"}
    assert model.predict("schnelle strassen")[0] == "de"
    assert model.predict("vitesses rapidement")[0] == "fr"
    assert model.predict("12345 !!")[0] == "und"
    # a word by hand: its longest known n-grams are averaged
    grams = [g for g in langid.grams("schnelle", 5) if g in model.tables[5]]
    assert np.allclose(model.unseen("schnelle"), np.mean([model.scores[5][model.tables[5][g]] for g in grams], axis=0))


def test_quality_held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op10_quality"](spark, sf)
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> cast(score >= 0.3 as int)").count() == 0
    assert share(got.where("held_out").join(labels, "doc_id"), F.col("quality") == F.col("predicted")) >= 0.85


def test_quality_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (None, 1), (8, None), (4, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    by = {r.doc_id: r.score for r in got}
    assert min(by[4], by[5]) > max(by[6], by[7])
    alike = quality.train(docs, labels.where("quality = 1"))
    assert len({r.score for r in quality.score(docs, alike).collect()}) == 1
    assert quality.score(nothing(spark), model).count() == 0
    assert quality.train(nothing(spark), labels.limit(0)).weights.sum() == 0


def test_pairs_learn_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [2.0, -1.0, 0.0] > 0
    good, bad = np.flatnonzero(y), np.flatnonzero(~y)
    w = quality.fit_pairs(x[rng.choice(good, 3000)], x[rng.choice(bad, 3000)])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]
    assert np.mean((x @ w)[good][:, None] > (x @ w)[bad][None, :]) > 0.98


def test_toxicity_held_out(spark, sf):
    """The model of the largest table, on what it has not seen: about a hundred toxic documents."""
    at = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = queries.QUERIES["op1_toxicity"](spark, at).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where(held_out())
    assert got.where("label = 0 AND toxic = 1").count() <= 0.01 * got.where("label = 0").count()
    assert got.where("label = 1 AND toxic = 1").count() >= 0.85 * got.where("label = 1").count()
    assert docs.count() == queries.QUERIES["op1_toxicity"](spark, at).count()


def test_toxicity_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 0), (5, 0), (8, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    assert len({r.severity for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert len({r.severity for r in got if r.doc_id in (4, 9)}) == 1
    assert toxicity.score(nothing(spark), model).count() == 0
    none = toxicity.train(nothing(spark), labels.limit(0))
    assert not none.weights.any() and toxicity.score(docs, none).count() == docs.count()


def test_ordinal_grades_in_order(spark):
    """Graded labels: expected severity rises with the number of bad words, thresholds stay in order."""
    rng = random.Random(0)
    bad, fine = [f"bad{chr(97 + i)}x" for i in range(6)], [f"fine{chr(97 + i)}y" for i in range(20)]
    rows, labels = [], []
    for i in range(400):
        grade = i % 4
        rows.append((i, " ".join(rng.sample(fine, 8) + rng.sample(bad, 2 * grade)), "en", None))
        labels.append((i, grade))
    docs = documents(spark, rows, clash=False)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), graded=True)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).join(spark.createDataFrame(labels, "doc_id long, label int"), "doc_id")
    means = [r.m for r in got.groupBy("label").agg(F.avg("severity").alias("m")).orderBy("label").collect()]
    assert all(abs(m - k) < 0.35 for k, m in enumerate(means))
    p = model.probabilities(np.array([-3.0, 0.0, 50.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_stems():
    words = "achlichen achlicher achliche und der".split()
    assert {"achl*0", "achl*1", "achlich*0"} <= set(toxicity.stems(words))
    assert toxicity.stems(words + ["wort%d" % i for i in range(0)] + [f"x{i}y" for i in range(3000)]) == []


def test_bounded_sample(spark):
    rows = spark.range(10_000)
    assert bounded_sample(rows, "id", 10_000).count() == 10_000
    one, two = (sorted(r.id for r in bounded_sample(rows.repartition(n), "id", 1000).collect()) for n in (2, 7))
    assert 850 < len(one) <= 1000 and one == two


def slopes(loss, at, step=1e-6):
    """The gradient by differences."""
    moved = lambda i, d: np.where(np.arange(len(at)) == i, at + d, at)
    return np.array([(loss(moved(i, step)) - loss(moved(i, -step))) / (2 * step) for i in range(len(at))])


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(4)
    rows, col = np.repeat(np.arange(30), 3), rng.integers(0, 6, 90)
    value, grades, theta = rng.random(90), rng.integers(0, 4, 30), rng.normal(size=9)
    loss = lambda t: toxicity.ordinal_loss(t, rows, col, value, grades, 4, 0.01)[0]
    assert np.allclose(toxicity.ordinal_loss(theta, rows, col, value, grades, 4, 0.01)[1], slopes(loss, theta), atol=1e-6)
    # the loss itself, a row at a time
    t, want = [theta[6], theta[6] + math.exp(theta[7]), theta[6] + math.exp(theta[7]) + math.exp(theta[8])], 0.0
    for r in range(30):
        x = sum(theta[col[i]] * value[i] for i in range(90) if rows[i] == r)
        upto = [0.0, *[1 / (1 + math.exp(x - k)) for k in t], 1.0]
        want -= math.log(upto[grades[r] + 1] - upto[grades[r]]) / 30
    assert abs(loss(theta) - want - 0.005 * (theta[:6] ** 2).sum()) < 1e-9
    diff, w = rng.normal(size=(40, 5)), rng.normal(size=5)
    assert np.allclose(quality.pair_loss(w, diff, 0.01)[1], slopes(lambda v: quality.pair_loss(v, diff, 0.01)[0], w), atol=1e-6)


def test_grades_rest_on_other_rows():
    """A row's grade stays when its own features change, as long as what is learned from the other fold is the same."""
    rng = random.Random(2)
    toxic = np.array([i % 3 == 0 for i in range(300)], int)
    lists = [sorted(rng.sample(range(10), 4) if t else rng.sample(range(10, 40), 6)) for t in toxic]
    rows, cols = np.repeat(np.arange(300), [len(x) for x in lists]), np.concatenate(lists)
    grades = toxicity.severity(rows, cols, toxic, 64)
    assert set(grades[toxic == 0]) == {0} and set(grades[toxic == 1]) <= {1, 2, 3}
    # a feature that only one toxic row has is never telling for that row
    alone = np.append(cols, 63)
    assert (toxicity.severity(np.append(rows, 0), alone, toxic, 64) == grades).all()


def brute_toxicity(model, text):
    """Expected grade and chance of toxicity of a text from weights and thresholds."""
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    features, unit = set(found), max(1.0, len(found) / 150)
    often = None
    for size in (4, 5, 6, 7):
        pool = [w for w in found if len(w) >= size and (often is None or any(w[: size - 1] == p for p in often))]
        counts = Counter(w[:size] for w in pool)
        often = {p for p, n in counts.items() if n >= 1.5 * unit}
        features |= {f"{p}*{k}" for p, n in counts.items() for k, level in enumerate((1.5, 3.0)) if n >= level * unit}
    x = sum(float(model.weights[zlib.crc32(f.encode()) % len(model.weights)]) for f in features)
    upto = [0.0, *[1 / (1 + math.exp(min(40, max(-40, x - t)))) for t in model.thresholds], 1.0]
    p = [b - a for a, b in zip(upto, upto[1:], strict=False)]
    return sum(k * v for k, v in enumerate(p)), 1 - p[0]


def test_toxicity_scores_are_those_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        grade, p = brute_toxicity(model, texts[r.doc_id])
        assert abs(r.severity - grade) < 1e-4 and abs(r.p_toxic - p) < 1e-4 and r.toxic == (r.p_toxic >= 0.5)


def brute_language(rows):
    """Counts of words and n-grams by language of (lang, text)."""
    counts = [Counter() for _ in range(6)]
    for lang, text in rows:
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
            counts[0][lang, w] += 1
            for n in range(1, 6):
                marked = w if n == 1 else "\x02" + w + "\x03"
                for i in range(len(marked) - n + 1):
                    counts[n][lang, marked[i : i + n]] += 1
    return counts


def test_language_model_and_scores_are_those_by_hand(spark, sf):
    """Every feature's log frequencies from counts, and every document's prediction from these."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "lang", "text").collect()]
    model = langid.train(docs, words_per_language=2000, grams_per_language=500)
    counts = brute_language([(lang, t) for _, lang, t in rows if lang is not None])
    tables = []
    for n in range(6):
        most, own = (2000 if n == 0 else 500), {}
        for lang in model.languages:
            ranked = sorted(((-k, w) for (a, w), k in counts[n].items() if a == lang and (k > 1 or n < 3)), key=lambda x: (x[0], x[1].encode()))
            own |= {w: None for _, w in ranked[:most]}
        totals = {lang: sum(k for (a, _), k in counts[n].items() if a == lang) + 0.1 * len(own) for lang in model.languages}
        tables.append({w: [math.log((counts[n][lang, w] + 0.1) / totals[lang]) for lang in model.languages] for w in own})
        assert set(tables[n]) == set(model.tables[n])
        for w, i in model.tables[n].items():
            assert np.allclose(model.scores[n][i], tables[n][w], atol=1e-3)
    for _, _, text in rows[:80]:
        total = np.zeros(len(model.languages))
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
            if w in model.tables[0]:
                total += model.scores[0][model.tables[0][w]]
                continue
            for n in (5, 4, 3, 2, 1):
                marked = w if n == 1 else "\x02" + w + "\x03"
                hit = [model.scores[n][model.tables[n][marked[i : i + n]]] for i in range(len(marked) - n + 1) if marked[i : i + n] in model.tables[n]]
                if hit:
                    total += np.mean(hit, axis=0)
                    break
        lang, score = model.predict(text or "")
        if not total.any():
            continue
        assert lang == model.languages[int(np.argmax(total))] and abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-3


def test_words_are_runs_of_letters():
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x20, 0x530)] + ["e\u0301", "\u0130", "\u4e2d", "\U0001f600"]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(60))
        assert langid.words(text) == Counter(regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()))


def test_language_sample_is_bounded(spark):
    rows = [(i % 400, f"text {i}", "en" if i % 3 else "de", None) for i in range(3000)] + [(7, "same id", "en", None)] * 500
    sample, n = langid.labelled_sample(documents(spark, rows, clash=False), "doc_id", "text", "lang", 50)
    got = Counter(r._lang for r in sample.collect())
    assert all(0 < k <= 50 for k in got.values()) and n == Counter(r[2] for r in rows)
    few, _ = langid.labelled_sample(documents(spark, rows[:90], clash=False), "doc_id", "text", "lang", 50)
    assert few.count() == 80


def brute_statistics(text):
    """The sixteen numbers, letter by letter."""
    data, words = text.encode(), text.split()
    if not words:
        return [0.0] * 16
    low = sum(97 <= b < 123 or b >= 128 for b in data)
    up, digit = sum(65 <= b < 91 for b in data), sum(48 <= b < 58 for b in data)
    white, ends = sum(b in b"\t\x0b\x0c\r " for b in data), data.count(b"\n")
    n, lines = len(words), [x for x in text.split("\n") if x]
    marks = len(re.findall(r"[^\w\s]{2,}", text))
    return [
        math.log1p(len(data)), (len(data) - low - up - digit - white - ends) / len(data), up / max(low + up, 1), digit / len(data), max(low + up, 1) / len(data),
        len(set(words)) / n, max(Counter(words).values()) / n, (low + up) / n, 1 - len(set(lines)) / len(lines), ends / n,
        sum(words[i] == words[i + 1] for i in range(n - 1)) / n, marks / n, sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        sum(text.count(c) for c in ".?!") / n, max(map(len, words)) / 20, math.log1p(n / len(lines)),
    ]


def test_quality_scores_are_those_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.score(docs, model).collect():
        stats = brute_statistics(texts[r.doc_id])
        raw, at = 0.0, 0
        for value, edges in zip(stats, model.edges, strict=True):
            raw += sum(w for w, e in zip(model.weights[at : at + len(edges)], edges, strict=True) if value > e)
            at += len(edges)
        x = (raw - model.middle) / model.spread + math.log(0.3 / 0.7)
        assert abs(r.score - 1 / (1 + math.exp(-min(40, max(-40, x))))) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_samples_hold_an_id_once(spark):
    """A labelled id on most of the rows is one row of the sample."""
    rows = [(i, f"good words number {i} here.", None, None) for i in range(20)] + [(99, f"BAD {i}", None, None) for i in range(500)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(99, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model.middle == float(np.quantile(model.raw(quality.table_of([min(t for j, t, _, _ in rows if j == i) for i in [*range(20), 99]])), 1 / 21))
    assert len(toxicity.train(docs, labels).thresholds) == 3
