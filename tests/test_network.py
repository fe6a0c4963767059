import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators import network
from junctura.operators.network import LETTERS, Shape

SMALL = Shape(length=29, embed=16, block=12, hidden=10, shrink=4, attention=8, heads=2, feed=14, dropout=0.0)


def sequences(rng, n, length=29):
    return ["".join(rng.choices("ATGCHDNatgc", k=rng.choice([length, length, length - 7, length + 5]))) for _ in range(n)]


def moved(weights, seed=3):
    """Weights of which none is at its beginning, running means and variances among them."""
    rng = np.random.default_rng(seed)
    return {k: np.abs(v + 0.25 * rng.normal(size=v.shape)) if k.endswith("var") else v + 0.25 * rng.normal(size=v.shape) for k, v in weights.items()}


def by_loops(w, shape, text):
    """The chance of label 1 of one sequence, number by number."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    layer = lambda v, name: [dot(v, row) + b for row, b in zip(w[f"{name}.w"].tolist(), w[f"{name}.b"].tolist(), strict=True)]
    relu = lambda v: [max(x, 0.0) for x in v]

    def convolved(xs, name):
        out = []
        for i in range(len(xs)):
            spot = []
            for kernel, b in zip(w[f"{name}.w"].tolist(), w[f"{name}.b"].tolist(), strict=True):
                total = b
                for d in range(shape.window):
                    j = i + d - shape.window // 2
                    if 0 <= j < len(xs):
                        total += sum(kernel[c][d] * xs[j][c] for c in range(len(xs[j])))
                spot.append(total)
            out.append(spot)
        return out

    def block(xs, name):
        xs = convolved(xs, f"{name}.conv1")
        mean, var, scale, shift = (w[f"{name}.norm.{x}"].tolist() for x in ("mean", "var", "w", "b"))
        xs = [relu([(x - m) / math.sqrt(v + 1e-5) * s + t for x, m, v, s, t in zip(spot, mean, var, scale, shift, strict=True)]) for spot in xs]
        xs = [relu(x) for x in convolved(xs, f"{name}.conv2")]
        return [[sum(v) / shape.pool for v in zip(*xs[i : i + shape.pool], strict=True)] for i in range(0, len(xs) - shape.pool + 1, shape.pool)]

    def chance(xs, name, heat):
        flat = [v for spot in xs for v in layer(spot, f"{name}.project")]
        a, b = layer(relu(layer(flat, f"{name}.first")), f"{name}.second")
        return 1 / (1 + math.exp((a - b) / heat))

    def normed(v, name):
        m = sum(v) / len(v)
        s = math.sqrt(sum((x - m) ** 2 for x in v) / len(v) + 1e-5)
        return [(x - m) / s * a + b for x, a, b in zip(v, w[f"{name}.w"].tolist(), w[f"{name}.b"].tolist(), strict=True)]

    text = (text or "")[: shape.length].upper().ljust(shape.length, "N")
    xs = [relu(layer([float(c == x) for x in LETTERS], "embed")) for c in text]
    xs = block(block(xs, "block1"), "block2")
    xs = [[a + b for a, b in zip(layer(v, "encoder.embed"), p, strict=True)] for v, p in zip(xs, w["encoder.position"].tolist(), strict=True)]
    part, qkv = shape.attention // shape.heads, [layer(v, "encoder.qkv") for v in xs]
    rows = []
    for i in range(len(xs)):
        joined = []
        for h in range(shape.heads):
            pick = lambda j, kind: qkv[j][kind * shape.attention + h * part : kind * shape.attention + (h + 1) * part]  # noqa: B023, E731
            e = [math.exp(dot(pick(i, 0), pick(j, 1)) / math.sqrt(part)) for j in range(len(xs))]
            joined += [sum(x * v for x, v in zip(e, col, strict=True)) / sum(e) for col in zip(*[pick(j, 2) for j in range(len(xs))], strict=True)]
        rows.append(layer(joined, "encoder.out"))
    xs = [normed([a + b for a, b in zip(x, y, strict=True)], "encoder.norm1") for x, y in zip(xs, rows, strict=True)]
    xs = [relu(normed([a + b for a, b in zip(x, layer(relu(layer(x, "encoder.feed1")), "encoder.feed2"), strict=True)], "encoder.norm2")) for x in xs]
    return chance(xs, "class3", 1.0)


def test_scores_are_those_of_loops(spark):
    w, texts = moved(network.initial(SMALL, 1)), [*sequences(random.Random(1), 20), "", None]
    want = [by_loops(w, SMALL, t) for t in texts]
    assert np.allclose(network.scores(w, SMALL, texts, at_once=7), want, atol=1e-12) and max(want) - min(want) > 0.01
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, seq string").repartition(3)
    got = {r.i: r.natural_score for r in network.score(rows, w, SMALL).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-12)
    assert network.score(rows.where("false"), w, SMALL).count() == 0


def test_gradients_are_those_of_differences():
    rng = random.Random(2)
    w, texts, labels = moved(network.initial(SMALL, 2)), sequences(rng, 6), np.array([0, 1, 1, 0, 1, 0])

    def value(ws):
        return network.loss(network.Pass(ws, SMALL, True).run(network.codes(texts, SMALL.length))[0], labels)[0]

    p = network.Pass(w, SMALL, True)
    outputs, back = p.run(network.codes(texts, SMALL.length))
    back(network.loss(outputs, labels)[1])
    assert set(p.gradients) == {k for k in w if not k.endswith((".mean", ".var"))}
    for name, g in p.gradients.items():
        assert g.shape == w[name].shape
        for at in rng.sample(list(np.ndindex(g.shape)), min(4, g.size)):
            sides = []
            for step in (1e-5, -1e-5):
                other = dict(w, **{name: w[name].copy()})
                other[name][at] += step
                sides.append(value(other))
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[at], rel=2e-3, abs=1e-6), (name, at)


def labelled(rng, n):
    """Label 1 has a motif beside the junction."""
    rows = []
    for i in range(n):
        left, right = "".join(rng.choices("ACGT", k=14)), "".join(rng.choices("ACGT", k=14))
        rows.append((("ACGTA" + left[5:] if i % 2 else left) + "H" + ("TTGCA" + right[5:] if i % 2 else right), i % 2, "test" if i % 5 == 0 else "train"))
    return rows


def test_partitions_sum_to_the_whole(spark):
    rows = spark.createDataFrame(labelled(random.Random(3), 64), "seq string, label int, part string")
    w = network.initial(SMALL, 3)
    n, value, grads, stats = network.gradients(rows.coalesce(1), w, SMALL)
    p = network.Pass(w, SMALL, True)
    outputs, back = p.run(network.codes([r.seq for r in rows.collect()], SMALL.length))
    total, g = network.loss(outputs, np.array([r.label for r in rows.collect()]))
    back(g)
    assert n == 64 and value == pytest.approx(total / 64) and all(np.allclose(grads[k], p.gradients[k] / 64) for k in grads)
    assert all(np.allclose(stats[k], p.statistics[k]) for k in stats) and len(stats) == 4
    parts = network.gradients(rows.repartition(5), w, SMALL)
    assert parts[0] == 64 and set(parts[2]) == set(grads)
    assert network.gradients(rows.where("false"), w, SMALL)[0] == 0


def test_training_learns_keeps_the_best_and_goes_on(spark, tmp_path):
    rows = spark.createDataFrame(labelled(random.Random(4), 200), "seq string, label int, part string").coalesce(2)
    at = f"{tmp_path}/state"
    whole = network.train(rows, SMALL, epochs=4, batch=80, rate=0.02, seed=5)
    network.train(rows, SMALL, epochs=2, batch=80, rate=0.02, seed=5, save=at)
    state, shape = network.load_state(spark, at)
    assert shape == SMALL and (state.epoch, state.steps) == (2, 4)
    again = network.train(rows, shape, state, epochs=2, batch=80, rate=0.02, seed=5)
    assert (again.epoch, again.steps, again.best_auc) == (4, 8, whole.best_auc)
    assert all(np.allclose(again.weights[k], whole.weights[k], atol=1e-12) for k in whole.weights)
    assert all(np.allclose(again.best[k], whole.best[k], atol=1e-12) for k in whole.weights)
    better = network.train(rows, shape, again, epochs=6, batch=80, rate=0.02, seed=5)
    assert better.best_auc > 0.9
    scored = network.score(rows.where("part = 'test'"), better.best, SMALL)
    got = scored.agg(F.avg(F.when(F.col("label") == 1, F.col("natural_score"))).alias("a"), F.avg(F.when(F.col("label") == 0, F.col("natural_score"))).alias("b")).first()
    assert got.a > got.b
    assert network.train(rows.where("false"), SMALL, epochs=1).best is None


def test_query_is_the_loop(spark, sf):
    from junctura.plans import catalogue_models

    rows = catalogue_models.network_scores(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/conversations.parquet").count()
    texts = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").limit(8).collect()
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    w, got = network.initial(catalogue_models.SHAPE, 7), {(r.conv_id, r.turn): r.natural_score for r in rows}
    for r in texts:
        s = "".join(c for c in (r.text or "").lower() if "a" <= c <= "z").translate(letters)
        half = len(s) // 2
        joined = s[:half][-100:].rjust(100, "N") + "H" + s[half:][:100].ljust(100, "N")
        assert got[r.conv_id, r.turn] == pytest.approx(by_loops(w, catalogue_models.SHAPE, joined), abs=1e-8)
