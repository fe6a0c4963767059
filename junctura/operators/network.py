"""A convolutional network with attention for junction sequences: scores in Arrow batches, training with summed gradients.

Weights are arrays by name, sent to all tasks; they are as large as the network, whatever the input. A step's gradients are
made where the rows are, one sum for each partition, and added up in a tree, so neither rows nor gradients of single rows
reach the driver. The driver holds weights and their moments and moves them by Adam.

Each part of the network gives its result and a function that turns the gradient of the result into that of what came in,
noting those of its weights on the way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators.ranks import auc
from junctura.session import checkpoint

Weights = dict[str, np.ndarray]
Back = Callable[[np.ndarray], np.ndarray]

#: The letters' places in a one-hot column; others have none.
LETTERS = "ATGCHD"
_TINY = 1e-5


@dataclass(frozen=True)
class Shape:
    """Sizes of the network. Every layer of blocks and pooling makes a sequence ``pool`` times shorter."""

    length: int = 201
    embed: int = 256
    block: int = 256
    hidden: int = 256
    window: int = 3
    pool: int = 3
    shrink: int = 4
    attention: int = 128
    heads: int = 2
    feed: int = 2048
    dropout: float = 0.2


def codes(texts: list[str], length: int) -> np.ndarray:
    """Places of the letters in LETTERS, 6 for others; cut or padded to one length."""
    table = np.full(256, len(LETTERS), np.int8)
    for i, c in enumerate(LETTERS):
        table[[ord(c), ord(c.lower())]] = i
    out = np.full((len(texts), length), len(LETTERS), np.int8)
    for i, t in enumerate(texts):
        found = table[np.frombuffer((t or "")[:length].encode("ascii", "replace"), np.uint8)]
        out[i, : len(found)] = found
    return out


def initial(shape: Shape, seed: int = 0) -> Weights:
    """Uniform weights within one over the root of what goes into a unit; norms begin at 1 and 0."""
    rng, w = np.random.default_rng(seed), {}

    def linear(name: str, outs: int, *ins: int) -> None:
        bound = 1 / np.sqrt(np.prod(ins))
        w[f"{name}.w"], w[f"{name}.b"] = rng.uniform(-bound, bound, (outs, *ins)), rng.uniform(-bound, bound, outs)

    def norm(name: str, size: int, running: bool = False) -> None:
        w[f"{name}.w"], w[f"{name}.b"] = np.ones(size), np.zeros(size)
        if running:
            w[f"{name}.mean"], w[f"{name}.var"] = np.zeros(size), np.ones(size)

    def classifier(name: str, size: int, length: int) -> None:
        linear(f"{name}.project", size // shape.shrink, size)
        linear(f"{name}.first", shape.hidden, length * (size // shape.shrink))
        linear(f"{name}.second", 2, shape.hidden)

    linear("embed", shape.embed, len(LETTERS))
    short = shape.length
    for k in (1, 2):
        linear(f"block{k}.conv1", shape.block, shape.embed, shape.window)
        norm(f"block{k}.norm", shape.block, True)
        linear(f"block{k}.conv2", shape.embed, shape.block, shape.window)
        short //= shape.pool
        classifier(f"class{k}", shape.embed, short)
    linear("encoder.embed", shape.attention, shape.embed)
    w["encoder.position"] = rng.normal(0, 0.02, (short, shape.attention))
    linear("encoder.qkv", 3 * shape.attention, shape.attention)
    linear("encoder.out", shape.attention, shape.attention)
    norm("encoder.norm1", shape.attention)
    linear("encoder.feed1", shape.feed, shape.attention)
    linear("encoder.feed2", shape.attention, shape.feed)
    norm("encoder.norm2", shape.attention)
    classifier("class3", shape.attention, short)
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Pass:
    """One way through the network; gradients of weights gather in ``gradients``, batch statistics in ``statistics``."""

    def __init__(self, weights: Weights, shape: Shape, training: bool = False, dropout_seed: int | None = None):
        self.w, self.shape, self.training = weights, shape, training
        self.rng = np.random.default_rng(dropout_seed) if training and dropout_seed is not None and shape.dropout else None
        self.gradients: Weights = {}
        self.statistics: Weights = {}

    def _note(self, name: str, gradient: np.ndarray) -> None:
        self.gradients[name] = self.gradients[name] + gradient if name in self.gradients else gradient

    def linear(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        w = self.w[f"{name}.w"]

        def back(g: np.ndarray) -> np.ndarray:
            self._note(f"{name}.w", g.reshape(-1, g.shape[-1]).T @ x.reshape(-1, x.shape[-1]))
            self._note(f"{name}.b", g.reshape(-1, g.shape[-1]).sum(0))
            return g @ w

        return x @ w.T + self.w[f"{name}.b"], back

    def letters(self, spots: np.ndarray) -> tuple[np.ndarray, Back]:
        """A linear layer over one-hot letters, which picks columns."""
        columns = np.vstack([self.w["embed.w"].T, np.zeros((1, self.shape.embed), self.w["embed.w"].dtype)])

        def back(g: np.ndarray) -> np.ndarray:
            flat, at = g.reshape(-1, g.shape[-1]), spots.ravel()
            self._note("embed.w", np.stack([flat[at == i].sum(0) for i in range(len(LETTERS))], axis=1))
            self._note("embed.b", flat.sum(0))
            return g

        return columns[spots] + self.w["embed.b"], back

    @staticmethod
    def relu(x: np.ndarray) -> tuple[np.ndarray, Back]:
        return np.maximum(x, 0), lambda g: g * (x > 0)

    def convolution(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        """Over places of (rows, places, channels), as long as before: a product with each place's window."""
        w, (n, length, channels) = self.w[f"{name}.w"], x.shape
        width = w.shape[2]
        half = width // 2
        padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
        windows = np.concatenate([padded[:, i : i + length] for i in range(width)], axis=2)
        flat = w.transpose(2, 1, 0).reshape(width * channels, -1)

        def back(g: np.ndarray) -> np.ndarray:
            d = windows.reshape(-1, width * channels).T @ g.reshape(-1, g.shape[2])
            self._note(f"{name}.w", d.reshape(width, channels, -1).transpose(2, 1, 0))
            self._note(f"{name}.b", g.sum((0, 1)))
            spread, out = g @ flat.T, np.zeros_like(padded)
            for i in range(width):
                out[:, i : i + length] += spread[:, :, i * channels : (i + 1) * channels]
            return out[:, half : half + length]

        return windows @ flat + self.w[f"{name}.b"], back

    def batch_norm(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        """By the batch's own mean and variance in training, which are noted, else by the running ones."""
        count = x.shape[0] * x.shape[1]
        if self.training:
            mean, var = x.mean((0, 1)), x.var((0, 1))
            self.statistics[f"{name}.mean"], self.statistics[f"{name}.var"] = mean, var * count / max(count - 1, 1)
        else:
            mean, var = self.w[f"{name}.mean"], self.w[f"{name}.var"]
        scale = 1 / np.sqrt(var + _TINY)
        unit = (x - mean) * scale

        def back(g: np.ndarray) -> np.ndarray:
            self._note(f"{name}.w", (g * unit).sum((0, 1)))
            self._note(f"{name}.b", g.sum((0, 1)))
            g = g * self.w[f"{name}.w"]
            return scale * (g - g.mean((0, 1)) - unit * (g * unit).mean((0, 1))) if self.training else g * scale

        return unit * self.w[f"{name}.w"] + self.w[f"{name}.b"], back

    def layer_norm(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        scale = 1 / np.sqrt(x.var(-1, keepdims=True) + _TINY)
        unit = (x - x.mean(-1, keepdims=True)) * scale

        def back(g: np.ndarray) -> np.ndarray:
            self._note(f"{name}.w", (g * unit).sum((0, 1)))
            self._note(f"{name}.b", g.sum((0, 1)))
            g = g * self.w[f"{name}.w"]
            return scale * (g - g.mean(-1, keepdims=True) - unit * (g * unit).mean(-1, keepdims=True))

        return unit * self.w[f"{name}.w"] + self.w[f"{name}.b"], back

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        """Means of ``pool`` places; places that are left over go."""
        n, length, channels = x.shape
        size = self.shape.pool
        short = length // size

        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(x)
            out[:, : short * size] = np.repeat(g / size, size, axis=1)
            return out

        return x[:, : short * size].reshape(n, short, size, channels).mean(2), back

    def attention(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        """Scaled products of queries and keys in heads, softmax over places, and a linear layer over the joined heads."""
        n, length, size = x.shape
        heads, part = self.shape.heads, size // self.shape.heads
        qkv, back_qkv = self.linear(x, "encoder.qkv")
        q, k, v = qkv.reshape(n, length, 3, heads, part).transpose(2, 0, 3, 1, 4)
        share = softmax(q @ k.transpose(0, 1, 3, 2) / np.sqrt(part))
        joined, back_out = self.linear((share @ v).transpose(0, 2, 1, 3).reshape(n, length, size), "encoder.out")

        def back(g: np.ndarray) -> np.ndarray:
            g = back_out(g).reshape(n, length, heads, part).transpose(0, 2, 1, 3)
            d_share = g @ v.transpose(0, 1, 3, 2)
            inner = share * (d_share - (d_share * share).sum(-1, keepdims=True)) / np.sqrt(part)
            each = np.stack([inner @ k, inner.transpose(0, 1, 3, 2) @ q, share.transpose(0, 1, 3, 2) @ g])
            return back_qkv(each.transpose(1, 3, 0, 2, 4).reshape(n, length, 3 * size))

        return joined, back

    def sequence(self, x: np.ndarray, *steps: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> tuple[np.ndarray, Back]:
        backs = []
        for step in steps:
            x, back = step(x)
            backs.append(back)

        def whole(g: np.ndarray) -> np.ndarray:
            for back in reversed(backs):
                g = back(g)
            return g

        return x, whole

    def residual(self, inner: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> Callable[[np.ndarray], tuple[np.ndarray, Back]]:
        def run(x: np.ndarray) -> tuple[np.ndarray, Back]:
            y, back = inner(x)
            return x + y, lambda g: g + back(g)

        return run

    def dropped(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        if self.rng is None:
            return x, lambda g: g
        keep = (self.rng.random(x.shape) >= self.shape.dropout) / (1 - self.shape.dropout)
        return x * keep, lambda g: g * keep

    def block(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        return self.sequence(
            x, lambda v: self.convolution(v, f"{name}.conv1"), lambda v: self.batch_norm(v, f"{name}.norm"), self.relu,
            lambda v: self.convolution(v, f"{name}.conv2"), self.relu, self.pooled,
        )

    def classifier(self, x: np.ndarray, name: str, heat: float) -> tuple[np.ndarray, Back]:
        def probabilities(v: np.ndarray) -> tuple[np.ndarray, Back]:
            p = softmax(v / heat)
            return p, lambda g: p * (g - (g * p).sum(-1, keepdims=True)) / heat

        flat = lambda v: (v.reshape(len(v), -1), lambda g: g.reshape(v.shape))
        return self.sequence(
            x, lambda v: self.linear(v, f"{name}.project"), flat, lambda v: self.linear(v, f"{name}.first"), self.relu, self.dropped,
            lambda v: self.linear(v, f"{name}.second"), probabilities,
        )

    def encoder(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        def placed(v: np.ndarray) -> tuple[np.ndarray, Back]:
            def back(g: np.ndarray) -> np.ndarray:
                self._note("encoder.position", g.sum(0))
                return g

            return v + self.w["encoder.position"], back

        feed = lambda v: self.sequence(v, lambda u: self.linear(u, "encoder.feed1"), self.relu, lambda u: self.linear(u, "encoder.feed2"))
        return self.sequence(
            x, lambda v: self.linear(v, "encoder.embed"), placed, self.residual(self.attention), lambda v: self.layer_norm(v, "encoder.norm1"),
            self.residual(feed), lambda v: self.layer_norm(v, "encoder.norm2"), self.relu,
        )

    def run(self, spots: np.ndarray) -> tuple[list[np.ndarray], Callable[[list[np.ndarray]], None]]:
        """Probabilities (rows, 2) after the first block, after the second, and of the whole; the last is the result."""
        x, back_letters = self.sequence(spots, self.letters, self.relu)
        one, back_one = self.block(x, "block1")
        p1, back_p1 = self.classifier(one, "class1", 0.25)
        two, back_two = self.block(one, "block2")
        p2, back_p2 = self.classifier(two, "class2", 0.25)
        seen, back_seen = self.encoder(two)
        p3, back_p3 = self.classifier(seen, "class3", 1.0)

        def back(g: list[np.ndarray]) -> None:
            inner = back_two(back_seen(back_p3(g[2])) + back_p2(g[1])) + back_p1(g[0])
            back_letters(back_one(inner))

        return [p1, p2, p3], back


def loss(outputs: list[np.ndarray], labels: np.ndarray, share: float = 0.5) -> tuple[float, list[np.ndarray]]:
    """(sum over rows, gradients of the outputs): cross-entropy of the result, and for both early outputs ``share`` of theirs
    and the rest of how far the result diverges from them.

    Cross-entropy takes the probabilities through a softmax once more, as in the filter that this stands for.
    """
    hot = np.eye(2)[labels]
    total, grads = 0.0, [np.zeros_like(p) for p in outputs]
    for k, (p, part) in enumerate(zip(outputs, (share, share, 1.0), strict=True)):
        again = softmax(p)
        total += part * -np.log((again * hot).sum(1)).sum()
        grads[k] += part * (again - hot)
    last = np.maximum(outputs[2], 1e-300)
    for k in (0, 1):
        early = np.maximum(outputs[k], 1e-300)
        total += (1 - share) * (last * (np.log(last) - np.log(early))).sum()
        grads[k] += (1 - share) * -last / early
        grads[2] += (1 - share) * (np.log(last) - np.log(early) + 1)
    return float(total), grads


def scores(weights: Weights, shape: Shape, texts: list[str], at_once: int = 64) -> np.ndarray:
    """The chance of label 1 of each sequence."""
    out = [Pass(weights, shape).run(codes(texts[i : i + at_once], shape.length))[0][2][:, 1] for i in range(0, len(texts), at_once)]
    return np.concatenate([np.zeros(0), *out])


def score(rows: DataFrame, weights: Weights, shape: Shape, seq: str = "seq", name: str = "natural_score") -> DataFrame:
    """rows with the chance of label 1. Null and empty sequences are scored as letters that nobody knows."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(scores(sent.value, shape, texts.to_pylist()), pa.float64())

    return rows.withColumn(name, of(F.col(seq)))


def gradients(rows: DataFrame, weights: Weights, shape: Shape, seed: int | None = None, depth: int = 2, at_once: int = 64) -> tuple[int, float, Weights, Weights]:
    """(rows, loss, gradients, statistics) of rows (seq, label): means over all rows.

    A partition takes its rows ``at_once``, each with batch statistics of its own (weighted by rows in the mean), and sends
    one sum on.
    """
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def add(a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        return a[0] + b[0], a[1] + b[1], *({k: x[k] + y[k] for k in x} for x, y in zip(a[2:], b[2:], strict=True))

    def of(part: Iterator) -> Iterator[tuple]:
        total, held = (0, 0.0, {}, {}), []

        def done(total: tuple) -> tuple:
            texts, labels = zip(*held, strict=True)
            p = Pass(sent.value, shape, True, None if seed is None else hash((seed, total[0], labels)) % (1 << 32))
            outputs, back = p.run(codes(list(texts), shape.length))
            value, grads = loss(outputs, np.array(labels))
            back(grads)
            n = len(held)
            return add(total, (n, value, p.gradients, {k: v * n for k, v in p.statistics.items()}))

        for text, label in part:
            held.append((text, label))
            if len(held) == at_once:
                total, held = done(total), []
        if held:
            total = done(total)
        yield total

    none = (0, 0.0, {}, {})
    n, value, grads, stats = rows.select("seq", F.col("label").cast("int")).rdd.map(tuple).mapPartitions(of).treeReduce(add, depth) if rows.rdd.getNumPartitions() else none
    sent.unpersist()
    if not n:
        return none
    return n, value / n, {k: v / n for k, v in grads.items()}, {k: v / n for k, v in stats.items()}


@dataclass
class State:
    """Weights with Adam's moments, how many steps were made, and the best weights so far with their AUC."""

    weights: Weights
    first: Weights
    second: Weights
    steps: int = 0
    epoch: int = 0
    best: Weights | None = None
    best_auc: float = -1.0

    @classmethod
    def begin(cls, weights: Weights) -> State:
        zero = lambda: {k: np.zeros_like(v) for k, v in weights.items()}
        return cls(dict(weights), zero(), zero())

    def step(self, grads: Weights, statistics: Weights, rate: float, momentum: float = 0.1) -> None:
        """Adam with the usual decays; running means and variances move by ``momentum``."""
        self.steps += 1
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            size = np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8
            self.weights[k] = self.weights[k] - rate * self.first[k] / (1 - 0.9**self.steps) / size
        for k, v in statistics.items():
            self.weights[k] = (1 - momentum) * self.weights[k] + momentum * v


def train(
    rows: DataFrame, shape: Shape = Shape(), state: State | None = None, epochs: int = 30, batch: int = 256, rate: float = 1e-4, seed: int = 0,
    save: str | None = None,
) -> State:
    """Synchronous training on rows (seq, label, part: train or test), from new weights or from a state on.

    An epoch deals the training rows to steps of about ``batch`` rows by a hash of the epoch and the sequence; a step is a
    sum over its rows wherever they are. After each epoch the rows of the test part are scored, and the weights are kept
    if their AUC is the best so far (so also in ``save``, a folder that all can reach, where there is one). A state that is
    taken on goes through the same steps as one that was never put down.
    """
    data = checkpoint(rows.select("seq", "label", "part"))
    learn, test = data.where("part = 'train'"), data.where("part = 'test'")
    n = learn.count()
    state = state or State.begin(initial(shape, seed))
    steps = max(1, round(n / batch))
    for _ in range(epochs if n else 0):
        dealt = checkpoint(learn.withColumn("_step", F.pmod(F.xxhash64(F.lit(seed), F.lit(state.epoch), "seq"), F.lit(steps))))
        for k in range(steps):
            count, _, grads, stats = gradients(dealt.where(F.col("_step") == k), state.weights, shape, seed + state.steps)
            if count:
                state.step(grads, stats, rate)
        state.epoch += 1
        found = auc(score(test, state.weights, shape), "label", "natural_score").first()["auc"]
        if state.best is None or (found or 0.0) > state.best_auc:
            state.best, state.best_auc = dict(state.weights), found or 0.0
        if save:
            save_state(learn.sparkSession, state, shape, save)
    return state


def save_state(spark: SparkSession, state: State, shape: Shape, path: str) -> None:
    """The state as a table (kind, name, shape, values) in a folder; the one before it is replaced."""
    kinds = {"weights": state.weights, "first": state.first, "second": state.second, "best": state.best or {}}
    about = json.dumps({"shape": asdict(shape), "steps": state.steps, "epoch": state.epoch, "best_auc": state.best_auc})
    rows = [(kind, name, list(v.shape), v.astype("<f8").tobytes()) for kind, ws in kinds.items() for name, v in ws.items()] + [("about", about, [], b"")]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["kind", "name", "shape", "bytes"])
    spark.createDataFrame(table).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[State, Shape]:
    kinds: dict[str, Weights] = {"weights": {}, "first": {}, "second": {}, "best": {}}
    about = {}
    for r in spark.read.parquet(path).toLocalIterator():
        if r["kind"] == "about":
            about = json.loads(r["name"])
        else:
            kinds[r["kind"]][r["name"]] = np.frombuffer(bytes(r["bytes"]), "<f8").reshape(list(r["shape"])).copy()
    state = State(kinds["weights"], kinds["first"], kinds["second"], about["steps"], about["epoch"], kinds["best"] or None, about["best_auc"])
    return state, Shape(**about["shape"])
