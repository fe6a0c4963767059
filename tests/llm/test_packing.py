import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from junctura.llm import packing, queries
from tests.llm.edges import documents, nothing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity=1024, by=None):
    """rows: pieces with their places; texts: (id, text). Every token is placed once, in no more than its sequence."""
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_edges(spark):
    docs = documents(spark).unionByName(documents(spark, [(20, "hello <|endoftext|> world", "en", "a"), (21, "<|endoftext|><|endoftext|>", "en", "a")]))
    got = packing.pack(docs, PATH).collect()
    n = check(got, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(nothing(spark), PATH).count() == 0


def test_query(spark, sf):
    got = queries.QUERIES["op2_packing"](spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(got, texts) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_hot_length_is_dealt_in_parts(spark):
    rows = spark.range(5000).selectExpr("id", "cast(7 as long) as length").unionByName(spark.range(50).selectExpr("id", "cast(1000 as long) as length"))
    got = packing.place(rows, share=100).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 5050
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 1024 and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]


def one_by_one(lengths, capacity):
    """The method a bin at a time, on lists."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        used, rest, gap = [], [], capacity
        for x in left:
            (used if x <= gap else rest).append(x)
            gap -= x * (x <= gap)
        if gap and len(used) > 1 and rest:
            room = gap + used[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[i + 1 :] if a + b <= room]
            if pairs and max(pairs)[0] > used[-1]:
                best = max(p[0] for p in pairs)
                _, a, b = max((p for p in pairs if p[0] == best), key=lambda p: -min(p[1:]))
                rest += [used.pop()]
                rest.remove(a)
                rest.remove(b)
                used += [a, b]
        bins.append(sorted(used))
        left = sorted(rest, reverse=True)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_bins_are_those_of_single_steps(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 60))]
    got = [sorted(used) for times, used in packing.best_two_fit(dict(Counter(lengths)), 20) for _ in range(times)]
    assert sorted(x for b in got for x in b) == sorted(lengths)
    assert all(sum(b) <= 20 for b in got)
    assert sorted(got) == sorted(one_by_one(lengths, 20))


def test_encoder_is_the_tokenizers_library():
    e = packing.Encoder(PATH, 2)
    assert e.whole("a<|endoftext|>b") == Tokenizer.from_file(PATH).encode("a<|endoftext|>b", add_special_tokens=False).ids == [e.whole("a")[0], 50256, e.whole("b")[0]]
    letters = [chr(c) for c in range(0x500)] + [chr(c) for c in [*range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x4E2D, 0x1F600]]
    rng = random.Random(0)
    texts = [f(c) for c in letters for f in (lambda c: f"a{c} b{c}{c}", lambda c: f"  {c}\n{c}1", lambda c: f"it{c}s'll{c}")]
    texts += ["".join(rng.choice(letters) if rng.random() < 0.3 else rng.choice(" abcXYZ12\n'.,") for _ in range(40)) for _ in range(3000)]
    texts += ["<|endoftext|> x", "x <|endoftext|><|endoftext|>y", "<|endoftext", "|endoftext|>", "a" * 5000, " " * 5000, ""]
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert list(np.frombuffer(got, "<u4")[:-1]) == e.whole(text), repr(text)


def test_sequences(spark):
    docs = documents(spark)
    got = packing.sequences(docs, PATH).collect()
    assert sum(len(r.ids) for r in got) == sum(r.length for r in packing.pack(docs, PATH).collect())
    assert all(len(r.ids) == sum(r.lengths) <= 1024 for r in got)
