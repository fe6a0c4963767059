import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from junctura.functions import cigar, flags, sequences
from junctura.operators.breakpoints import alike


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


GOLDEN = [
    ("10M5I10M", [(20, 20, "M")], 25, 20),
    ("10M5D10M", [(25, 25, "M")], 20, 25),
    ("10M100N10M", [(20, 20, "M")], 20, 20),
    ("5H20M", [(20, 20, "M")], 20, 20),
    ("20S30M", [(20, 20, "S"), (50, 30, "M")], 50, 50),
    ("30M20S", [(30, 30, "M"), (50, 20, "S")], 50, 50),
    ("10M20S10M", [(10, 10, "M"), (30, 20, "S"), (40, 10, "M")], 40, 40),
    ("4=1X5M", [(10, 10, "M")], 10, 10),
    ("*", [], 0, 0),
    ("5D10M", [(15, 15, "M")], 10, 15),
]


@pytest.mark.parametrize("text, ops, given_length, length", GOLDEN)
def test_cigar(spark, text, ops, given_length, length):
    got = value(spark, cigar.normalise(F.lit(text), F.lit("A" * given_length)))
    assert [tuple(o) for o in got.ops] == ops and len(got.seq) == length


def test_random_cigars_keep_their_length(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(300):
        parts = [(rng.randint(1, 9), rng.choice("MMIDN=X")) for _ in range(rng.randint(1, 8))]
        text = "".join(f"{n}{op}" for n, op in parts)
        seq = "".join(rng.choices("ACGT", k=sum(n for n, op in parts if op in "MI=X")))
        at, out = 0, ""
        for n, op in parts:
            out += seq[at : at + n] if op in "M=X" else "N" * n if op == "D" else ""
            at += n if op in "MI=X" else 0
        rows.append((text, seq, out))
    got = spark.createDataFrame(rows, "c string, s string, want string").withColumn("n", cigar.normalise("c", "s")).collect()
    for r in got:
        assert r.n.seq == r.want
        assert sum(o.len for o in r.n.ops) == len(r.want)
        assert all(a.op != b.op for a, b in zip(r.n.ops, r.n.ops[1:], strict=False))


def test_clips(spark):
    for text, kind, long, at in (("14S30M", "SM", False, 100), ("15S30M", "SM", True, 100), ("30M15S", "MS", True, 129), ("30M14S", "MS", False, 129), ("20S20S", "MS", True, 119)):
        ops = cigar.cumulate(cigar.parse(F.lit(text)))
        assert value(spark, F.struct(cigar.clip_type(ops), cigar.long_clip(ops), cigar.breakpoint(ops, F.lit(100)))) == (kind, long, at)
    assert value(spark, cigar.extent(cigar.parse(F.lit("10S50M")), F.lit(100))) == (105, 144)
    assert value(spark, cigar.extent(cigar.parse(F.lit("10S")), F.lit(100))) is None
    assert value(spark, cigar.soften(F.lit("5H20M3H"))) == "5S20M3H"


def test_flags(spark):
    rows = spark.range(1024).withColumn("f", F.col("id").cast("int"))
    got = rows.select("f", flags.anchored_mate("f"), flags.unmapped_mate("f"), flags.primary("f"), flags.is_reverse("f")).collect()
    for f, a, b, c, d in got:
        assert (a, b, c, d) == (f & 8 == 8 and f & 260 == 0, f & 4 == 4 and f & 264 == 0, f & 772 == 0, f & 16 != 0)


def test_sequences(spark):
    assert value(spark, sequences.revcomp(F.lit("ATGCNH"))) == "HNGCAT"
    assert value(spark, sequences.revcomp(sequences.revcomp(F.lit("ATTGCCA")))) == "ATTGCCA"
    assert value(spark, sequences.junction(F.lit("A" * 120), F.lit("C" * 3))) == "A" * 100 + "H" + "CCC" + "N" * 97
    assert value(spark, sequences.identity(F.lit("AAAA"), F.lit(""))) is None
    ten, nine = "A" * 10, "A" * 9 + "T"
    # exactly nine in ten is not more than 0.9
    assert value(spark, sequences.similar(F.lit(ten), F.lit(ten), F.lit(nine[::-1]), F.lit(ten))) is False
    assert value(spark, sequences.similar(F.lit("A" * 11), F.lit(ten), F.lit("T" + "A" * 10), F.lit(ten))) is True
    assert value(spark, sequences.similar(F.lit(""), F.lit(ten), F.lit(ten), F.lit(ten))) is False
    middle = lambda m1, m2: value(spark, sequences.similar_with_middle(*map(F.lit, (ten, ten, m1, ten, ten, m2))))
    assert (middle("AAA", ""), middle("AAAA", ""), middle("AC", "AC"), middle("AC", "GT")) == (True, False, True, False)
    assert value(spark, sequences.anchor_sides(F.lit("ACGTACGTAC"), F.lit(5), F.lit("SM"), 3)) == ("CGT", "ACG")
    assert value(spark, sequences.anchor_sides(F.lit("ACGTACGTAC"), F.lit(5), F.lit("MS"), 3)) == ("GTA", "CGT")
    assert value(spark, sequences.codes(F.lit("ATGCHx"))) == [0, 1, 2, 3, 4, 0]
    assert value(spark, sequences.one_hot(F.lit("aN"))) == [[1, 0, 0, 0, 0, 0], [0] * 6]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.text("ACGT", max_size=12)] * 4, st.integers(-3, 3)), min_size=1, max_size=20))
def test_similarity_of_columns_and_strings(spark, rows):
    for shift in {r[4] for r in rows}:
        df = spark.createDataFrame([r for r in rows if r[4] == shift], "a string, b string, c string, d string, k int")
        for r in df.withColumn("v", sequences.similar("a", "b", "c", "d", 0.6, shift)).collect():
            assert r.v == alike(r.a, r.b, r.c, r.d, 0.6, shift)
