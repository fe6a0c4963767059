import random

from pyspark.sql import functions as F

from junctura.operators import exons, intervals, similarity
from junctura.operators.ranks import global_rank


def randoms(seed, n=300, top=3000, longest=60):
    rng = random.Random(seed)
    return [(rng.choice(["c1", "c2"]), s, s + rng.randint(0, longest), rng.choice("xyz")) for s in (rng.randint(1, top) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, gene_id string").withColumn("gene_name", F.col("gene_id"))


def test_overlaps_are_those_of_all_pairs(spark):
    a, b = randoms(1), randoms(2, 200)
    want = [(x, y) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]]
    for size in (16, 1000):
        got = intervals.overlap_pairs(frame(spark, a), frame(spark, b), size=size)
        assert sorted((tuple(r)[:4], (r.b_chrom, r.b_start, r.b_end, r.b_gene_id)) for r in got.collect()) == sorted(want)
        hit = sorted(x for x in a if any(x == p for p, _ in want))
        assert sorted(tuple(r)[:4] for r in intervals.overlapping(frame(spark, a), frame(spark, b), size=size).collect()) == hit
        assert intervals.overlapping(frame(spark, a), frame(spark, b), size=size, how="left_anti").count() == len(a) - len(hit)


def test_islands(spark):
    rows = [("c", 1, 5, "x"), ("c", 5, 9, "x"), ("c", 10, 12, "x"), ("c", 14, 20, "x"), ("c", 2, 3, "y"), ("c", 1, 100, "z")]
    got = intervals.islands(frame(spark, rows), ["chrom", "gene_id"]).collect()
    assert sorted((r.gene_id, r.start, r.end, r.n) for r in got) == [("x", 1, 9, 2), ("x", 10, 12, 1), ("x", 14, 20, 1), ("y", 2, 3, 1), ("z", 1, 100, 1)]
    assert intervals.islands(frame(spark, rows), ["chrom", "gene_id"], slack=1).where("gene_id = 'x'").count() == 2
    rows, want = sorted(randoms(3)), []
    for c, s, e, _ in rows:
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1][2:] = [max(e, want[-1][2]), want[-1][3] + 1]
        else:
            want.append([c, s, e, 1])
    got = intervals.islands(frame(spark, rows), ["chrom"]).collect()
    assert sorted((r.chrom, r.start, r.end, r.n) for r in got) == sorted(map(tuple, want))
    for c in {r.chrom for r in got}:  # numbered from 1 in order
        assert [r.island for r in sorted((r for r in got if r.chrom == c), key=lambda r: r.start)] == list(range(1, 1 + sum(r.chrom == c for r in got)))


def test_windows_are_widened_until_a_walk_has_enough(spark):
    """Exons of one base each: a walk of 100 bases needs a hundred of them on either side."""
    rows = [("c", 20 * i, 20 * i, "g") for i in range(1, 301)]
    model = exons.ordinals(frame(spark, rows).withColumn("gene_name", F.col("gene_id")))
    spots = spark.createDataFrame([("c", 20 * 150), ("c", 20), ("c", 20 * 300)], "chrom string, pos long")
    got = {r.pos: (len(r.left), len(r.right)) for r in exons.walk(spots, model, 100).collect()}
    assert got == {3000: (100, 100), 20: (0, 100), 6000: (100, 1)}


def test_pieces_of_sequences(spark):
    rng = random.Random(5)
    seqs = {f"c{n}": "".join(rng.choices("ACGT", k=n)) for n in (1, 99, 100, 101, 110, 111, 999, 1000, 1001)}
    genome = spark.createDataFrame([*seqs.items(), ("none", "")], "chrom string, seq string")
    chunks = {(r.chrom, r.chunk): r.seq for r in intervals.chunked(genome, 100).collect()}
    assert chunks == {(c, i): s[100 * i : 100 * i + 100] for c, s in seqs.items() for i in range(-(-len(s) // 100))}
    tiles = {(r.chrom, r.offset): r.seq for r in similarity.tiles(genome, 110, 10).collect()}
    assert tiles == {(c, 100 * i): s[100 * i : 100 * i + 110] for c, s in seqs.items() for i in range(max(1, -(-(len(s) - 10) // 100)))}


def brute_model(rows, greedy=()):
    out = []
    for c, s, e, g in sorted(rows):
        if out and out[-1][0] == c and out[-1][2] >= s and (out[-1][3] == g or out[-1][3] in greedy):
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e, g])
    return sorted(map(tuple, out))


def test_exon_models(spark):
    # another gene's row between two exons of one gene keeps them apart
    rows = [("c", 1, 10, "a"), ("c", 5, 12, "b"), ("c", 8, 20, "a"), ("c", 30, 40, "a"), ("c", 40, 50, "a")]
    assert sorted((r.chrom, r.start, r.end, r.gene_id) for r in exons.exon_model(frame(spark, rows)).collect()) == brute_model(rows)
    for seed in range(3):
        rows = randoms(seed, 200, 1500)
        got = exons.exon_model(frame(spark, rows)).collect()
        assert sorted((r.chrom, r.start, r.end, r.gene_id) for r in got) == brute_model(rows)
        assert sorted(r.exon_num for r in got if r.chrom == "c1") == list(range(sum(r.chrom == "c1" for r in got)))
        loci = (("c1", 500, 700, "LOCUS"),)
        got = exons.exon_model(frame(spark, rows), loci).collect()
        assert sorted((r.chrom, r.start, r.end, r.gene_id) for r in got) == brute_model(rows + [("c1", 500, 700, "LOCUS")], ("LOCUS",))


def probe(model, chrom, s, e, slack=10):
    own = sorted(x for x in model if x[0] == chrom)
    if not own or chrom == "chrM":
        return None
    m = max([i for i, x in enumerate(own) if x[1] <= s], default=0)
    for i in [m, m - 1, *range(m + 1, len(own))]:
        if i < 0 or (i > m and own[i][1] - slack > s):
            continue
        if own[i][1] - slack <= s and own[i][2] + slack >= e:
            return i
    return None


def test_exon_lookup(spark):
    model = [("c", 100, 200, "a"), ("c", 120, 130, "b"), ("c", 140, 150, "c"), ("c", 300, 320, "d"), ("chrM", 1, 50, "m")]
    asked = [("c", 110, 115), ("c", 90, 95), ("c", 89, 95), ("c", 200, 210), ("c", 205, 211), ("c", 160, 170), ("c", 145, 148), ("c", 292, 300), ("c", 1, 2), ("chrM", 5, 6), ("none", 1, 2)]
    rng = random.Random(4)
    cases = [(model, asked)] + [(sorted({x[:3] + (x[3],) for x in randoms(k, 120, 2500)}), [(rng.choice(["c1", "c2"]), s, s + rng.randint(0, 30)) for s in (rng.randint(1, 2600) for _ in range(300))]) for k in range(3)]
    for rows, queries in cases:
        table = exons.ordinals(frame(spark, rows))
        for size in (64, 1 << 14):
            q = spark.createDataFrame(queries, "chrom string, start long, end long")
            got = [((r.chrom, r.start, r.end), r.exon and r.exon.exon_num) for r in exons.lookup(q, table, size=size).collect()]
            assert sorted(got, key=repr) == sorted([(x, probe(rows, *x)) for x in queries], key=repr)


def test_walk_covers_at_most_its_length(spark):
    rows = sorted(set(randoms(7, 60, 2000)))
    table = exons.ordinals(frame(spark, rows))
    spots = spark.createDataFrame([(c, p) for c in ("c1", "c2") for p in range(1, 2000, 17)], "chrom string, pos long")
    for r in exons.walk(spots, table, 50).collect():
        for side in (r.left, r.right):
            assert sum(s.end - s.start for s in side) <= 50 and all(s.start < s.end for s in side)
        assert all(s.end <= r.pos - 1 for s in r.left) and all(s.start >= r.pos - 1 for s in r.right)
        assert r.exon is not None or not (r.left or r.right)


def test_extract(spark):
    rng = random.Random(5)
    genome = {"c1": "".join(rng.choices("ACGT", k=5000)), "c2": "ACGT"}
    chunks = intervals.chunked(spark.createDataFrame(list(genome.items()), "chrom string, seq string"), 256)
    asked = [(i, "c1", s, s + n, "+-"[i % 2]) for i, (s, n) in enumerate((rng.randint(1, 4000), rng.randint(0, 900)) for _ in range(100))] + [(900, "c2", 2, 99, "+"), (901, "gone", 1, 5, "+"), (902, "c1", 4990, 6000, "+")]
    got = intervals.extract(spark.createDataFrame(asked, "id int, chrom string, start long, end long, strand string"), chunks, ["id"], 256, "strand").collect()
    assert len(got) == len(asked)
    for r in got:
        want = genome.get(r.chrom, "")[r.start - 1 : r.end]
        assert r.seq == (want if r.strand == "+" else want[::-1].translate(str.maketrans("ACGT", "TGCA")))


def test_gap_components(spark):
    got = intervals.gap_components(spark.createDataFrame([("a", p) for p in (1, 4, 7, 11, 11, 14)], "g string, p long"), ["g"], "p", 3).orderBy("p").collect()
    assert [(r.p, r.component) for r in got] == [(1, 1), (4, 1), (7, 1), (11, 2), (14, 2)]


def test_ranks_of_one_large_group(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then null else 'g' end as g", "(id * 7919) % 20011 as o")
    got = global_rank(rows.repartition(7), ["g"], ["o", "id"])
    for g in (None, "g"):
        own = got.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("o", "id").select("rank").collect()
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
