"""Queries over what stands for split reads, junctions and candidates, beside those of catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import sequences
from junctura.operators import breakpoints, candidates, chimeras, exons, pairs, realign
from junctura.plans.catalogue import EX, HIT, SEQS, gm, query, seqs, table

# Reads of four junctions that share no letters near the breakpoint: parts of longer and shorter reach.
_LEFT = [("ACGTTGCA" * 5)[i : i + 29] + x for i, x in enumerate("ACGT")]
_RIGHT = [x + ("TTGACCGA" * 5)[3 * i : 3 * i + 29] for i, x in enumerate("GTAC")]
_LISTS = f"CAST({_LEFT} AS VARCHAR[]) AS ls, CAST({_RIGHT} AS VARCHAR[]) AS rs"
SPLITS = f"""sp AS (SELECT 's' || l_suppkey % 3 AS sample, l_orderkey || '/' || l_linenumber AS read_name, l_partkey * 10 AS bp, l_linenumber % 4 AS t,
 right(ls[l_linenumber % 4 + 1], 10 + CAST(l_quantity AS INTEGER) % 20) AS l, left(rs[l_linenumber % 4 + 1], CAST(10 + l_orderkey % 20 AS INTEGER)) AS r FROM (SELECT *, {_LISTS} FROM lineitem))"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("l_linenumber") % 4
    pick = lambda texts: F.get(F.array(*[F.lit(x) for x in texts]), t)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("sample"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("read_name"),
        F.lit("g").alias("chrom"), (F.col("l_partkey") * 10).alias("breakpoint"), F.lit("MS").alias("type"),
        F.right(pick(_LEFT), 10 + F.col("l_quantity").cast("int") % 20).alias("seq_left"), F.left(pick(_RIGHT), (10 + F.col("l_orderkey") % 20).cast("int")).alias("seq_right"),
    )


@query(f"""WITH {SPLITS} SELECT sample, bp AS breakpoint, arg_max(l, length(l)) AS seq_left, arg_max(r, length(r)) AS seq_right, count(*) AS cnt, string_agg(read_name, ';' ORDER BY read_name) AS reads FROM sp GROUP BY sample, bp, t""")
def compatible_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = breakpoints.merge_compatible(splits(spark, sf_dir))
    return x.select("sample", "breakpoint", "seq_left", "seq_right", "cnt", F.array_join("reads", ";").alias("reads"))


@query(f"""WITH {SPLITS} SELECT sample, bp AS breakpoint, count(*) AS cnt, arg_max(l, length(l)) AS seq_left, arg_max(r, length(r)) AS seq_right FROM sp GROUP BY sample, bp, t""")
def split_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their consensus: the letters of a junction as far as any of its reads goes."""
    return breakpoints.clusters(splits(spark, sf_dir)).select("sample", "breakpoint", "cnt", "seq_left", "seq_right")


@query(f"""WITH {EX}, q AS (SELECT l_orderkey AS read, CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_partkey % 500 AS exon_num FROM lineitem),
o AS (SELECT *, coalesce(sum("end" - "start" + 1) OVER (PARTITION BY chrom, gene_id ORDER BY exon_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ex),
d AS (SELECT DISTINCT chrom, gene_id, exon_num, "start" + 2 AS s, "start" + 9 AS e, off + 2 AS a, off + 9 AS z FROM q JOIN o USING (chrom, exon_num)),
n AS (SELECT *, coalesce(CAST(a - max(z) OVER w > 40 AND s - max(e) OVER w > 100 AS INTEGER), 1) AS new FROM d WINDOW w AS (PARTITION BY chrom, gene_id ORDER BY a, z, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(new) OVER (PARTITION BY chrom, gene_id ORDER BY a, z, s ROWS UNBOUNDED PRECEDING) AS block FROM n),
c AS (SELECT chrom, exon_num, count(*) AS k FROM q GROUP BY ALL)
SELECT chrom, gene_id, CAST(block AS BIGINT) AS block, min(s) AS "start", max(e) AS "end", min(exon_num) AS min_exon, max(exon_num) AS max_exon, CAST(sum(k) AS BIGINT) AS n FROM b JOIN c USING (chrom, exon_num) GROUP BY ALL""")
def spanning_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds in exons, joined along the exons of their gene."""
    ex = exons.ordinals(gm(spark, sf_dir))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("read_name"), (F.col("l_suppkey") % 5).cast("string").alias("chrom"), (F.col("l_partkey") % 500).alias("exon_num"))
    seeds = q.join(ex, ["chrom", "exon_num"]).select(F.lit("s").alias("sample"), "read_name", "chrom", "gene_id", "gene_name", "exon_num", (F.col("start") + 2).alias("start"), (F.col("start") + 9).alias("end"))
    x = pairs.blocks(seeds, ex, gap=40, extend=None)
    return x.select("chrom", "gene_id", "block", "start", "end", "min_exon", "max_exon", F.col("count").alias("n"))


_FINE = """q AS (SELECT l_orderkey // 2 AS read, CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_orderkey * 20 + l_partkey % 8 AS "start", l_orderkey * 20 + l_partkey % 8 + CAST(l_quantity AS BIGINT) % 8 + CASE WHEN l_partkey % 10 = 0 THEN 300 ELSE 0 END AS "end", 25 + (l_orderkey // 2) % 10 AS l, 30 + (l_orderkey // 2) % 7 AS r,
 CASE WHEN (l_orderkey // 2) % 2 = 0 THEN 'MS' ELSE 'SM' END AS type, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 8 ELSE 20 + l_partkey % 18 END AS s, CASE WHEN l_linenumber % 3 = 0 THEN 60 + l_suppkey % 8 ELSE 20 + l_suppkey % 20 END AS e, row_number() OVER () AS id FROM lineitem),
role AS (SELECT *, CASE WHEN type = 'MS' THEN CASE WHEN s <= l // 2 AND e >= l + 5 THEN 'bad' WHEN abs(s - l) <= 5 AND e >= l + r - 5 THEN 'block' WHEN s <= 5 AND e <= l + 5 THEN 'good' END
 ELSE CASE WHEN abs(e - l) <= 5 AND s <= 5 THEN 'block' WHEN s < l - 5 AND e >= l + r // 2 THEN 'bad' WHEN abs(s - l) <= 5 AND e >= l + r - 5 THEN 'good' END END AS role FROM q WHERE "end" - "start" <= 200)"""


@query(f"""WITH {EX}, {_FINE}{HIT}, x AS (SELECT role.*, h.exon_num, h.gene_id, coalesce(CAST(h.gene_id AS INTEGER) < 48, false) AS homolog FROM role LEFT JOIN h USING (id) WHERE role IS NOT NULL),
v AS (SELECT read FROM x GROUP BY read HAVING NOT bool_or(role = 'bad') AND bool_or(role = 'good' AND homolog))
SELECT DISTINCT CAST(read AS VARCHAR) AS read_name, chrom, "start", "end", gene_id, exon_num FROM x JOIN v USING (read) WHERE role = 'block' AND NOT homolog AND exon_num IS NOT NULL""")
def fine_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of clipped parts, of reads that no hit explains as a whole and whose other part lies in a known gene."""
    read = F.expr("l_orderkey div 2")
    start = F.col("l_orderkey") * 20 + F.col("l_partkey") % 8
    s = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 8).otherwise(20 + F.col("l_partkey") % 18)
    e = F.when(F.col("l_linenumber") % 3 == 0, 60 + F.col("l_suppkey") % 8).otherwise(20 + F.col("l_suppkey") % 20)
    x = table(spark, sf_dir, "lineitem")
    hits = x.select(F.lit("s").alias("sample"), read.cast("string").alias("read_name"), (F.col("l_suppkey") % 5).cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 8 + F.when(F.col("l_partkey") % 10 == 0, 300).otherwise(0)).alias("end"), s.alias("q_start"), e.alias("q_end"))
    part = lambda n, op: F.struct(n.cast("int").alias("cum"), n.cast("int").alias("len"), op.alias("op"))
    first, second = F.when(read % 2 == 0, "M").otherwise("S"), F.when(read % 2 == 0, "S").otherwise("M")
    reads = x.select(F.lit("s").alias("sample"), read.cast("string").alias("read_name"), F.array(part(25 + read % 10, first), part(30 + read % 7, second)).alias("ops")).distinct()
    known = gm(spark, sf_dir).where(F.col("gene_id").cast("int") < 48).select("gene_id")
    return pairs.fine_hits(reads, hits, exons.ordinals(gm(spark, sf_dir)), known, size=512).select("read_name", "chrom", "start", "end", "gene_id", "exon_num")


_MOVES = """m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'SM' ELSE 'MS' END AS type, l_partkey % 9 AS added, l_suppkey % 10 AS q_start, 38 + l_partkey % 12 AS q_end, l_returnflag || repeat('AC', 10) AS l, repeat('GT', 10) || l_linestatus AS r, l_partkey AS bp FROM lineitem),
v AS (SELECT *, CAST(CASE WHEN type = 'SM' THEN greatest(q_end - 40, 0) ELSE -greatest(added - q_start, 0) END AS INTEGER) AS shift FROM m)"""


@query(f"""WITH {_MOVES} SELECT l_orderkey, l_linenumber, shift, bp + shift AS breakpoint, CASE WHEN shift > 0 THEN l || left(r, shift) WHEN shift < 0 THEN left(l, length(l) + shift) ELSE l END AS seq_left,
 CASE WHEN shift > 0 THEN substr(r, shift + 1) WHEN shift < 0 THEN right(l, -shift) || r ELSE r END AS seq_right FROM v""")
def breakpoint_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SM").otherwise("MS")
    x = table(spark, sf_dir, "lineitem").withColumn("split_id", F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
    moves = x.select("split_id", realign.shift_of(kind, (F.col("l_partkey") % 9), F.col("l_suppkey") % 10, 38 + F.col("l_partkey") % 12, F.lit(40)).alias("shift")).distinct()
    clusters = x.select("split_id", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("breakpoint"), F.concat("l_returnflag", F.lit("AC" * 10)).alias("seq_left"), F.concat(F.lit("GT" * 10), "l_linestatus").alias("seq_right"))
    return realign.shifted(clusters, moves).select("l_orderkey", "l_linenumber", "shift", "breakpoint", "seq_left", "seq_right")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'SM' ELSE 'MS' END AS type, l_returnflag || 'ACGTACGT' AS l, 'TTGCATGC' || l_linestatus AS r, CAST(l_partkey % 4 AS INTEGER) AS i, CAST(l_suppkey % 3 AS INTEGER) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN type = 'SM' THEN left(substr(l, i + 1), length(l) - i - k) ELSE l END AS seq_left, CASE WHEN type = 'SM' THEN right(substr(l, i + 1), k) ELSE left(r, i) END AS seq_mid,
 CASE WHEN type = 'SM' THEN r ELSE left(substr(r, i + 1), length(r) - i - k) END AS seq_right FROM c""")
def trimmed_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SM").otherwise("MS")
    cut = candidates.trim(kind, F.concat("l_returnflag", F.lit("ACGTACGT")), F.concat(F.lit("TTGCATGC"), "l_linestatus"), (F.col("l_partkey") % 4).cast("int"), (F.col("l_suppkey") % 3).cast("int"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cut.alias("t"))
    return x.select("l_orderkey", "l_linenumber", F.col("t.left").alias("seq_left"), F.col("t.mid").alias("seq_mid"), F.col("t.right").alias("seq_right"))


@query(f"""WITH {SEQS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'SM' ELSE 'MS' END AS type, substr(seq, greatest(b - 100, 1), greatest(b - greatest(b - 100, 1), 0)) AS left_part, substr(seq, b, 100) AS right_part
FROM (SELECT *, doc_id % 300 + 1 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS b FROM seqs)""")
def anchor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "SM").otherwise("MS")
    at = (F.col("doc_id") % 300 + 1).cast("int")
    x = seqs(spark, sf_dir).select("doc_id", kind.alias("type"), sequences.anchor_sides("seq", at, kind).alias("s"))
    return x.select("doc_id", "type", F.col("s.left").alias("left_part"), F.col("s.right").alias("right_part"))


_SAME = "len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda x: x[1] = x[2] AND x[1] <> ''))"
_ALIKE = "(length({a}) > 0 AND length({b}) > 0 AND " + _SAME + " > 0.9 * least(length({a}), length({b})))"


@query(f"""WITH p AS (SELECT a.p_partkey, a.p_type AS l1, b.p_type AS l2, a.p_name AS r1, b.p_name AS r2, left(a.p_brand, CAST(a.p_partkey % 4 AS INTEGER)) AS m1, left(b.p_brand, CAST(b.p_size % 5 AS INTEGER)) AS m2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, {_ALIKE.format(a='reverse(l1)', b='reverse(l2)')} AND {_ALIKE.format(a='r1', b='r2')} AND CASE WHEN m1 <> '' AND m2 <> '' THEN {_SAME.format(a='m1', b='m2')} >= 0.9 * least(length(m1), length(m2)) ELSE greatest(length(m1), length(m2)) <= 3 END AS alike FROM p""")
def middle_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select("p_partkey", F.col("p_type").alias("l1"), F.col("p_name").alias("r1"), F.left("p_brand", (F.col("p_partkey") % 4).cast("int")).alias("m1"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("l2"), F.col("p_name").alias("r2"), F.left("p_brand", (F.col("p_size") % 5).cast("int")).alias("m2"))
    return a.join(b, "p_partkey").select("p_partkey", sequences.similar_with_middle("l1", "r1", "m1", "l2", "r2", "m2").alias("alike"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads with two parts in genes."""
    p, o, n, q = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
    chrom = lambda k: F.concat(F.lit("chr"), (F.col("l_suppkey") % k).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", o.cast("string"), n.cast("string")).alias("read_name"), o, n, (n % 2 == 0).alias("reverse"), F.lit("AACG").alias("seq"), F.lit("GX").alias("gene_x"), F.lit("GY").alias("gene_y"), (p % 6).alias("plus"),
        F.struct(chrom(3).alias("chrom"), (p * 50).alias("pos"), (p * 50 + q).alias("right"), F.when(n % 3 == 0, "MS").otherwise("SM").alias("shape")).alias("x"),
        F.struct(chrom(2).alias("chrom"), (o * 10).alias("pos"), (o * 10 + 60 - q).alias("right"), F.when(n % 3 == 0, "SM").otherwise("MS").alias("shape"), F.when(p % 2 == 0, "+").otherwise("-").alias("strand")).alias("y"),
    )


_PARTS = """p AS (SELECT l_orderkey AS o, l_linenumber AS n, 'chr' || l_suppkey % 3 AS xc, l_partkey * 50 AS xp, l_partkey * 50 + CAST(l_quantity AS BIGINT) AS xr, 'chr' || l_suppkey % 2 AS yc, l_orderkey * 10 AS yp, l_orderkey * 10 + 60 - CAST(l_quantity AS BIGINT) AS yr,
 l_linenumber % 3 = 0 AS head, l_linenumber % 2 = 0 AS back, l_partkey % 2 = 0 AS fwd, l_partkey % 6 AS plus FROM lineitem)"""


@query(f"WITH {_PARTS} SELECT o AS l_orderkey, n AS l_linenumber FROM p WHERE xc <> yc OR abs(xp - yp) >= 10000")
def chimera_distant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chimeras.distant(_parts(spark, sf_dir)).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_PARTS}, e AS (SELECT *, CASE WHEN head AND NOT back THEN (xc, xr) WHEN head THEN (yc, CASE WHEN fwd THEN yr - plus ELSE yp + plus END) WHEN NOT back THEN (yc, yr - plus) ELSE (xc, xp) END AS f,
 CASE WHEN head AND NOT back THEN (yc, CASE WHEN fwd THEN yp + plus ELSE yr - plus END) WHEN head THEN (xc, xr) WHEN NOT back THEN (xc, CASE WHEN fwd THEN xp ELSE xr END) ELSE (yc, CASE WHEN fwd THEN yp ELSE yr - plus END) END AS s FROM p)
SELECT o AS l_orderkey, n AS l_linenumber, f[1] || ':' || f[2] AS first_place, s[1] || ':' || s[2] AS second_place, CASE WHEN back THEN 'CGTT' ELSE 'AACG' END AS read_seq FROM e""")
def chimera_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = chimeras.ends(_parts(spark, sf_dir))
    place = lambda n: F.concat_ws(":", f"{n}.chrom", F.col(f"{n}.pos").cast("string")).alias(f"{n}_place")
    return x.select("l_orderkey", "l_linenumber", place("first"), place("second"), "read_seq")
