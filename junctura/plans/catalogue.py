"""The operators as queries over the driver's tables, each beside the SQL that gives the same rows.

The tables hold no sequencing data, so each query derives what its operator takes from one of them: intervals from line
items, gene models from orders, sequences from texts, alignments from quantities, predictions from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import cigar, flags, sequences
from junctura.operators import breakpoints, candidates, chimeras, evidence, exons, intervals, pairs, ranks, realign, sampling, similarity
from junctura.sources import sequences as fasta
from junctura.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What stands for genomic tables -------------------------------------------------------------------------------------

IV = """iv AS (SELECT l_suppkey % 5 AS chrom, l_orderkey * 20 AS "start", l_orderkey * 20 + CAST(l_quantity AS BIGINT) AS "end", l_partkey % 3 AS gene,
 l_suppkey AS s, l_linenumber AS n, l_partkey AS p FROM lineitem)"""
GM = """gm AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS chrom, o_orderkey * 20 AS "start", o_orderkey * 20 + 10 + o_custkey % 37 AS "end", CAST(o_custkey % 97 AS VARCHAR) AS gene_id FROM orders)"""
EX = GM + """, ex AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY "start", "end", gene_id) - 1 AS exon_num FROM gm)"""
SPOTS = """q AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_orderkey * 20 + l_partkey % 20 AS "start", l_orderkey * 20 + l_partkey % 20 + CAST(l_quantity AS BIGINT) % 8 AS "end", row_number() OVER () AS id FROM lineitem)"""
HIT = """, st AS (SELECT chrom, "start", max(exon_num) AS exon_num FROM ex GROUP BY ALL),
m AS (SELECT q.*, coalesce(st.exon_num, 0) AS m FROM q ASOF LEFT JOIN st ON q.chrom = st.chrom AND q."start" >= st."start"),
pr AS (SELECT m.id, m."start" AS qs, m."end" AS qe, m.m - ex.exon_num AS k, ex.* FROM m JOIN ex ON ex.chrom = m.chrom AND ex.exon_num IN (m.m, m.m - 1)
 UNION ALL SELECT m.id, m."start", m."end", ex.exon_num - m.m + 1, ex.* FROM (SELECT *, unnest(range("start" - 10, "start" + 11)) AS w FROM m) m JOIN ex ON ex.chrom = m.chrom AND ex."start" = m.w AND ex.exon_num > m.m),
h AS (SELECT id, arg_min(exon_num, k) AS exon_num, arg_min("start", k) AS es, arg_min("end", k) AS ee, arg_min(gene_id, k) AS gene_id FROM pr WHERE "start" - 10 <= qs AND "end" + 10 >= qe GROUP BY id)"""
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
SEQ = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"
SEQS = f"seqs AS (SELECT doc_id, lang, source, {SEQ} AS seq FROM documents)"
RC = "translate(reverse(seq), 'ATGC', 'TACG')"
ALN = """aln AS (SELECT l_orderkey AS read, l_linenumber AS n, l_partkey AS p, (l_partkey * 37 + l_linenumber) % 1024 AS flag, l_orderkey AS pos,
 CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN q || 'M' || (60 - q) || 'S' WHEN 1 THEN q || 'S' || (60 - q) || 'M' WHEN 2 THEN '10M5I' || q || 'M' WHEN 3 THEN '10M5D' || q || 'M'
 WHEN 4 THEN '10M100N' || q || 'M20S' WHEN 5 THEN '5H20M' WHEN 6 THEN q || 'S30M20S' ELSE q || 'M' END AS cigar FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem))"""
PARTS = r"""x AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[MD=X]', 1), lambda v: CAST(v AS BIGINT))), 0) AS matched,
 CAST('0' || regexp_extract(cigar, '^(\d+H)?(\d+)S', 2) AS BIGINT) AS left_clip, CAST('0' || regexp_extract(cigar, 'M(\d+)S$', 1) AS BIGINT) AS right_clip FROM aln)"""
EV = """ev AS (SELECT event_id AS id, user_id AS sample, event_type AS fusion, CAST(floor(value) AS BIGINT) % 30 AS spanning, CAST(floor(value * 3) AS BIGINT) % 30 AS split, (CAST(floor(value * 7) AS BIGINT) % 101) / 100.0::DOUBLE AS score FROM events)"""


def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_orderkey") * 20
    end = start + F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), start.alias("start"), end.alias("end"), (F.col("l_partkey") % 3).alias("gene"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))


def gm(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, c = F.col("o_orderkey") * 20, F.col("o_custkey")
    gene = (c % 97).cast("string")
    return table(spark, sf_dir, "orders").select((c % 5).cast("string").alias("chrom"), start.alias("start"), (start + 10 + c % 37).alias("end"), gene.alias("gene_id"), gene.alias("gene_name"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_orderkey") * 20 + F.col("l_partkey") % 20
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 8).alias("end"))


def as_sequence(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), LETTERS, BASES)


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", as_sequence(F.col("text")).alias("seq"))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int"), (F.col("l_partkey") + F.col("l_linenumber")) % 8
    own, rest = q.cast("string"), (60 - q).cast("string")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    shapes = [text(own, "M", rest, "S"), text(own, "S", rest, "M"), text("10M5I", own, "M"), text("10M5D", own, "M"), text("10M100N", own, "M20S"), F.lit("5H20M"), text(own, "S30M20S"), text(own, "M")]
    c = shapes[7]
    for i, s in enumerate(shapes[:7]):
        c = F.when(k == i, s).otherwise(c)
    flag = ((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 1024).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), flag.alias("flag"), F.col("l_orderkey").alias("pos"), c.alias("cigar"), F.lit("ACGT" * 40).alias("seq"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda x: F.floor(x).cast("long")
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("sample"), F.col("event_type").alias("fusion"), (whole(v) % 30).alias("spanning"), (whole(v * 3) % 30).alias("split"), (whole(v * 7) % 101 / 100.0).alias("score")
    )


# Flags and CIGAR strings --------------------------------------------------------------------------------------------


def _flag_query(name: str, predicate: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aln(spark, sf_dir).where(predicate("flag")).select("read", "n", F.col("flag").cast("long").alias("flag"), flags.is_reverse("flag").alias("is_reverse"))

    QUERIES[name] = run
    SQL[name] = f"WITH {ALN} SELECT read, n, CAST(flag AS BIGINT) AS flag, flag & 16 <> 0 AS is_reverse FROM aln WHERE {sql}"


_flag_query("flag_discordant", flags.anchored_mate, "flag & 8 = 8 AND flag & 260 = 0")
_flag_query("flag_unmapped_mate", flags.unmapped_mate, "flag & 4 = 4 AND flag & 264 = 0")
_flag_query("flag_primary", flags.primary, "flag & 772 = 0")


@query(f"WITH {ALN}, {PARTS} SELECT read, n, cigar, matched, left_clip, right_clip, 1 + CAST(left_clip > 0 AS INTEGER) + CAST(right_clip > 0 AS INTEGER) AS ops, matched + left_clip + right_clip AS seq_length FROM x")
def cigar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = aln(spark, sf_dir).select("*", F.explode(F.array(cigar.normalise("cigar", "seq"))).alias("_n"))
    ops = F.col("_n.ops")
    total = lambda op, keep: F.aggregate(F.filter(ops, keep), F.lit(0), lambda a, o: a + o["len"]).cast("long")
    first, last = F.get(ops, F.lit(0)), F.element_at(ops, -1)
    clip = lambda o: F.when(o["op"] == "S", o["len"]).otherwise(0).cast("long")
    return x.select("read", "n", "cigar", total("M", lambda o: o["op"] == "M").alias("matched"), clip(first).alias("left_clip"), clip(last).alias("right_clip"), F.size(ops).alias("ops"), F.length("_n.seq").cast("long").alias("seq_length"))


@query(f"WITH {ALN}, {PARTS} SELECT read, n, cigar FROM x WHERE (left_clip > 0) <> (right_clip > 0)")
def cigar_two_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakpoints.two_parts(aln(spark, sf_dir)).select("read", "n", "cigar")


@query(f"""WITH {ALN}, {PARTS} SELECT read, n, CASE WHEN left_clip > 0 THEN 'SM' ELSE 'MS' END AS type, CASE WHEN left_clip > 0 THEN pos ELSE pos + matched - 1 END AS breakpoint, left_clip + right_clip AS clip
FROM x WHERE (left_clip > 0) <> (right_clip > 0) AND least(matched, left_clip + right_clip) >= 15""")
def clip_type_breakpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = breakpoints.two_parts(aln(spark, sf_dir)).where(cigar.long_clip(F.col("ops")))
    return x.select("read", "n", cigar.clip_type(F.col("ops")).alias("type"), cigar.breakpoint(F.col("ops"), "pos").alias("breakpoint"), cigar.clip_length(F.col("ops")).cast("long").alias("clip"))


@query(f"WITH {ALN} SELECT read, n, pos + 5 AS \"start\", pos + CAST(regexp_extract(cigar, '(\\d+)M', 1) AS BIGINT) * CASE WHEN cigar LIKE '10M5I%' OR cigar LIKE '10M100N%' THEN 0 WHEN cigar LIKE '10M5D%' THEN 0 ELSE 1 END + CASE WHEN cigar LIKE '10M5I%' OR cigar LIKE '10M100N%' THEN 10 + CAST(regexp_extract(cigar, '[IN](\\d+)M', 1) AS BIGINT) WHEN cigar LIKE '10M5D%' THEN 15 + CAST(regexp_extract(cigar, 'D(\\d+)M', 1) AS BIGINT) ELSE 0 END - 6 AS \"end\" FROM aln")
def match_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pairs.extents(aln(spark, sf_dir))
    return x.select("read", "n", "start", "end")


@query(f"WITH {ALN}, t AS (SELECT read, n, cigar, regexp_extract_all(cigar, '\\d+[A-Z]') AS ops FROM aln) SELECT read, n, regexp_replace(cigar, '^([^H]*)H', '\\1S') AS softened, array_to_string(list_reverse(ops), '') AS reversed FROM t")
def cigar_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = cigar.reverse(cigar.parse("cigar"))
    text = F.array_join(F.transform(turned, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return aln(spark, sf_dir).select("read", "n", cigar.soften("cigar").alias("softened"), text.alias("reversed"))


# Sequences ----------------------------------------------------------------------------------------------------------


@query(f"WITH {SEQS} SELECT doc_id, {RC} AS rc FROM seqs")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("doc_id", sequences.revcomp("seq").alias("rc"))


@query(f"WITH {SEQS} SELECT doc_id, lpad(right(seq, 100), 100, 'N') || 'H' || rpad(left({RC}, 100), 100, 'N') AS junction, lpad(right(seq, 30), 30, 'N') || rpad(left({RC}, 30), 30, 'N') AS centre FROM seqs")
def junction_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = seqs(spark, sf_dir).select("doc_id", sequences.junction("seq", sequences.revcomp("seq")).alias("junction"))
    return x.withColumn("centre", sequences.centred("junction", 30))


@query(f"""WITH {SEQS} SELECT a.doc_id, least(length(a.seq), length(b.seq)) AS compared, len(list_filter(list_zip(string_split(a.seq, ''), string_split(b.seq, '')), lambda x: x[1] = x[2] AND x[1] <> '')) AS matches
FROM seqs a JOIN seqs b ON b.doc_id = a.doc_id + 1""")
def seq_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = seqs(spark, sf_dir).select("doc_id", F.col("seq").alias("a"))
    b = seqs(spark, sf_dir).select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.least(F.length("a"), F.length("b")).cast("long").alias("compared"), sequences.matches("a", "b").cast("long").alias("matches"))


_COMPAT = "SELECT a.p_partkey, right(a.p_type, least(length(a.p_type), length(b.p_type))) = right(b.p_type, least(length(a.p_type), length(b.p_type))) AND left(a.p_name, least(length(a.p_name), length(b.p_name))) = left(b.p_name, least(length(a.p_name), length(b.p_name))) AS compatible FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(_COMPAT)
def compat_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("t"), F.col("p_name").alias("n"))
    return p.join(b, "p_partkey").select("p_partkey", sequences.compatible("p_type", "p_name", "t", "n").alias("compatible"))


@query(f"SELECT doc_id, list_filter(string_split(text, ' '), lambda t: NOT regexp_matches(t, '^[a-zA-Z]+_\\d+\\.\\d+') AND NOT regexp_matches(t, '(?i)gene|specie|trans|for|homo|sapiens'))[1] AS gene FROM documents")
def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fasta.gene_of_header(F.col("text")).alias("gene"))


def _count(letter: str) -> str:
    return f"CAST(length(seq) - length(replace(seq, '{letter}', '')) AS BIGINT)"


@query(f"WITH {SEQS} SELECT doc_id, {', '.join(f'{_count(x)} AS n_{x.lower()}' for x in sequences.ALPHABET)}, {_count('T')} + 2 * {_count('G')} + 3 * {_count('C')} AS code_sum FROM seqs")
def onehot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = sequences.one_hot("seq")
    n = lambda i: F.aggregate(hot, F.lit(0), lambda a, v: a + v[i]).cast("long")
    return seqs(spark, sf_dir).select("doc_id", *[n(i).alias(f"n_{x.lower()}") for i, x in enumerate(sequences.ALPHABET)], F.aggregate(sequences.codes("seq"), F.lit(0), lambda a, c: a + c).cast("long").alias("code_sum"))


_BENCH = f"b AS (SELECT item_id, {SEQ} AS seq FROM benchmark)"


@query(f"""WITH {_BENCH}, l AS (SELECT item_id, i AS k, seq[i] AS letter FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM b))
SELECT item_id, CAST(k AS INTEGER) AS "at", {', '.join(f"round(sum(CAST(letter = '{x}' AS INTEGER)) OVER w / k, 6) AS share_{x.lower()}" for x in 'ATGC')} FROM l WINDOW w AS (PARTITION BY item_id ORDER BY k)""")
def running_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", as_sequence(F.col("text")).alias("seq"))
    return ranks.running_share(b, ["item_id"], "seq").select("item_id", "at", *[F.round(f"share_{x}", 6).alias(f"share_{x.lower()}") for x in "ATGC"])


@query(f"""WITH c AS (SELECT role, {SEQ} AS seq FROM conversations), l AS (SELECT role, i AS k, seq[i] AS letter FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM c)),
v AS (SELECT role, k, letter, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT role, k, max(n) AS best FROM v GROUP BY ALL),
t AS (SELECT role, k, CASE WHEN count(*) = 1 THEN min(letter) ELSE 'N' END AS letter FROM v JOIN b USING (role, k) WHERE n = best GROUP BY ALL)
SELECT role, string_agg(letter, '' ORDER BY k) AS consensus FROM t GROUP BY role""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", as_sequence(F.col("text")).alias("seq"))
    return breakpoints.consensus(c, ["role"], "seq")


@query(f"""WITH {SEQS}, r AS (SELECT doc_id, doc_id % 50 + 1 AS "start", doc_id % 50 + 20000 AS "end", CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, doc_id % 50 + 1, 20000) AS part FROM seqs)
SELECT doc_id, CASE WHEN strand = '+' THEN part ELSE translate(reverse(part), 'ATGC', 'TACG') END AS seq FROM r""")
def extract_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seqs(spark, sf_dir)
    chunks = intervals.chunked(s.select(F.col("doc_id").cast("string").alias("chrom"), "seq"), 4096)
    d = F.col("doc_id")
    asked = s.select("doc_id", d.cast("string").alias("chrom"), (d % 50 + 1).alias("start"), (d % 50 + 20000).alias("end"), F.when(d % 2 == 0, "+").otherwise("-").alias("strand"))
    return intervals.extract(asked, chunks, ["doc_id"], 4096, "strand").select("doc_id", "seq")


# Intervals and gene models ------------------------------------------------------------------------------------------

_OVER = "a.chrom = b.chrom AND a.\"start\" <= b.\"end\" AND a.\"end\" >= b.\"start\""
_NUMBERED = IV + ", " + GM + ", a AS (SELECT CAST(chrom AS VARCHAR) AS chrom, \"start\", \"end\", s, n, p FROM iv)"


@query(f"WITH {_NUMBERED} SELECT a.chrom, a.\"start\", a.\"end\", b.\"start\" AS gene_start, b.\"end\" AS gene_end, b.gene_id FROM a JOIN gm b ON {_OVER}")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = iv(spark, sf_dir).withColumn("chrom", F.col("chrom").cast("string")).select("chrom", "start", "end")
    x = intervals.overlap_pairs(a, gm(spark, sf_dir), size=1024)
    return x.select("chrom", "start", "end", F.col("b_start").alias("gene_start"), F.col("b_end").alias("gene_end"), F.col("b_gene_id").alias("gene_id"))


def _overlap(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    a = iv(spark, sf_dir).withColumn("chrom", F.col("chrom").cast("string"))
    return intervals.overlapping(a, gm(spark, sf_dir), size=1024, how=how).select("chrom", "start", "end", "s", "n", "p")


@query(f"WITH {_NUMBERED} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM gm b WHERE {_OVER})")
def interval_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, "left_semi")


@query(f"WITH {_NUMBERED} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM gm b WHERE {_OVER})")
def interval_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, "left_anti")


@query(f"WITH {EX} SELECT * FROM ex")
def exon_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exons.ordinals(gm(spark, sf_dir)).select("chrom", "start", "end", "gene_id", "exon_num")


@query(f"""WITH {EX}, {SPOTS}{HIT} SELECT q.chrom, q."start", q."end", h.exon_num, h.es AS exon_start, h.ee AS exon_end, h.gene_id FROM q LEFT JOIN h USING (id)""")
def exon_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exons.lookup(spots(spark, sf_dir), exons.ordinals(gm(spark, sf_dir)), size=512)
    return x.select("chrom", "start", "end", "exon.exon_num", F.col("exon.start").alias("exon_start"), F.col("exon.end").alias("exon_end"), "exon.gene_id")


@query(f"""WITH {IV}, o AS (SELECT *, coalesce(CAST("start" > max("end") OVER (PARTITION BY chrom, gene ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 1) AS new FROM iv),
i AS (SELECT *, sum(new) OVER (PARTITION BY chrom, gene ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chrom, gene, CAST(island AS BIGINT) AS island, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY ALL""")
def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(iv(spark, sf_dir), ["chrom", "gene"])


@query(f"""WITH {IV}, t AS (SELECT *, coalesce(CAST(gene <> lag(gene) OVER w AS INTEGER), 1) AS turn FROM iv WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end", gene, s, n, p)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY chrom ORDER BY "start", "end", gene, s, n, p ROWS UNBOUNDED PRECEDING) AS run FROM t),
b AS (SELECT *, coalesce(CAST("start" > max("end") OVER (PARTITION BY chrom, run ORDER BY "start", "end", gene, s, n, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 1) AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY "start", "end", gene, s, n, p ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT chrom, gene, CAST(k AS BIGINT) AS run, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY ALL""")
def gene_run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.runs(iv(spark, sf_dir), "chrom", "gene", ["start", "end", "gene", "s", "n", "p"])


@query(f"""WITH {EX} SELECT chrom, gene_id, exon_num, CAST(coalesce(sum("end" - "start" + 1) OVER (PARTITION BY chrom, gene_id ORDER BY exon_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ex""")
def spliced_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exons.spliced_offsets(exons.ordinals(gm(spark, sf_dir))).select("chrom", "gene_id", "exon_num", "offset")


_WALK_Q = SPOTS.replace("l_orderkey * 20 + l_partkey % 20 + CAST(l_quantity AS BIGINT) % 8", "l_orderkey * 20 + l_partkey % 20 + 1")


@query(f"""WITH {EX}, {_WALK_Q}{HIT},
g AS (SELECT q.id, q.chrom, q."start" AS pos, h.exon_num AS own, h.gene_id FROM q JOIN h USING (id)),
up AS (SELECT g.id, g.pos, ex.exon_num, greatest(ex."start", g.pos) AS lo, ex."end" AS hi FROM g JOIN ex ON ex.chrom = g.chrom AND ex.gene_id = g.gene_id AND ex.exon_num >= g.own AND ex."end" >= g.pos),
u AS (SELECT *, coalesce(sum(hi - lo + 1) OVER (PARTITION BY id ORDER BY exon_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM up),
us AS (SELECT id, string_agg(CAST(lo - 1 AS BIGINT) || '-' || CAST(least(hi, lo + 60 - before - 1) AS BIGINT), ',' ORDER BY exon_num) AS r FROM u WHERE before < 60 GROUP BY id),
dn AS (SELECT g.id, ex.exon_num, ex."start" AS lo, least(ex."end", g.pos - 1) AS hi FROM g JOIN ex ON ex.chrom = g.chrom AND ex.gene_id = g.gene_id AND ex.exon_num <= g.own AND ex."start" <= g.pos - 1),
d AS (SELECT *, coalesce(sum(hi - lo + 1) OVER (PARTITION BY id ORDER BY exon_num DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dn),
ds AS (SELECT id, string_agg(CAST(greatest(lo, hi - (60 - before) + 1) - 1 AS BIGINT) || '-' || CAST(hi AS BIGINT), ',' ORDER BY exon_num) AS l FROM d WHERE before < 60 GROUP BY id)
SELECT q.chrom, q."start" AS pos, coalesce(l, '') AS left_parts, coalesce(r, '') AS right_parts FROM q LEFT JOIN us USING (id) LEFT JOIN ds USING (id)""")
def spliced_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spots(spark, sf_dir).select("chrom", F.col("start").alias("pos"))
    x = exons.walk(q, exons.ordinals(gm(spark, sf_dir)), 60, size=512)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return x.select("chrom", "pos", text("left").alias("left_parts"), text("right").alias("right_parts"))


@query(f"""WITH {IV}, b AS (SELECT *, row_number() OVER () AS id FROM iv) SELECT a.chrom, a."start" AS start_a, b."start" AS start_b, a.p AS p_a, b.p AS p_b FROM b a JOIN b ON a.chrom = b.chrom AND a."start" < b."start" + 100 AND b."start" < a."start" + 100 AND abs(a.p - b.p) < 20
WHERE (a."start", a.p, a.s, a.n) < (b."start", b.p, b.s, b.n)""")
def near_candidates_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = iv(spark, sf_dir).withColumn("key", F.struct("start", "p", "s", "n"))
    x = intervals.near_pairs(x, ["chrom"], {"start": 100, "p": 20}, "key")
    return x.select("a.chrom", F.col("a.start").alias("start_a"), F.col("b.start").alias("start_b"), F.col("a.p").alias("p_a"), F.col("b.p").alias("p_b"))


_GAPS = """pos AS (SELECT DISTINCT l_suppkey % 5 AS chrom, l_partkey * 2 + l_suppkey % 3 * 7 AS position FROM lineitem),
c AS (SELECT *, coalesce(CAST(position - lag(position) OVER (PARTITION BY chrom ORDER BY position) > 3 AS INTEGER), 1) AS new FROM pos)"""


@query(f"WITH {_GAPS} SELECT chrom, position, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS component FROM c")
def breakpoint_gap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), (F.col("l_partkey") * 2 + F.col("l_suppkey") % 3 * 7).alias("position"))
    return intervals.gap_components(x, ["chrom"], "position", 3)


# Reads, hits and candidates -----------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey AS read, l_suppkey % 3 AS chrom, l_partkey * 10 AS "start", l_partkey * 10 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem)
SELECT read, min("start") AS low, max("end") AS high, count(*) AS n, string_agg(DISTINCT chrom::VARCHAR, ',' ORDER BY chrom::VARCHAR) AS chroms FROM a GROUP BY read HAVING count(*) >= 2 AND NOT (count(DISTINCT chrom) = 1 AND max("end") - min("start") < 2000)""")
def pair_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 10
    a = x.select(F.col("l_orderkey").alias("read"), (F.col("l_suppkey") % 3).cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return pairs.spans(a, keys=("read",)).select("read", "low", "high", "n", F.array_join("chroms", ",").alias("chroms"))


_PARTNERS = """q AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_partkey * 20 AS "start", l_partkey * 20 + CAST(l_quantity AS BIGINT) % 8 AS "end", l_orderkey AS read, row_number() OVER () AS id FROM lineitem)"""


@query(f"""WITH {EX}, {_PARTNERS}{HIT},
far AS (SELECT read FROM q GROUP BY read HAVING count(*) >= 2 AND NOT (count(DISTINCT chrom) = 1 AND max("end") - min("start") < 2000)),
x AS (SELECT q.*, h.gene_id, h.exon_num, CAST(h.gene_id AS INTEGER) < 48 AS homolog FROM q JOIN far USING (read) JOIN h USING (id)),
g AS (SELECT read, min((chrom, "start", "end", gene_id, exon_num)) FILTER (NOT homolog) AS seed FROM x GROUP BY read HAVING bool_or(homolog) AND count(DISTINCT gene_id) FILTER (NOT homolog) = 1)
SELECT read, seed[1] AS chrom, seed[2] AS "start", seed[3] AS "end", seed[4] AS gene_id, seed[5] AS exon_num FROM g""")
def spanning_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 20
    a = x.select(F.col("l_orderkey").alias("read"), (F.col("l_suppkey") % 5).cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 8).alias("end"))
    homologs = gm(spark, sf_dir).where(F.col("gene_id").cast("int") < 48).select("gene_id")
    return pairs.partners(a, exons.ordinals(gm(spark, sf_dir)), homologs, keys=("read",), size=512).select("read", "chrom", "start", "end", "gene_id", "exon_num")


@query("""WITH b AS (SELECT l_orderkey AS split_id, l_partkey AS pos, l_linenumber AS in_breakpoint, CAST(l_quantity AS INTEGER) % 5 AS cut FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY split_id ORDER BY in_breakpoint + cut) AS k FROM b)
SELECT split_id, pos, in_breakpoint, cut FROM r WHERE k = 1""")
def min_residual_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("split_id"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("in_breakpoint"), (F.col("l_quantity").cast("int") % 5).alias("cut"))
    return breakpoints.least_residual(b)


_HITS = """hits AS (SELECT l_orderkey AS c, l_partkey % 90 AS s, l_partkey % 90 + CAST(l_quantity AS INTEGER) AS e, 40 + l_orderkey % 20 AS l, l_orderkey % 7 AS m, 45 + l_orderkey % 11 AS r FROM lineitem),
roles AS (SELECT c, s, e, CASE WHEN s < l * 0.5 AND e > l * 1.5 + m THEN 'bad' WHEN s <= l * 0.5 AND e BETWEEN l * 0.5 AND l * 1.5 THEN 'left' WHEN s BETWEEN l + m - r * 0.5 AND l + m + r * 0.5 AND e >= l + m + r * 0.5 THEN 'right' END AS role FROM hits)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    x = table(spark, sf_dir, "lineitem").select(o.alias("c"), (p % 90).alias("s"), (p % 90 + q).alias("e"), (40 + o % 20).alias("l"), (o % 7).alias("m"), (45 + o % 11).alias("r"))
    return x.withColumn("role", candidates.roles(F.col("l"), F.col("m"), F.col("r"), F.col("s"), F.col("e")))


@query(f"WITH {_HITS} SELECT c, s, e, role FROM roles")
def candidate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("c", "s", "e", "role")


@query(f"WITH {_HITS} SELECT c FROM roles GROUP BY c HAVING NOT coalesce(bool_or(role = 'bad'), false) AND coalesce(bool_or(role = 'left'), false) AND coalesce(bool_or(role = 'right'), false)")
def candidate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.verdict(_hits(spark, sf_dir), ["c"])


_PSL = "psl AS (SELECT l_orderkey AS query, l_partkey % 60 AS matches, 60 AS q_size, l_linenumber * 2 AS q_start, l_linenumber * 2 + CAST(l_quantity AS INTEGER) AS q_end FROM lineitem)"


def _psl(spark: SparkSession, sf_dir: str) -> DataFrame:
    q0 = F.col("l_linenumber") * 2
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_partkey") % 60).alias("matches"), F.lit(60).alias("q_size"), q0.alias("q_start"), (q0 + F.col("l_quantity").cast("int")).alias("q_end"))


@query(f"WITH {_PSL} SELECT * FROM psl WHERE matches >= q_size * 0.9")
def anchored_side_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.well_matched(_psl(spark, sf_dir))


@query(f"WITH {_PSL} SELECT * FROM psl WHERE q_start <= 5 OR q_end >= q_size - 5")
def hit_touches_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.touches_end(_psl(spark, sf_dir))


@query(f"""WITH {EX}, q AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS chrom, pos AS "start", pos + 1 AS "end", pos, hs, he, type, strand, q_start, q_end, q_size, row_number() OVER () AS id FROM
 (SELECT *, CASE WHEN (type = 'SM') = (strand = '+') THEN he ELSE hs END AS pos FROM (SELECT l_suppkey, l_orderkey * 20 AS hs, l_orderkey * 20 + CAST(l_quantity AS BIGINT) AS he, CASE WHEN l_linenumber % 2 = 0 THEN 'SM' ELSE 'MS' END AS type,
 CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey % 3 AS q_start, 40 + l_partkey % 5 AS q_end, 42 AS q_size FROM lineitem))){HIT}
SELECT q.chrom, hs AS "start", he AS "end", type, strand, pos AS "at", exon_num, CAST(CASE WHEN (type = 'SM') = (strand = '+') AND pos > ee - 11 AND pos < ee AND used THEN ee - pos WHEN (type = 'SM') <> (strand = '+') AND pos > es AND pos < es + 11 AND used THEN pos - es ELSE 0 END AS INTEGER) AS added
FROM (SELECT *, CASE WHEN type = 'SM' THEN q_end = q_size ELSE q_start = 0 END AS used FROM q) q JOIN h USING (id)""")
def edge_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = F.col("l_orderkey") * 20, F.col("l_partkey")
    hits = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("string").alias("chrom"), o.alias("start"), (o + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_linenumber") % 2 == 0, "SM").otherwise("MS").alias("type"),
        F.when(p % 2 == 0, "+").otherwise("-").alias("strand"), (p % 3).alias("q_start"), (40 + p % 5).alias("q_end"), F.lit(42).alias("q_size"),
    )
    x = realign.edge_snap(hits, exons.ordinals(gm(spark, sf_dir)), size=512)
    return x.select("chrom", "start", "end", "type", "strand", "at", "exon.exon_num", "added")


_SA = """t AS (SELECT l_orderkey AS read, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
sa AS (SELECT read, n, p, CASE p % 4 WHEN 0 THEN q || 'M' || (60 - q) || 'S' WHEN 1 THEN (60 - q) || 'S' || q || 'M' WHEN 2 THEN q || 'M5I' || (55 - q) || 'S' ELSE q || 'M' END AS x,
 CASE WHEN n % 3 = 0 THEN (q + n) || 'M' || (60 - q - n) || 'S' ELSE (q - n) || 'S' || (60 - q + n) || 'M' END AS y FROM t)"""


@query(f"""WITH {_SA}, v AS (SELECT *, CASE WHEN regexp_matches(x, '^\\d+M\\d+S$') THEN 'MS' WHEN regexp_matches(x, '^\\d+S\\d+M$') THEN 'SM' END AS xs, CASE WHEN regexp_matches(y, '^\\d+M\\d+S$') THEN 'MS' WHEN regexp_matches(y, '^\\d+S\\d+M$') THEN 'SM' END AS ys,
 CAST('0' || regexp_extract(x, '(\\d+)M', 1) AS INTEGER) AS xm, CAST('0' || regexp_extract(y, '(\\d+)S', 1) AS INTEGER) AS yc, CAST('0' || regexp_extract(y, '(\\d+)M', 1) AS INTEGER) AS ym FROM sa)
SELECT read, n, xs AS x_shape, ys AS y_shape, greatest(0, xm - yc) AS plus, p + xm AS x_right, p * 3 + ym AS y_right FROM v WHERE xs <> ys AND abs(xm - yc) <= 5""")
def chimera_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n, q = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    x = F.when(p % 4 == 0, s(q, "M", 60 - q, "S")).when(p % 4 == 1, s(60 - q, "S", q, "M")).when(p % 4 == 2, s(q, "M5I", 55 - q, "S")).otherwise(s(q, "M"))
    y = F.when(n % 3 == 0, s(q + n, "M", 60 - q - n, "S")).otherwise(s(q - n, "S", 60 - q + n, "M"))
    tag = F.concat(F.lit("SA:Z:chr2,"), (p * 3).cast("string"), F.lit(",+,"), y, F.lit(",60,0;"))
    a = table(spark, sf_dir, "lineitem").select(s(F.col("l_orderkey"), "/", n).alias("read_name"), F.lit(0).alias("flag"), F.lit("chr1").alias("chrom"), p.alias("pos"), x.alias("cigar"), F.lit("A" * 60).alias("seq"), F.array(F.lit("NM:i:0"), tag).alias("tags"))
    key = F.split("read_name", "/")
    return chimeras.chimeric(a).select(key[0].cast("long").alias("read"), key[1].cast("int").alias("n"), F.col("x.shape").alias("x_shape"), F.col("y.shape").alias("y_shape"), "plus", F.col("x.right").alias("x_right"), F.col("y.right").alias("y_right"))


@query("""SELECT a.p_partkey, a.p_name AS gene_x, b.p_name AS gene_y, regexp_matches(a.p_name, '^(IG|ENSG)') OR regexp_matches(b.p_name, '^(IG|ENSG)') OR (length(a.p_name) >= 3 AND length(b.p_name) >= 3 AND left(a.p_name, 3) = left(b.p_name, 3)) AS one_family
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def gene_family_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("gene_y"))
    return p.join(b, "p_partkey").select("p_partkey", F.col("p_name").alias("gene_x"), "gene_y", chimeras.one_family(F.col("p_name"), F.col("gene_y")).alias("one_family"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = l.l_partkey AND o.o_orderkey % 100 = l.l_suppkey)")
def homolog_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gene"), (F.col("o_orderkey") % 100).alias("homolog"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return chimeras.without_homologs(rows, edges, "l_partkey", "l_suppkey")


@query("""WITH p AS (SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS f FROM lineitem GROUP BY 1, 2)
SELECT f[1] AS l_orderkey, f[2] AS l_linenumber, f[3] AS l_partkey, f[4] AS l_suppkey FROM p""")
def unordered_pair_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return chimeras.unordered_pairs(rows, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])


@query("""WITH b AS (SELECT conv_id, string_split(replace(replace(text, chr(10), ' '), ' ', ';'), ';') AS names FROM conversations) SELECT DISTINCT CAST(conv_id AS VARCHAR) AS gene, n AS homolog FROM (SELECT conv_id, unnest(names) AS n FROM b) WHERE n <> ''""")
def homolog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.translate("text", "\n ", ";;")
    lines = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("\t"), names).alias("value"))
    return tables.parse_homologs(lines)


@query(f"""WITH {_BENCH}, c AS (SELECT conv_id * 1000 + turn AS target, {SEQ} AS seq FROM conversations),
q AS (SELECT item_id, '+' AS strand, seq FROM b UNION ALL SELECT item_id, '-', {RC} FROM b),
qk AS (SELECT item_id, strand, i AS q_at, substr(seq, i + 1, 12) AS w FROM (SELECT *, unnest(range(0, length(seq) - 11)) AS i FROM q)),
tk AS (SELECT target, i AS t_at, substr(seq, i + 1, 12) AS w FROM (SELECT *, unnest(range(0, length(seq) - 11)) AS i FROM c))
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(target AS BIGINT) AS target, strand, CAST(t_at - q_at AS INTEGER) AS diagonal, count(*) AS seeds, CAST(min(q_at) AS INTEGER) AS q_low, CAST(max(q_at) + 12 AS INTEGER) AS q_high FROM qk JOIN tk USING (w) GROUP BY ALL""")
def kmer_seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query"), as_sequence(F.col("text")).alias("seq"))
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("target"), as_sequence(F.col("text")).alias("seq"))
    return similarity.seeds(q, t, 12, most=None).withColumnRenamed("query", "item_id")


@query()
def seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's passages in the conversations, with at most one mismatch in ten."""
    q = table(spark, sf_dir, "benchmark").select("item_id", as_sequence(F.col("text")).alias("seq")).withColumnRenamed("item_id", "query")
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("target"), as_sequence(F.col("text")).alias("seq"))
    return similarity.align(q, t, 12, min_score=20, min_identity=0.9, most=None)


@query()
def cluster_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as split reads at breakpoints given by their length, merged and clustered."""
    s = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", as_sequence(F.col("text")).alias("seq"))
    name = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    splits = s.select(F.col("role").alias("sample"), name.alias("read_name"), F.lit("anchor").alias("chrom"), F.length("seq").cast("long").alias("breakpoint"), F.lit("MS").alias("type"), F.col("seq").alias("seq_left"), sequences.revcomp("seq").alias("seq_right"))
    return breakpoints.clusters(splits.where("seq <> ''"))


# Evidence, samples and models ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT user_id, event_type, sum(CAST(floor(value) AS BIGINT)) AS cnt FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, event_type) AS k FROM p)
SELECT user_id, event_type, CAST(cnt AS BIGINT) AS cnt FROM r WHERE k = 1""")
def best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("cnt"))
    return evidence.best_position(e, ["user_id"], ["event_type"])


@query(f"WITH {EV} SELECT id, spanning, split FROM ev WHERE spanning + split > 0 AND spanning * 10 >= split AND split * 10 >= spanning")
def evidence_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).where(evidence.balanced(F.col("spanning"), F.col("split"))).select("id", "spanning", "split")


@query(f"WITH {EV}, r AS (SELECT *, spanning + split AS reads FROM ev) SELECT id, reads, score FROM r WHERE score > 0.1 AND (reads * 10 > (SELECT max(reads) FROM r) OR score > 0.9)")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ev(spark, sf_dir).withColumn("reads", F.col("spanning") + F.col("split"))
    return evidence.score_gate(x, "score", "reads").select("id", "reads", "score")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    return evidence.first_of(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE spanning + split > 0 AND spanning * 10 >= split AND split * 10 >= spanning),
g AS (SELECT fusion, sample, sum(spanning) AS a, sum(split) AS b, count(*) AS n FROM k GROUP BY ALL)
SELECT fusion, CAST(sum(a) AS BIGINT) AS spanning_count, CAST(sum(b) AS BIGINT) AS breakpoint_count, CAST(sum(n) AS BIGINT) AS cell_count, count(*) AS distinct_cells, string_agg(CAST(sample AS VARCHAR), ';' ORDER BY CAST(sample AS VARCHAR)) AS cells FROM g GROUP BY fusion""")
def cell_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ev(spark, sf_dir).where(evidence.balanced(F.col("spanning"), F.col("split")))
    return evidence.rollup(x, ["fusion"], "sample", "spanning", "split")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || '--' || l_linestatus ELSE l_linestatus || '--' || l_returnflag END AS fusion_gene, l_linestatus || ':' || l_partkey AS x_clip, 'chr' || l_suppkey || ':' || l_orderkey AS y_clip FROM lineitem""")
def prediction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SM").otherwise("MS")
    named = evidence.labels(kind, F.col("l_linestatus"), F.col("l_partkey"), F.col("l_returnflag"), F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.col("l_orderkey"))
    return x.select("l_orderkey", "l_linenumber", *[named[k].alias(k) for k in ("fusion_gene", "x_clip", "y_clip")])


@query("""WITH n AS (SELECT source, n_chars, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, n_chars) AS k FROM n) SELECT source, n_chars, n FROM r WHERE k = 1""")
def read_mode_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.mode_of(table(spark, sf_dir, "documents"), "n_chars", ["source"])


_MIXED = "(doc_id * 7919) % 10007, doc_id"


def _mixed() -> list[Column]:
    return [F.col("doc_id") * 7919 % 10007, F.col("doc_id")]


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_MIXED}) AS k FROM labels WHERE quality IS NOT NULL), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM r GROUP BY quality))
SELECT doc_id, quality, CASE WHEN k <= floor(least * 70 / 100) THEN 'train' ELSE 'test' END AS part FROM r, m WHERE k <= least""")
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", _mixed())


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MIXED}) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, {' + '.join(f'CAST(k <= n // {2**s} AS INTEGER)' for s in range(1, 8))} AS level FROM r""")
def halving_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.halving_chain(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], _mixed())


@query(f"SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {_MIXED}) - 1) % 5 AS INTEGER) AS fold FROM documents")
def five_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.folds(table(spark, sf_dir, "documents").select("doc_id", "lang"), _mixed(), 5, ("lang",))


@query("SELECT p_partkey, " + ", ".join(f"CAST({c} * p_size AS BIGINT) * 100 // 202 AS pairs_{c}" for c in (2, 8, 32, 128)) + " FROM part")
def coverage_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long") * 100
    return table(spark, sf_dir, "part").select("p_partkey", *[sampling.pairs_for_coverage(size, F.lit(c)).alias(f"pairs_{c}") for c in (2, 8, 32, 128)])


@query("""WITH x AS (SELECT d.source, l.quality AS y, d.n_chars % 100 AS s FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS k FROM x)
SELECT source, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6)::DOUBLE AS auc FROM r GROUP BY source""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 100).alias("score"))
    return ranks.auc(table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "score", ("source",)).withColumn("auc", F.round("auc", 6))


# Sources ------------------------------------------------------------------------------------------------------------


@query("""SELECT 'chr' || l_suppkey AS chrom, l_orderkey AS "start", l_orderkey + CAST(l_quantity AS BIGINT) AS "end", CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, 'G' || l_partkey AS gene_id,
 CASE WHEN l_partkey % 3 = 0 THEN 'G' || l_partkey ELSE 'name' || l_partkey END AS gene_name FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey % 4 <> 0""")
def gtf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey").cast("string")
    named = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(' gene_name "name'), p, F.lit('";')))
    attrs = F.concat(F.lit('gene_id "G'), p, F.lit('"; transcript_type "'), F.when(F.col("l_partkey") % 4 == 0, "processed_pseudogene").otherwise("protein_coding"), F.lit('";'), named)
    feature = F.when(F.col("l_returnflag") == "N", "CDS").otherwise("exon")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.lit("src"), feature, F.col("l_orderkey").cast("string"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).cast("string"), F.lit("."), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), F.lit("."), attrs)
    head = spark.createDataFrame([("##description: annotation",)], "value string")
    return tables.real_genes(tables.parse_gtf(head.unionByName(x.select(line.alias("value"))))).select("chrom", "start", "end", "strand", "gene_id", "gene_name")


@query(f"WITH {ALN} SELECT 'r' || read AS read_name, flag, 'chr1' AS chrom, pos, cigar, CAST(2 AS INTEGER) AS tags FROM aln")
def sam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = aln(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("read").cast("string")), F.col("flag").cast("string"), F.lit("chr1"), F.col("pos").cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), F.lit("NM:i:0"), F.lit("AS:i:3"))
    head = spark.createDataFrame([("@SQ\tSN:chr1\tLN:1",)], "value string")
    return tables.parse_sam(head.unionByName(x.select(line.alias("value")))).select("read_name", F.col("flag").cast("long").alias("flag"), "chrom", "pos", "cigar", F.size("tags").alias("tags"))


@query("SELECT CAST(l_partkey % 60 AS INTEGER) AS matches, '+' AS strand, 'q' || l_orderkey AS query, CAST(60 AS INTEGER) AS q_size, l_linenumber AS q_start, l_linenumber + CAST(l_quantity AS INTEGER) AS q_end, 't' || l_suppkey AS target, l_partkey AS t_start, l_partkey + CAST(l_quantity AS BIGINT) AS t_end FROM lineitem")
def psl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: x.cast("string")
    p, q, n, zero = F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.lit("0")
    line = F.concat_ws("\t", s(p % 60), zero, zero, zero, zero, zero, zero, zero, F.lit("+"), F.concat(F.lit("q"), s(F.col("l_orderkey"))), F.lit("60"), s(n), s(n + q), F.concat(F.lit("t"), s(F.col("l_suppkey"))), F.lit("1000"), s(p), s(p + q), F.lit("1"))
    head = spark.createDataFrame([("psLayout version 3",), ("",), ("match\tmis-match",), ("-----",)], "value string")
    return tables.parse_psl(head.unionByName(table(spark, sf_dir, "lineitem").select(line.alias("value"))))
