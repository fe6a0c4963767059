"""The operators' queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import exact_dedup, filter_audit, langid, line_dedup, mixing, mpeg, packing, quality, resampling, secrets, simhash, toxicity, warc
from junctura.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    return toxicity.score(docs, model)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archives, sidecar = warc.archive_pages(pages)
    kind = pages.schema["page_id"].dataType
    return warc.read_members(archives, sidecar).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), langid.predictor(model, docs)("text").alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg.describe(mpeg.store(_table(spark, sf_dir, "documents")))
    seek = F.crc32(F.array_join(F.col("frame_offsets").cast("array<string>"), ","))
    feature = F.format_string(
        "mpeg1-layer3 frames=%d samples=%d hz=%d crc=%d/%d table=%s skipped=%d seek=%08x",
        "frames", "duration_samples", "sample_rate", "crc_good", "crc_checked", F.col("table_ok").cast("string"), "skipped_bytes", seek,
    )
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"),
        "duration_samples", "sample_rate", "frames", "frame_offsets",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.progressive_dedup(_table(spark, sf_dir, "documents"), digest_all=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_packing, op3_secrets, op4_simhash, op5_warc, op6_language, op7_mixing, op8_mpeg, op9_exact_dedup, op10_quality,
        op11_resampling, op12_line_dedup, op13_filter_audit,
    )
}


def _rule_sql(order: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    text = "coalesce(text, '')"
    return (
        f"SELECT doc_id, row, {order} AS ord, '{rule.kind}' AS kind, regexp_split_to_array({text}, '{pattern}') AS gaps, "
        f"regexp_extract_all({text}, '{pattern}', 0) AS hits, regexp_extract_all({text}, '{pattern}', {rule.group}) AS parts, {rule.least} AS least "
        f"FROM docs WHERE regexp_matches({text}, '{pattern}')"
    )


_SECRETS = (
    "WITH docs AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents), m AS ("
    + " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secrets.RULES))
    + """), e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT row, ord, kind, length(parts[i]) AS part, least, length(hits[i]) AS len,
 coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM e),
k AS (SELECT row, kind, ord, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + len AS BIGINT) AS span FROM s WHERE part >= least),
g AS (SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
 string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM k GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN g USING (row)"""
)

_MIXING = """WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
 UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
d AS (SELECT *, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS k FROM d),
x AS (SELECT *, unnest(range(0, k)) AS i FROM m WHERE k > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS copy,
 CAST('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13) AS BIGINT) AS shuffle_key FROM x"""

#: CRC-32 a nibble at a time: the register after each nibble alone, made by the polynomial.
_POLYNOMIAL = 0xEDB88320


def _nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (_POLYNOMIAL if c & 1 else 0)
    return c


def _crc32_sql(of: str) -> str:
    digits = f"list_transform(range(1, length({of}) + 1), lambda i: CAST(instr('0123456789ABCDEF', substr({of}, i - 1 + 2 * (i % 2), 1)) - 1 AS BIGINT))"
    table = f"CAST({[_nibble(c) for c in range(16)]} AS BIGINT[])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, x: xor(c >> 4, list_extract({table}, xor(c & 15, x) + 1))))"


_LOWERED = f"translate(%s, '{ascii_uppercase}', '{ascii_lowercase}')"

_RESAMPLING = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED % "coalesce(text, '')"}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
q AS (SELECT regexp_extract_all({_LOWERED % "coalesce(text, '')"}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
qf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM q),
hx AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM qf)), b AS (SELECT f, {_crc32_sql("h")} % 10000 AS bucket FROM hx),
sb AS (SELECT bucket, count(*) AS n FROM df JOIN b USING (f) GROUP BY bucket), tb AS (SELECT bucket, count(*) AS n FROM qf JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(tb.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM sb) + 10000)::DOUBLE)
 / ((coalesce(sb.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM tb) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN sb USING (bucket) LEFT JOIN tb USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(gain / n), 0) AS BIGINT) AS weight,
 CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor(25 * (SELECT count(*) FROM r) / 100) THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, {_LOWERED % "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"} AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> keeper) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256 FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""

_AUDIT = """WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
b AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > first AS INT) AS mask FROM w),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM b LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(range(5)) AS i), o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(o, lambda i: chr(CAST(65 + i AS INT))), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step, o FROM o),
p AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, CAST(1 << o[step] AS INT) AS own, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0) AS INT) AS before FROM s),
x AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS removed,
 coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
 coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS toxic_lost FROM m, p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM x"""

SQL: dict[str, str] = {
    "op3_secrets": _SECRETS,
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS b, sha256(h) AS s FROM p), f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, b AS payload_bytes, s AS payload_digest, CASE WHEN b >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN b >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op7_mixing": _MIXING,
    "op9_exact_dedup": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM w""",
    "op11_resampling": _RESAMPLING,
    "op12_line_dedup": _LINES,
    "op13_filter_audit": _AUDIT,
}
