"""Secret scans over a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived: of each run of its parts that has a few
possible texts, a match has one, and so all the trigrams of that one. The index holds postings (trigram, id) of the
trigrams that the rules ask for, over the lower-cased texts. Intersecting the postings gives the candidates of a rule,
which alone are verified with the regular expression. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._parser as _parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, text_of


#: A run of parts with more possible texts than this is cut.
_MOST_TEXTS = 64


def texts_of(item: tuple) -> set[str] | None:
    """The lower-cased texts that a part of a parsed pattern can match, None if they are many or endless."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op == "SUBPATTERN":
        return texts_of_all(arg[-1])
    if op == "BRANCH":
        found = [texts_of_all(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op == "MAX_REPEAT" and arg[1] <= 4:
        once = texts_of_all(arg[2])
        return None if once is None else set().union(*(joined_texts([once] * n) or {""} for n in range(arg[0], arg[1] + 1)))
    return None


def joined_texts(parts: list[set[str]]) -> set[str] | None:
    out = {""}
    for x in parts:
        if len(out) * len(x) > _MOST_TEXTS:
            return None
        out = {a + b for a in out for b in x}
    return out


def texts_of_all(items) -> set[str] | None:
    parts = [texts_of(x) for x in items]
    return None if None in parts else joined_texts(parts)


def mandatory(items) -> list[set[str]]:
    """For each run of parts with few possible texts, these; runs that may have under three characters are left out."""
    out, run = [], {""}

    def close() -> None:
        nonlocal run
        if all(len(x) >= 3 for x in run):
            out.append({x for x in run if not any(y != x and y in x for y in run)})
        run = {""}

    for item in items:
        found = texts_of(item)
        both = None if found is None else joined_texts([run, found])
        if both is None:
            close()
            both = found
        if both is not None:
            run = both
        elif str(item[0]) == "SUBPATTERN":
            out += mandatory(item[1][-1])
    close()
    return out


@dataclass(frozen=True)
class Rule:
    """pattern: found leftmost, without overlap. least: code points of group ``group`` that a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def query(self) -> list[list[list[str]]]:
        """All of these must hold: one of some lists of trigrams, all of which a text has. [] if every text is scanned."""
        return [sorted(sorted({x[i : i + 3] for i in range(len(x) - 2)}) for x in texts) for texts in mandatory(_parser.parse(self.pattern))]


#: The kinds in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def trigram_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, id) of all trigrams that the rules' queries ask for; one row for each text that has it."""
    asked = sorted({t for r in rules for any_of in r.query() for c in any_of for t in c})
    low = F.lower(text_of(text_column))
    rows = docs.select(column(id_column).alias("_id"), low.alias("_low"))
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in asked]))
    return rows.select(F.explode(has).alias("trigram"), "_id")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): for which rules the id is in the postings that their queries ask for."""
    spark = postings.sparkSession
    asked = [(r.kind, len(r.query()), i, k, len(c), t) for r in rules for i, any_of in enumerate(r.query()) for k, c in enumerate(any_of) for t in c]
    clauses = spark.createDataFrame(asked, "kind string, parts int, part int, clause int, needs int, trigram string")
    found = (
        postings.join(F.broadcast(clauses), "trigram")  # as large as the rules, whatever the input
        .groupBy("_id", "kind", "parts", "part", "clause", "needs").agg(F.countDistinct("trigram").alias("n")).where("n = needs")
        .groupBy("_id", "kind", "parts").agg(F.countDistinct("part").alias("n")).where("n = parts")
    )
    return found.groupBy("_id").agg(F.collect_set("kind").alias("_kinds"))


_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule, block: int = 256) -> Column:
    """array<struct<start, end>> of the rule's matches in code points, the end exclusive.

    A text splits into what is between matches; the lengths of these pieces and of the matches give the places. They are
    added up in blocks of matches and the blocks' sums after that, so that no array grows by one match at a time over a
    whole text.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    parts = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else whole
    step = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("len"), parts.alias("part")), lambda x: x["len"].isNotNull())
    none = F.array().cast(_SPANS)

    def own(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        out = F.when(x["part"] >= rule.least, F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + x["len"]).alias("end"))))).otherwise(a["out"])
        return F.struct((start + x["len"]).alias("at"), out.alias("out"))

    def in_blocks(s: Column) -> Column:
        """Of each block how far it reaches, and its spans counted from its beginning."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        return F.transform(numbers, lambda b: F.aggregate(F.slice(s, b * block + 1, F.lit(block)), F.struct(F.lit(0).alias("at"), none.alias("out")), own))

    def moved(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        shift = lambda b, n: F.transform(b["out"], lambda x: F.struct((x["start"] + n).alias("start"), (x["end"] + n).alias("end")))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), shift))

    return held(step, lambda s: F.when(F.size(s) > 0, held(in_blocks(s), moved)).otherwise(none))


def held(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), for which x is computed once however often use names it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per row of docs: id and found, an array of (kind, start, end) by start, then kind as the rules list them.

    Null texts count as empty, and long ones are scanned whole, in time that grows with their matches. Repeated rows and
    null ids are all scanned: ids only choose candidates, every text is verified by itself, so texts that share an id
    never share spans. Matches of several rules that start together come in the rules' order. Other columns are not
    read, whatever their names. An empty table gives an empty result. The candidates' ids go to all tasks while there are
    at most broadcast_ids of them; beyond that Spark joins them by shuffle.
    """
    found = checkpoint(candidates(trigram_index(docs, id_column, text_column, rules), rules))
    if found.count() <= broadcast_ids:
        found = F.broadcast(found)
    rows = docs.select(column(id_column).alias("_doc"), text_of(text_column).alias("_text"))
    rows = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast(_SPANS)
    lists = []
    for k, rule in enumerate(rules):
        if rule.query():
            asked = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
        else:
            asked = F.col("_text").rlike(rule.pattern)
        places = F.when(asked, spans(F.col("_text"), rule)).otherwise(none)
        lists.append(_named(places, k, rule.kind))
    flat = F.array_sort(F.concat(*lists))
    return rows.select(F.col("_doc").alias(id_column), flat.alias("found"))


def _named(places: Column, order: int, kind: str) -> Column:
    return F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))
