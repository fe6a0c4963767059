"""A small table of awkward documents, and columns whose names clash with what operators use inside."""

import re
from pathlib import Path

from pyspark.sql import functions as F

import junctura.llm

#: Every name with a leading underscore that an operator's source has in quotes, some plain ones, and one with a dot.
_SOURCE = "".join(p.read_text() for p in Path(junctura.llm.__file__).parent.glob("*.py"))
CLASHES = sorted(set(re.findall(r'"(_[A-Za-z]\w*)"', _SOURCE)) - {"_id", "_text"}) + ["a.b"] + ["_id", "_text", "_fp", "_len", "_norm", "_row", "kept", "keep_id", "score", "found", "piece", "length", "copy", "shuffle_key", "_source", "_rate", "_n", "media", "_low", "_kinds", "_junctura_p", "_html", "_first", "row", "a"]
LONG = "word " * 30_000
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t", "en", "a"),
    (4, "Hello world this is text", "en", "a"),
    (4, "Hello world this is text", "en", "a"),
    (5, "Hello world  this is text ", "en", "b"),
    (None, "no id here but some text", None, "b"),
    (None, "no id here but some text", None, "b"),
    (6, "a" * 60_000, "de", None),
    (7, LONG, "de", "b"),
    (8, "ünïcödé 😀 token = abcdefghijkl1234 end", "fr", "a"),
    (9, "Hello world this is text", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


def nothing(spark):
    return documents(spark, [])
