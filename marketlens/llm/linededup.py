"""Corpus-wide line dedup in DataFrame functions.

Lines are exploded as 120-bit keys of their normalised form, counted over documents, and the positions
of lines over the threshold come back to their text, where the kept pieces between them are joined
again. Only narrow rows are shuffled for counting: equal texts are one group (their number is the
weight of each of their keys), so a text with very many copies, or a line found in a third of all
documents, is pre-aggregated before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import land, small_side

#: ASCII white space that can stand inside a line (\\n ends it).
_BLANKS = "\x20\x09\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(c: Column) -> Column:
    """120 bits of SHA-256 as text: one plain value, which array functions put into hash sets (structs are compared pair by pair)."""
    return F.base64(F.substring(F.unhex(F.sha2(c, 256)), 1, 15))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The normalised lines of a text: ASCII white space stripped at both ends, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)))


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_key_chars: int = 1) -> DataFrame:
    """``docs`` with ``kept_text`` (lines joined by \\n), ``n_lines`` and ``n_dropped`` added.

    A line goes if its key has at least ``min_key_chars`` code points and is found in at least
    ``min_docs`` rows of ``docs`` (each row is a document, repeated rows too); it goes everywhere. Null
    or empty text: one empty line, ``kept_text`` "". All lines gone: "". Blank lines always stay.
    Columns of ``docs`` are kept; the working columns' names start with ``__``. Empty table: no rows.
    """
    text = F.col(text_col)
    body = F.coalesce(text, F.lit(""))
    keyed = docs.select(_key(body).alias("__t"), body.alias("__text"))
    hashed = F.transform(line_keys(F.col("__text")), lambda x: F.when(F.char_length(x) >= min_key_chars, _key(x)))
    # one row per text: its number of copies and its line keys (equal texts have equal keys)
    texts = land(
        keyed.select("__t", hashed.alias("keys")).groupBy("__t").agg(F.count(F.lit(1)).alias("copies"), F.any_value("keys").alias("keys")),
        "lines",
    )
    lines = texts.select("__t", "copies", F.posexplode("keys").alias("pos", "key")).filter("key is not null")
    distinct = texts.select("copies", F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null")
    common = land(distinct.groupBy("key").agg(F.sum("copies").alias("n")).filter(F.col("n") >= min_docs).select("key"), "common-lines")
    drops = lines.join(small_side(common), "key", "left_semi").groupBy("__t").agg(F.sort_array(F.collect_list("pos")).alias("__drop"))
    # landed, so that the join below has a plain exchange on either side and a text with very many copies can be split
    out = docs.withColumn("__t", _key(body)).join(land(drops, "line-drops"), "__t", "left")
    n = F.size("__drop")
    # the slices before the first, between consecutive and after the last dropped lines
    starts = F.concat(F.array(F.lit(0)), F.transform("__drop", lambda p: p + 1))
    sizes = F.transform(
        F.arrays_zip(starts.alias("s"), F.concat("__drop", F.array(F.size("__lines"))).alias("e")),
        lambda x: F.slice(F.col("__lines"), x["s"] + 1, x["e"] - x["s"]),
    )
    split = out.withColumn("__lines", _lines(text))
    kept = F.when(F.col("__drop").isNull(), body).otherwise(F.array_join(F.flatten(sizes), "\n"))
    return split.select(
        *docs.columns,
        kept.alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(n).cast("long").alias("n_dropped"),
    )
