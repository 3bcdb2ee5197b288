"""Distinct values of all columns and distinct rows from digests, each in one shuffle a table.

Every cell becomes (column number, 128-bit digest of its text), every row one more cell of a column of its own.
Digests are counted where they are made and shuffled once; texts are not. A second, independent hash of the same
value must be equal wherever digests are, else the count raises: two values never count as one.
"""

from __future__ import annotations

from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, StructField

from marketlens.functions.exprs import pct
from marketlens.operators.observed import Metrics

#: Column name of the whole row.
ROW = ""
#: What is counted: the values of columns, whole rows, or both.
Cells = Literal["columns", "rows", "all"]


def _text(f: StructField) -> Column:
    """The value as bytes, equal for equal values; NULL stays NULL."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, BinaryType):
        return c
    if isinstance(f.dataType, (DoubleType, FloatType)):
        c = c + F.lit(0.0)  # one zero
    return F.encode(c.cast("string"), "UTF-8")


def _row(texts: list[Column]) -> Column:
    return F.concat(*[F.coalesce(F.concat(F.encode(F.length(t).cast("string"), "UTF-8"), F.lit(b":"), t), F.lit(b"-")) for t in texts])


def row_bytes(df: DataFrame) -> Column:
    """All values of a row, each after its length, so that no two rows read alike."""
    return _row([_text(f) for f in df.schema.fields])


def _cells(df: DataFrame, number: int, kind: Cells = "all") -> DataFrame:
    # texts, then the row, then the hashes: each is worked out once, however often the next step reads it
    texts = [f"v{i}" for i in range(1, len(df.columns) + 1)]
    named = df.select(*[_text(f).alias(t) for f, t in zip(df.schema.fields, texts, strict=True)])
    values = named.select(_row([F.col(t) for t in texts]).alias("v0"), *texts)
    wanted = [(i, v) for i, v in enumerate(values.columns) if kind == "all" or (kind == "rows") == (i == 0)]
    cells = [F.struct(F.lit(number + i).alias("c"), F.unhex(F.md5(v)).alias("digest"), F.xxhash64(v).alias("check")) for i, v in wanted]
    return values.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where(F.col("digest").isNotNull())


def distinct_values(tables: dict[str, DataFrame], kind: Cells = "all") -> DataFrame:
    """``table_name, column_name, unique_count`` of every column, and of whole rows (column name empty), or of one of the two."""
    names, parts = [], []
    for t, df in tables.items():
        parts.append(_cells(df, len(names), kind))
        names += [(t, c) for c in (ROW, *df.columns)]
    cells = reduce(DataFrame.unionByName, parts).groupBy("c", "digest").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
    same = F.when(F.col("lo") != F.col("hi"), F.raise_error("two values of one digest").cast("long")).otherwise(F.lit(1).cast("long"))
    counts = cells.groupBy("c").agg(F.sum(same).alias("unique_count"))
    spark = counts.sparkSession
    every = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(names) if kind == "all" or (kind == "rows") == (c == ROW)], "c int, table_name string, column_name string")
    return every.join(counts, "c", "left").select("table_name", "column_name", F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count"))


def schema_overview(tables: dict[str, DataFrame], metrics: Metrics, distinct: DataFrame) -> DataFrame:
    """Q01: per column type, rows, non-null, missing, missing %, distinct values."""
    rows = [
        (t, f.name, f.dataType.simpleString(), metrics[t]["rows"], metrics[t][f"missing:{f.name}"]) for t, df in tables.items() for f in df.schema.fields
    ]
    known = distinct.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, row_count long, missing_count long")
    return known.join(distinct, ["table_name", "column_name"]).select(
        "table_name", "column_name", "data_type", "row_count", (F.col("row_count") - F.col("missing_count")).alias("non_null_count"), "missing_count",
        pct("missing_count", "row_count").alias("missing_pct"), "unique_count",
    )


def dataset_inventory(tables: dict[str, DataFrame], metrics: Metrics, distinct: DataFrame) -> DataFrame:
    """C20: rows, columns, exact duplicate rows and missing cells per table."""
    missing = lambda t: sum(n for k, n in metrics[t].items() if k.startswith("missing:"))
    rows = [(t, metrics[t]["rows"], len(df.columns), missing(t)) for t, df in tables.items()]
    known = distinct.sparkSession.createDataFrame(rows, "table_name string, rows long, columns long, missing_cells long")
    whole = distinct.where(F.col("column_name") == ROW)
    return known.join(whole, "table_name").select("table_name", "rows", "columns", (F.col("rows") - F.col("unique_count")).alias("duplicate_rows"), "missing_cells")
