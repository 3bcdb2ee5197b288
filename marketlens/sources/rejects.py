"""Raw CSV files landed with a reject channel, and their profile by file.

A permissive read turns what it can't parse into NULLs without a trace. Here each table is read once, with the text of
malformed rows kept; good rows are landed as the raw layer, malformed ones beside it with their file and a reason.
The fail-fast load of the clean layer (``io.read_clean_csv``) stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.exprs import count_if
from marketlens.operators.digests import row_bytes
from marketlens.sources.io import MULTI_LINE, TS_FORMAT
from marketlens.sources.schemas import RAW_COLUMNS, struct

RECORD, FILE = "_corrupt_record", "_file"
#: Stands for a missing field where empty ones must be told from it.
_NONE = "\x01"


def _kept(spark: SparkSession, table: str, path: str, columns: list[tuple[str, str]], header: bool) -> DataFrame:
    reader = spark.read.schema(struct([*columns, (RECORD, "string")])).option("columnNameOfCorruptRecord", RECORD).option("mode", "PERMISSIVE")
    reader = reader.option("header", header).option("escape", '"').option("encoding", "UTF-8").option("multiLine", table in MULTI_LINE)
    rows = reader.option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT).csv(path)
    return rows.withColumn(FILE, F.col("_metadata.file_name"))


def reject_reason(record: str | Column, columns: list[tuple[str, str]]) -> Column:
    """Why a row's text doesn't fit the columns: too many or too few of them, or the first value of another type."""
    names = [c for c, _ in columns]
    fields = F.from_csv(record, ", ".join(f"`{c}` string" for c in [*names, "_more"]), {"escape": '"', "nullValue": _NONE, "emptyValue": "", "multiLine": "true"})
    reason = F.when(fields["_more"].isNotNull(), F.lit("too many columns")).when(fields[names[-1]].isNull(), F.lit("too few columns"))
    for c, kind in columns:
        if kind != "string":
            value = fields[c]
            reason = reason.when((value != "") & value.try_cast(kind).isNull(), F.lit(f"{c} is not {kind}"))
    return reason.otherwise(F.lit("malformed"))


def land_raw_csv(spark: SparkSession, paths: dict[str, str], base: str, header: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """The raw layer of CSV files, landed under ``base``; and the rejected rows: ``table_name, file_name, record, reason``.

    A row is in exactly one of both. NULL and empty fields are no fault; a row with too few or too many columns, or with a
    value that its column's type can't hold, is rejected whole.
    """
    frames, rejects = {}, []
    for table, path in paths.items():
        columns = RAW_COLUMNS[table]
        _kept(spark, table, path, columns, header).withColumn("_bad", F.col(RECORD).isNotNull()).write.mode("overwrite").partitionBy("_bad").parquet(f"{base}/{table}")
        landed = spark.read.schema(struct([*columns, (RECORD, "string"), (FILE, "string"), ("_bad", "boolean")])).parquet(f"{base}/{table}")
        frames[table] = landed.where("NOT _bad").select(*[c for c, _ in columns])
        bad = landed.where("_bad")
        rejects.append(bad.select(F.lit(table).alias("table_name"), F.col(FILE).alias("file_name"), F.col(RECORD).alias("record"), reject_reason(RECORD, columns).alias("reason")))
    return frames, reduce(DataFrame.unionByName, rejects)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected rows by table and reason."""
    return rejects.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("rejected_rows"))


def file_profile(spark: SparkSession, paths: dict[str, str], header: bool = True) -> DataFrame:
    """``file_name, rows, columns, duplicate_rows, missing_cells, file_size_mb`` of every file, from one scan of a table.

    Equal rows of a file are counted by their digests in one hash aggregation; names and sizes come from the scan's own
    metadata. A file without any data row has no row here.
    """
    parts = []
    for table, path in paths.items():
        columns = RAW_COLUMNS[table]
        reader = spark.read.schema(struct(columns)).option("header", header).option("escape", '"').option("encoding", "UTF-8").option("multiLine", table in MULTI_LINE)
        df = reader.csv(path)
        missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c, _ in columns])
        rows = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("size"), missing.alias("missing"), F.unhex(F.md5(row_bytes(df))).alias("row"))
        same = rows.groupBy("path", "file_name", "size", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))
        parts.append(
            same.groupBy("path", "file_name", "size").agg(
                F.sum("n").alias("rows"),
                F.lit(len(columns)).cast("long").alias("columns"),
                F.sum(F.col("n") - 1).alias("duplicate_rows"),
                F.sum("missing").alias("missing_cells"),
            )
        )
    size = F.round(F.col("size") / F.lit(1024 * 1024), 2).alias("file_size_mb")
    return reduce(DataFrame.unionByName, parts).select("file_name", "rows", "columns", "duplicate_rows", "missing_cells", size)


# --- a check of the channel on the given tables -----------------------------------------------

#: Of a hundred payment lines (by the MD5 of their key), so many get a further column, lose their last, or get a value that is no number.
DAMAGE = {"too many columns": 3, "too few columns": 2, "payment_value is not double": 4}


def damaged_payments(payments: DataFrame) -> DataFrame:
    """Payments as CSV lines, some damaged by rule: what the reject channel is checked against."""
    key = F.concat_ws(":", "order_id", F.col("payment_sequential").cast("string"))
    fate = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100
    names = [c for c, _ in RAW_COLUMNS["payments"]]
    whole, short = F.to_csv(F.struct(*names)), F.to_csv(F.struct(*names[:-1]))
    wrong = F.to_csv(F.struct(*names[:-1], F.lit("n/a").alias(names[-1])))
    many, few, odd = DAMAGE.values()
    line = F.when(fate < many, F.concat(whole, F.lit(",more"))).when(fate < many + few, short).when(fate < many + few + odd, wrong).otherwise(whole)
    return payments.select(line.alias("value"))


def rejected_payments(payments: DataFrame, base: str) -> DataFrame:
    """The payments written as CSV with damaged lines and read back: ``reason, rows``, the good rows as reason ``accepted``."""
    damaged_payments(payments).write.mode("overwrite").text(f"{base}/payments-csv")
    frames, rejects = land_raw_csv(payments.sparkSession, {"payments": f"{base}/payments-csv"}, f"{base}/landed", header=False)
    good = frames["payments"].agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("payment_value").isNull()).alias("without_value"))
    bad = reject_counts(rejects).select("reason", F.col("rejected_rows").alias("rows"), F.lit(0).cast("long").alias("without_value"))
    return good.select(F.lit("accepted").alias("reason"), "rows", "without_value").unionByName(bad)
