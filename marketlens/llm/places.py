"""Rows told by where they stand in landed files, so that a decision on narrow rows reaches the texts without moving them.

A row of a Parquet file is its file's path and its number in it. A decision is written as such pairs, dealt to a
fixed number of folders by the path's hash; the task that reads a file's rows fetches that file's pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import free_name, land, shared_files, shared_folder


def in_files(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is nothing but files as they stand, else landed."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRelation" and str(plan.relation().toString()).lower().startswith("parquet"):
        return df
    return land(df, name)


def place(df: DataFrame) -> tuple[Column, Column]:
    """The path of a row's file, and the row's number in it."""
    told = df.metadataColumn("_metadata")
    return told["file_path"], told["row_index"]


def _folder_of(path: str, folders: int) -> int:
    return zlib.crc32(path.encode()) % folders


class _Chosen:
    """Row numbers that a decision holds for a file; the last file's are remembered."""

    def __init__(self, uri: str, folders: int) -> None:
        self.uri, self.folders, self.path, self.rows = uri, folders, None, np.empty(0, np.int64)

    def of(self, path: str) -> np.ndarray:
        if path != self.path:
            fs, folder = shared_files(f"{self.uri}/folder={_folder_of(path, self.folders)}")
            found = [f.path for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".parquet")]
            rows = [np.empty(0, np.int64)]
            for f in found:
                with fs.open_input_file(f) as source:
                    rows.append(pq.read_table(source, columns=["at"], filters=pc.field("file") == path).column("at").to_numpy())
            self.path, self.rows = path, np.sort(np.concatenate(rows))
        return self.rows


def rows_at(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``df`` (see ``in_files``) whose places are in ``chosen`` (file, at), as they stand and where they are."""
    spark = df.sparkSession
    folders = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = shared_folder(spark, "chosen")
    dealt = chosen.select("file", "at", F.pmod(F.crc32("file"), F.lit(folders)).cast("int").alias("folder"))
    dealt.repartition(folders, "folder").sortWithinPartitions("folder", "file", "at").write.partitionBy("folder").parquet(uri)
    names, file_name, at_name = df.columns, free_name(df, "file"), free_name(df, "at")

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Chosen(uri, folders)
        for batch in batches:
            at, paths = batch.column(at_name).to_numpy(), batch.column(file_name).dictionary_encode()
            keep, which = np.zeros(len(at), bool), paths.indices.to_numpy()
            for i, path in enumerate(paths.dictionary.to_pylist()):
                rows, mine = known.of(path), which == i
                if len(rows):
                    keep[mine] = rows[np.minimum(np.searchsorted(rows, at[mine]), len(rows) - 1)] == at[mine]
            yield batch.select(names).filter(pa.array(keep))

    file, at = place(df)
    return df.select(*(F.col(f"`{c}`") for c in names), file.alias(file_name), at.alias(at_name)).mapInArrow(stay, df.schema)
