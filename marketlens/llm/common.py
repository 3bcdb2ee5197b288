"""Shared pieces: tables, landing in the shared folder, size-checked broadcast, Arrow text batches."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir

#: Broadcast sides are counted first; above this many narrow rows the join is shuffled instead.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that tasks can import it where it is not installed.
    A Python function takes along what was sent before it was made, so operators call this first."""
    import marketlens

    sc, top = spark.sparkContext, Path(marketlens.__file__).parent
    if sc.applicationId in _shipped or not top.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    uri = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketlens-{uuid.uuid4().hex}.zip"
    fs, path = shared_files(uri)
    with fs.open_output_stream(path) as out:
        out.write(packed.getvalue())
    sc.addPyFile(uri)
    _shipped.add(sc.applicationId)


#: Folders made inside ``recorded`` blocks, by application, until ``release`` deletes them.
_recorded: dict[str, list[str]] = {}
_recording = False


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if _recording:
        _recorded.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def recorded() -> Iterator[None]:
    """Folders made in this block hold the intermediates of one step; ``release`` may delete them later."""
    global _recording
    before, _recording = _recording, True
    try:
        yield
    finally:
        _recording = before


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release(result: DataFrame) -> None:
    """Delete the recorded intermediates that ``result``, the landed outcome of the steps so far, does not read."""
    spark = result.sparkSession
    files = result.inputFiles()
    held = _recorded.pop(spark.sparkContext.applicationId, [])
    names = {path: path.rpartition("/")[2] for path in held}
    used = {path for path in held if any(names[path] in f for f in files)}
    for path in held:
        if path not in used:
            delete_folder(spark, path)
    if used:
        _recorded[spark.sparkContext.applicationId] = [path for path in held if path in used]


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as keep it apart from the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Parquet options of frames whose rows are MB long. By default a page and a row group are first measured after 100 rows, and
#: writer and reader hold them whole.
LONG_ROWS = {"parquet.block.row.count.limit": "4", "parquet.page.row.count.limit": "1"}


def land(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: lineage is cut, every
    executor can read it, and a lost executor costs one re-read."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (it must be landed: it is counted);
    otherwise unchanged, so the join is a shuffled one and adaptive execution splits skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds at most ``max_bytes`` of text (or one row), which
    bounds the numpy temporaries made for a piece."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = byte_lengths(batch.column(column))
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) back to back, and the n + 1 row offsets."""
    import pyarrow.compute as pc

    lengths = byte_lengths(col)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    joined = b"".join(pc.fill_null(col.cast(pa.large_binary()), b"").to_pylist())
    return np.frombuffer(joined, np.uint8), offsets


def shared_files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a file in the shared folder, for tasks that need more than Spark's
    readers and writers: range reads and file formats of their own."""
    if "://" not in uri and ":/" in uri:  # Hadoop writes file:/path
        uri = uri.replace(":/", ":///", 1)
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
