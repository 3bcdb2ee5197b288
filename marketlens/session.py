"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: How layers and models are written: sorted ids and dates as differences (version 2's encodings).
PARQUET = {"compression": "zstd", "parquet.writer.version": "v2"}


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, only a session whose executors are this process (master ``local``) gets a scratch
    folder, as tests do; any other session raises, as each machine would write to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext; the server's setting applies
        if not d:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share") from None
        return d
    d = d or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        d = tempfile.mkdtemp(prefix="marketlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: Blocks of ``shuffles_deleted`` that are open in an application, and the setting before the first.
_open: dict[str, tuple[int, str | None]] = {}


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Jobs of frames made in this block (writes, checkpoints, collects) delete their shuffle files when they end; otherwise
    these stay until the driver's garbage collector finds the frame, and those of all layers and models lie on the disks at
    once. Frames handed out for reading belong outside: a frame read twice would make its shuffles again."""
    key = spark.sparkContext.applicationId
    with _lock:
        n, before = _open.get(key) or (0, spark.conf.get(_CLEANUP, None))
        _open[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _open.pop(key)
            if n > 1:
                _open[key] = n - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)
