"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Every stage works on all rows its predecessor has kept, and all but the last return the columns of ``documents``. Decisions
that need a document's text again are taken where the text is, so that no stage relies on unique ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontam, mixing, quality, simhash, tokenbin
from marketlens.llm.common import delete_folder, land, recorded, release, table
from marketlens.llm.queries import END_ID, tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """A stage whose intermediates go when the next stage begins: by then its outcome is landed and read from there."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs)
        with recorded():
            return f(spark, docs, sf_dir)

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word passage of a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents written as token shards; a row for each, read back from them."""
    manifest = tokenbin.write_tokens(docs, tokenizer_path(), END_ID)
    return tokenbin.read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality_rules", _stage(quality_rules)),
    ("simhash_near_dedup", _stage(near_duplicates)),
    ("benchmark_decontamination", _stage(decontamination)),
    ("source_mix", _stage(source_mix)),
    ("token_output", _stage(token_output)),
]

#: Robust estimates, fingerprints, components and token files have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet, read back, and deleted once the next stage's are landed."""
    docs, landed = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, before = land(stage(spark, docs, sf_dir), f"pipeline-{name}"), landed
        landed = docs._jdf.queryExecution().analyzed().relation().location().rootPaths().head().toString()
        if before:
            delete_folder(spark, before)
    return docs
