"""The shared model: clean tables plus the order and item models.

Nearly every analytic reads ``order_summary`` (V05) or ``order_item_detail``
(V06), and the reference recomputes that stack for every export. Here the raw
layer, the clean layer and the two models are each written once per (session,
data root) as parquet in the shared checkpoint folder and read back, so each
report is one short-lineage job over a materialized model. The large tables are
cleaned in the pass that makes their raw rows, unless a report has read the raw
layer before.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import cleaning, digests, model, observed, sales
from marketlens.session import PARQUET, ensure_checkpoint_dir
from marketlens.sources import testdata

# The adapter's extra translation (its untranslated category) on top of the
# reference's manual rows.
TEST_MANUAL_TRANSLATIONS = cleaning.MANUAL_TRANSLATIONS + [
    (testdata.UNTRANSLATED_CATEGORY, "en_" + testdata.UNTRANSLATED_CATEGORY)
]


#: Clean tables that nearly every model and report groups or joins by one key.
BUCKETS = {"orders": "order_id", "order_items": "order_id", "payments": "order_id", "reviews": "order_id", "customers": "customer_id"}


#: Tables that grow with the orders.
LARGE = frozenset(BUCKETS)


class Marketplace:
    """Raw, clean and model frames for one data root."""

    def __init__(self, spark: SparkSession, sf_dir: str, persist: bool = True, land: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self._persist = persist
        self._land_layers = land
        self._folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketlens-{uuid.uuid4().hex[:12]}"
        self._kept: list[DataFrame] = []
        self._metrics: dict[str, observed.Metrics] = {}
        self._raw: dict[str, DataFrame] = {}
        self._tables: list[str] = []
        #: Report frames built over this data root (see ``registry.Views``).
        self.memo: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Persist a frame until ``close``."""
        if not self._persist:
            return df
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def close(self) -> None:
        """Unpersist what was kept and delete the landed layers; frames of this object can't be read after."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        self.memo.clear()
        for name in ("_source", "raw", "clean", "order_summary", "order_item_detail", "order_customers", "completed_items", "dimensions", "distinct_values", "distinct_rows"):
            self.__dict__.pop(name, None)
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()
        self._metrics.clear()
        self._raw.clear()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(conf).delete(path, True)
        _CACHE.pop(_cache_key(self.spark, self.sf_dir), None)

    def _land(
        self, layer: str, frames: dict[str, DataFrame], checks: dict | None = None, buckets: dict[str, str] | None = None, dealt: frozenset[str] = frozenset()
    ) -> dict[str, DataFrame]:
        """Write a layer as parquet in the shared checkpoint folder and read it back.

        This is the reference's "clean CSV -> load" boundary: downstream jobs
        read a materialized table (lineage cut, survives executor loss) instead
        of re-running the adapter and cleaning plans for every report. With
        ``checks`` the layer's metrics are observed by the same pass. Tables in
        ``buckets`` are written in buckets of that key, one file each, so that
        groupings and joins on it need no exchange; those in ``dealt`` are
        already dealt out by it.
        """
        if not self._land_layers:
            return frames
        base, buckets = f"{self._folder}/{layer}", buckets or {}
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def write(item: tuple[str, DataFrame]) -> tuple[str, dict[str, int]]:
            name, df = item
            metrics = None
            if name in buckets and name not in dealt:
                df = df.repartition(n, buckets[name])
            if checks is not None:
                # above the exchange: in the write's own stage, whose tasks count once
                df, metrics = observed.observed(df, f"{layer}.{name}", checks.get(name, {}))
            writer = df.write.mode("overwrite").format("parquet").options(**PARQUET)
            if name in buckets:
                writer = writer.bucketBy(n, buckets[name]).sortBy(buckets[name])
                writer.option("path", f"{base}/{name}").saveAsTable(self._table_name(layer, name))
                self._tables.append(self._table_name(layer, name))
            else:
                writer.save(f"{base}/{name}")
            return name, metrics.get if metrics else {}

        # The writes are independent jobs; the large tables, one of which fills the cluster, are written in turn, so
        # that the shuffle of one is on the disks at a time, and the small ones beside them.
        small = {name: df for name, df in frames.items() if name not in LARGE}
        with ThreadPoolExecutor(max_workers=1 + len(small)) as pool:
            large = pool.submit(lambda: [write(item) for item in frames.items() if item[0] in LARGE])
            done = dict([*pool.map(write, small.items()), *large.result()])
        if checks is not None:
            self._metrics.setdefault(layer, {}).update(done)
        return {name: self.spark.table(self._table_name(layer, name)) if name in buckets else self.spark.read.parquet(f"{base}/{name}") for name in frames}

    def _table_name(self, layer: str, name: str) -> str:
        return f"{self._folder.rpartition('/')[2].replace('-', '_')}_{layer}_{name}"

    def scratch(self, name: str) -> str:
        """A folder for what a report writes on its way; ``close`` deletes it."""
        return f"{self._folder}/{name}-{uuid.uuid4().hex[:8]}"

    def metrics(self, layer: str) -> observed.Metrics:
        """Rows, missing values and checks of the raw or clean layer, observed when it was landed."""
        frames, checks = (self.raw, observed.RAW_CHECKS) if layer == "raw" else (self.clean, observed.CLEAN_CHECKS)
        if layer not in self._metrics:
            self._metrics[layer] = observed.measure(frames, checks)
        return self._metrics[layer]

    @cached_property
    def _source(self) -> dict[str, DataFrame]:
        """The raw tables as the adapter makes them, not landed."""
        return testdata.raw_tables(self.spark, self.sf_dir)

    def _land_raw(self, names: list[str]) -> dict[str, DataFrame]:
        """The named raw tables; those not landed before are landed together."""
        if missing := {t: self._source[t] for t in names if t not in self._raw}:
            self._raw.update(self._land("raw", missing, observed.RAW_CHECKS))
        return {t: self._raw[t] for t in names}

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return self._land_raw(list(self._source))

    @cached_property
    def clean(self) -> dict[str, DataFrame]:
        """The clean layer; landing it raises if one of the cleaning job's final invariants fails.

        A bucketed table is cleaned row by row. Where its raw rows aren't landed yet, they are dealt out by the bucket's key,
        observed, cleaned and written in one stage; ``raw`` lands them when a report reads them.
        """
        if not self._land_layers:
            return cleaning.clean_tables(self.raw, TEST_MANUAL_TRANSLATIONS)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = [t for t in BUCKETS if t not in self._raw]
        raw, seen = self._land_raw([t for t in self._source if t not in dealt]), {}
        for t in dealt:
            # above the exchange, as in ``_land``: the stage of the write, whose tasks count once
            raw[t], seen[t] = observed.observed(self._source[t].repartition(n, BUCKETS[t]), f"raw.{t}", observed.RAW_CHECKS.get(t, {}))
        frames = cleaning.clean_tables(raw, TEST_MANUAL_TRANSLATIONS)
        clean = self._land("clean", frames, observed.CLEAN_CHECKS, BUCKETS, frozenset(dealt))
        self._metrics["raw"].update({t: metrics.get for t, metrics in seen.items()})
        observed.assert_clean(self._metrics["raw"], self._metrics["clean"], clean["geolocation"], known=testdata.KNOWN_FAILURES)
        return clean

    def _distinct(self, layer: str, cells: digests.Cells) -> DataFrame:
        """Counted table by table, so that the digests of one are on the disks at a time."""
        return reduce(DataFrame.unionByName, self._land(layer, {t: digests.distinct_values({t: df}, cells) for t, df in self.raw.items()}).values())

    @cached_property
    def distinct_values(self) -> DataFrame:
        """Distinct values of every raw column."""
        return self._distinct("distinct_values", "columns")

    @cached_property
    def distinct_rows(self) -> DataFrame:
        """Distinct raw rows of every table."""
        return self._distinct("distinct_rows", "rows")

    def table(self, name: str) -> DataFrame:
        return self.clean[name]

    def _model(self, name: str, df: DataFrame) -> DataFrame:
        """A model landed as parquet: every report scans it with column pruning and filter pushdown instead of
        re-planning its lineage. Each is landed when a report first reads it; many read one of the two."""
        return self._land("model", {name: df}, buckets={name: "order_id"})[name] if self._land_layers else self.keep(df)

    @cached_property
    def order_summary(self) -> DataFrame:
        """V05."""
        c = self.clean
        return self._model("order_summary", model.order_summary(c["orders"], self.order_customers, c["order_items"], c["payments"], c["reviews"]))

    @cached_property
    def order_item_detail(self) -> DataFrame:
        """V06."""
        c = self.clean
        return self._model("order_item_detail", model.order_item_detail(c["order_items"], c["orders"], self.order_customers, *self.dimensions))

    @cached_property
    def dimensions(self) -> tuple[DataFrame, DataFrame]:
        """Products and sellers as the joins with the items read them."""
        both = self.clean["products"], self.clean["sellers"]
        return model.dimensions(*both) if self._land_layers else both

    @cached_property
    def order_customers(self) -> DataFrame:
        """The customer of each order, in the orders' buckets: the one join on the customer key, taken once for both models."""
        frame = model.order_customers(self.clean["orders"], self.clean["customers"])
        return self._land("links", {"order_customers": frame}, buckets={"order_customers": "order_id"})["order_customers"]

    @cached_property
    def completed_items(self) -> DataFrame:
        """Items of completed orders, landed once: the category and product reports scan it for every distinct count."""
        return self._land("items", {"completed_items": self._completed()})["completed_items"]

    def _completed(self) -> DataFrame:
        return sales.completed_items(self.clean["order_items"], self.order_summary, self.dimensions[0])

    def items_of_sellers(self) -> DataFrame:
        """The same for the seller reports, which scan it twice: made from the buckets of items and orders where it isn't
        landed yet, as it is as large as the items."""
        return self.completed_items if "completed_items" in self.__dict__ else self._completed()


_CACHE: dict[tuple[str, str], Marketplace] = {}


def _cache_key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def marketplace(spark: SparkSession, sf_dir: str) -> Marketplace:
    """The one Marketplace of an application and data root; ``close`` it to read a rewritten folder again."""
    key = _cache_key(spark, sf_dir)
    m = _CACHE.get(key)
    if m is None:
        m = _CACHE[key] = Marketplace(spark, sf_dir)
    return m
