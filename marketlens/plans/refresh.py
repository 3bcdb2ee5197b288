"""Incremental refresh of the order and item models.

The models lie in folders by purchase month. After a load of new clean tables, the orders whose rows differ are found by
multiset fingerprints (inserts, updates, late payments and reviews, deletions, and changed customers, products or sellers by
their orders). Their per-order aggregates and model rows are computed from their own children only, and the months that
held or hold one of them are written again, the others are left as they are.

Dealing rows out to their months moves all columns of a model, so large models are written in slices, one after the
other: the shuffle of one slice is on the disks at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import fingerprints, model
from marketlens.session import PARQUET

MODELS = ("order_summary", "order_item_detail")
MONTH = "purchase_month"
#: Tables compared, and their keys.
_BY_ORDER = ("orders", "order_items", "payments", "reviews")
#: Rows that a slice should hold, and the most slices.
SLICE_ROWS, SLICES = 1_000_000, 16
_BY_OTHER = {"customers": "customer_id", "products": "product_id", "sellers": "seller_id"}


def _models(clean: dict[str, DataFrame], dimensions: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    dimensions = dimensions or (clean["products"], clean["sellers"])
    return {
        "order_summary": model.order_summary(clean["orders"], clean["customers"], clean["order_items"], clean["payments"], clean["reviews"]),
        "order_item_detail": model.order_item_detail(clean["order_items"], clean["orders"], clean["customers"], *dimensions),
    }


def _slices(rows: int) -> int:
    return min(SLICES, max(1, -(-rows // SLICE_ROWS)))


def _write(df: DataFrame, path: str, mode: str) -> None:
    """``mode``: static (the whole folder), dynamic (the months of ``df``) or append."""
    # months go together, but one of many rows is split over tasks (adaptive execution), as there are few months
    writer = df.hint("rebalance", MONTH).write.partitionBy(MONTH).options(**PARQUET)
    writer = writer.mode("append") if mode == "append" else writer.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.parquet(path)


def read_models(spark: SparkSession, base: str, like: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stored models, with the columns, order and types of ``like``."""
    return {name: spark.read.schema(df.schema).parquet(f"{base}/{name}").select(*df.columns) for name, df in like.items()}


def build(clean: dict[str, DataFrame], base: str) -> dict[str, DataFrame]:
    """Both models from all orders, stored by purchase month; made in slices of the orders."""
    dimensions, n = model.dimensions(clean["products"], clean["sellers"]), _slices(clean["order_items"].count())
    made = _models(clean, dimensions)
    for i in range(n):
        inside = F.pmod(F.xxhash64("order_id"), F.lit(n)) == i  # the hash of NULL is a number too
        for name, df in _models({t: df.where(inside) if n > 1 and "order_id" in df.columns else df for t, df in clean.items()}, dimensions).items():
            _write(df, f"{base}/{name}", "append" if i else "static")
    return read_models(clean["orders"].sparkSession, base, made)


def changed_orders(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """``order_id`` of the orders whose model rows can differ between two states of the clean tables."""
    spark = new["orders"].sparkSession
    pairs = [fingerprints.Pair(t, "order_id", old[t], new[t]) for t in _BY_ORDER]
    pairs += [fingerprints.Pair(t, key, old[t], new[t]) for t, key in _BY_OTHER.items()]
    _, keys = fingerprints.compare(pairs)
    if keys is None:
        return spark.createDataFrame([], "order_id string")
    parts = [keys.where(F.col("check_name").isin(*_BY_ORDER)).select(F.col("key").alias("order_id"))]
    for t, key in _BY_OTHER.items():
        holder = "orders" if t == "customers" else "order_items"
        named = keys.where(F.col("check_name") == t).select(F.col("key").alias(key))
        parts += [state[holder].join(named, key, "left_semi").select("order_id") for state in (old, new)]
    return reduce(DataFrame.union, parts).distinct()


def refresh(clean: dict[str, DataFrame], changed: DataFrame, base: str, scratch: str) -> list:
    """Bring the models stored under ``base`` to the state of ``clean``, given the orders that changed; the months written
    (or emptied) again. ``scratch`` is a shared folder for what lies between."""
    spark = changed.sparkSession
    work = f"{scratch.rstrip('/')}/refresh-{uuid.uuid4().hex}"
    changed.write.parquet(f"{work}/changed")
    changed = spark.read.schema(changed.schema).parquet(f"{work}/changed")
    own = {t: df.join(changed, "order_id", "left_semi") if "order_id" in df.columns else df for t, df in clean.items()}
    made, touched = _models(own, model.dimensions(clean["products"], clean["sellers"])), set()
    stored = read_models(spark, base, made)
    for name, df in made.items():
        df.write.options(**PARQUET).parquet(f"{work}/{name}")
        fresh = spark.read.schema(df.schema).parquet(f"{work}/{name}")
        # the months of the changed orders, before and after, and whether others stay there: one a month, few whatever the data
        one = F.lit(1)
        marked = stored[name].select("order_id", MONTH).join(changed.withColumn("_changed", one), "order_id", "left")
        held = marked.groupBy(MONTH).agg(F.count("_changed").alias("changed"), F.count(F.when(F.col("_changed").isNull(), one)).alias("left"))
        now = fresh.groupBy(MONTH).agg(F.count(one).alias("changed"), F.count(one).alias("left"))
        found = held.where("changed > 0").union(now).collect()
        months = {r[MONTH] for r in found}
        for some in _groups(found):
            inside = reduce(lambda a, b: a | b, [F.col(MONTH).eqNullSafe(F.lit(m).cast("date")) for m in some])
            stay = stored[name].where(inside).join(changed, "order_id", "left_anti")
            # the new files lie beside the old ones until the job's commit puts them in their place, so it may read what it replaces
            _write(stay.unionByName(fresh.where(inside)), f"{base}/{name}", "dynamic")
        left = {r[MONTH] for r in found if r["left"]}
        for m in months - left:  # a month without rows is not written: its folder goes
            _delete(spark, f"{base}/{name}/{MONTH}={'__HIVE_DEFAULT_PARTITION__' if m is None else m}")
        touched |= months
    _delete(spark, work)
    return sorted(touched, key=lambda m: (m is not None, m))


def _groups(found: list[Row]) -> list[set]:
    """The months in slices of about as many rows."""
    rows: dict = {}
    for r in found:  # a month's stored rows, and its new ones
        rows[r[MONTH]] = rows.get(r[MONTH], 0) + r["changed"] + r["left"]
    n = _slices(sum(rows.values()))
    groups = [[0, set()] for _ in range(n)]
    for m in sorted(rows, key=rows.get, reverse=True):
        least = min(groups, key=lambda g: g[0])
        least[0] += rows[m]
        least[1].add(m)
    return [some for _, some in groups if some]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


# --- a refresh on the given tables -------------------------------------------------------------


def earlier_state(clean: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A state before the last load, by rule (the MD5 of the order): some orders are not there yet, some reviews and
    payments not yet in, some orders not yet delivered, some bought in another month, one in a hundred since deleted."""
    fate = F.conv(F.substring(F.md5("order_id"), 1, 8), 16, 10).cast("long") % 100
    late = lambda lo, hi: fate.between(lo, hi)
    orders = clean["orders"].where(~late(0, 2))
    bought, status = F.col("order_purchase_timestamp"), F.col("order_status")
    orders = orders.withColumns(
        {
            "order_purchase_timestamp": F.when(late(3, 3), F.add_months(bought, -1).cast("timestamp_ntz")).otherwise(bought),
            "order_status": F.when(late(4, 5), F.lit("shipped")).otherwise(status),
        }
    )
    gone = clean["orders"].where(late(9, 9)).withColumn("order_id", F.concat(F.lit("gone-"), F.col("order_id")))
    out = dict(clean)
    out["orders"] = orders.unionByName(gone)
    out["reviews"] = clean["reviews"].where(~late(0, 2) & ~late(6, 7))
    out["payments"] = clean["payments"].where(~late(0, 2) & ~late(8, 8))
    out["order_items"] = clean["order_items"].where(~late(0, 2))
    return out


def refreshed(clean: dict[str, DataFrame], base: str) -> dict[str, DataFrame]:
    """The models of the earlier state, refreshed to the given one."""
    before = earlier_state(clean)
    made = build(before, f"{base}/models")
    refresh(clean, changed_orders(before, clean), f"{base}/models", base)
    return read_models(clean["orders"].sparkSession, f"{base}/models", made)
