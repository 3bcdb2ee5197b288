"""X1 micro-benchmark: distributed global ranking vs the single-partition window.

Usage: python tools/bench_ranking.py [rows]   (synthetic keys; not a registered query)
"""

import json
import sys
import time

sys.path.insert(0, ".")
from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marketlens.operators.ranking import rank_globally  # noqa: E402
from marketlens.session import local_session  # noqa: E402

rows = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
spark = local_session(cores=8, shuffle_partitions=16)
# a third of all rows share one value (hot key)
df = spark.range(rows).select(
    F.col("id").cast("string").alias("k"),
    F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.col("id") * 7919, F.lit(100003))).cast("decimal(16,2)").alias("v"),
)
res = {"rows": rows}

t = time.time()
r = rank_globally(df, [("v", True), ("k", False)], row_number="rn", dense_rank=("dr", ["v"]), ntiles={"nt": 5}, running_sum=("v", "cs"))
r.write.format("noop").mode("overwrite").save()
res["distributed_sec"] = round(time.time() - t, 2)

o = [F.col("v").desc(), F.col("k")]
w = W.orderBy(*o)
t = time.time()
s = df.select(
    "k",
    F.row_number().over(w).alias("rn"),
    F.dense_rank().over(W.orderBy(o[0])).alias("dr"),
    F.ntile(5).over(w).alias("nt"),
    F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cs"),
)
s.write.format("noop").mode("overwrite").save()
res["single_partition_sec"] = round(time.time() - t, 2)
print(json.dumps(res))
