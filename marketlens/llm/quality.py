"""Quality rules in DataFrame functions: fixed text rules, then robust multivariate outliers.

The base rules give word, symbol and repetition counts of the whole text. Documents that pass them are
judged by their transformed statistic vector: the minimum covariance determinant (MCD) estimate of
location and scatter of their language and source, and a cut on the robust Mahalanobis distance.

MCD by concentration steps: from a start (coordinate medians and quartile scales; plain mean and
covariance) take the ``h`` share of rows with the smallest distances, re-estimate from them, repeat until
the determinant of the scatter no longer falls, and keep the start whose scatter has the smaller determinant. A step is one aggregate: distances
fall into logarithmic bins, moments are summed by (group, bin), and a window over the at most
some hundred bins of a group finds the smallest bins that hold the share (the subset is closed under equal
bins, so no row-level ranking, sorting or sampling is needed). Statistic values are fixed-point
integers, whose double sums are exact up to some 10^7 rows a bin, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import land, small_side

WORD = r"[^\x20\x09-\x0D]"
#: Statistic and the variance floor's standard deviation: zero-inflated counts would make a subset's scatter singular.
FLOORS = {"words": 0.5, "word_length": 0.08, "symbols": 0.25, "dup_lines": 1.0, "repeats": 1.2}
DIMS = tuple(FLOORS)
P = len(DIMS)
SCALE = 1024
LEVELS = 3
#: Quantile of chi-square with P degrees of freedom at 0.99995; and the consistency factor of the MCD scatter for a share of 0.75.
CUTOFF = 27.4
CONSISTENCY = 1.41
#: Concentration steps at most; a group stops when the log determinant no longer falls by more than TOLERANCE. As subsets
#: are closed under equal bins their sizes vary, and the estimates alone could change for ever in a cycle.
MAX_STEPS = 100
TOLERANCE = 1e-9


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long) and
    ``base_failed`` added. Null text: no words, so it fails. Windows are compared by a 64-bit hash chain
    of their eight words."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__w", F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn("__n", F.size("__w"))
    out = out.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    window = F.transform(F.sequence(F.lit(0), F.col("__n") - 8), lambda i: F.xxhash64(*(F.get("__h", i + k) for k in range(8))))
    out = out.withColumn("__win", F.when(F.col("__n") >= 8, window))
    repeated = F.size(F.array_distinct("__win")) < F.size("__win")
    by_hash = F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(repeated, by_hash))
    twice = F.filter(
        "__s", lambda x, k: ((k > 0) & (F.get("__s", k - 1)["h"] == x["h"])) | ((k < F.size("__s") - 1) & (F.get("__s", k + 1)["h"] == x["h"]))
    )
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(8), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumn("__l", lines).select(
        *docs.columns,
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def statistic_vector() -> dict[str, Column]:
    """The transformed statistics of a row that passes the base rules, as fixed-point integers / SCALE."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    raw = {
        "words": F.log(n.cast("double")),
        "word_length": F.log(chars / n),
        "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.log1p(100 * F.col("n_repeat_words") / n),
    }
    return {k: F.round(v * SCALE).cast("long") for k, v in raw.items()}


def _group_key(level: Column) -> Column:
    """A group of estimates: language and source, language, or all; nulls are a group of their own."""
    return F.to_json(F.struct(level.alias("v"), F.when(level < 2, F.col("__lang")).alias("l"), F.when(level < 1, F.col("__source")).alias("s")))


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_M = [f"m_{i}" for i in range(P)]
_L = [f"l_{i}_{j}" for i, j in _PAIRS]
_SUMS = ["n", *(f"s_{i}" for i in range(P)), *(f"q_{i}_{j}" for i, j in _PAIRS)]


def _factor(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of scatter * CONSISTENCY + floors, and the log of its determinant, from columns c_i_j.
    A column of the factor is one layer of the plan, its diagonal another, so nothing is computed twice."""

    def rest(i: int, j: int) -> str:
        floor = f" + {FLOORS[DIMS[i]] ** 2}D" if i == j else ""
        return f"c_{i}_{j} * {CONSISTENCY}D{floor}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))

    for j in range(P):
        params = params.selectExpr("*", f"sqrt(greatest({rest(j, j)}, 1e-9D)) AS l_{j}_{j}")
        if j < P - 1:
            params = params.selectExpr("*", *(f"({rest(i, j)}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, P)))
    return params.selectExpr("*", " + ".join(f"ln(l_{i}_{i})" for i in range(P)) + " AS logdet")


def _with_distance(rows: DataFrame, values: str = "", params: str = "") -> DataFrame:
    """Adds ``__d2``: the squared Mahalanobis distance of the vector in the columns ``values`` + DIMS, by
    forward substitution with the columns ``params`` + m_i and l_i_j."""
    for i in range(P):
        known = "".join(f" - {params}l_{i}_{k} * __z_{k}" for k in range(i))
        rows = rows.selectExpr("*", f"({values}{DIMS[i]} / {SCALE}D - {params}m_{i}{known}) / {params}l_{i}_{i} AS __z_{i}")
    return rows.selectExpr("*", " + ".join(f"__z_{i} * __z_{i}" for i in range(P)) + " AS __d2").drop(*(f"__z_{i}" for i in range(P)))


def _moments() -> list[Column]:
    sums = ["sum(w) AS n", *(f"sum(w * {DIMS[i]}) AS s_{i}" for i in range(P)), *(f"sum(w * {DIMS[i]} * {DIMS[j]}) AS q_{i}_{j}" for i, j in _PAIRS)]
    return [F.expr(x) for x in sums]


def _estimate(sums: DataFrame, *keep: str) -> DataFrame:
    squares = [f"q_{i}_{j}" for i, j in _PAIRS]
    out = sums.selectExpr(*keep, "n", *(f"s_{i} / n / {SCALE}D AS m_{i}" for i in range(P)), *squares)
    return _factor(out.selectExpr(*keep, "n", *_M, *(f"q_{i}_{j} / n / {SCALE**2}D - m_{i} * m_{j} AS c_{i}_{j}" for i, j in _PAIRS)))


def _starts(cells: DataFrame) -> DataFrame:
    """(gid, start, parameters): 0: medians and quartile scales from value histograms; 1: mean and covariance."""
    step = SCALE // 32
    dims = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(F.col(c) / step).alias("bin")) for i, c in enumerate(DIMS))))
    hist = cells.select("gid", "w", dims.alias("x")).groupBy("gid", "x.dim", "x.bin").agg(F.sum("w").alias("w"))
    by = Window.partitionBy("gid", "dim")
    cum = hist.withColumn("below", F.sum("w").over(by.orderBy("bin"))).withColumn("all", F.sum("w").over(by))
    at = [F.min(F.when(F.col("below") >= q * F.col("all"), F.col("bin"))).alias(a) for a, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    quart = cum.groupBy("gid", "dim").agg(*at)
    first = quart.groupBy("gid").agg(
        F.lit(0.0).alias("n"),
        *(F.max(F.when(F.col("dim") == i, (F.col("q2") + 0.5) / 32)).alias(f"m_{i}") for i in range(P)),
        *((F.max(F.when(F.col("dim") == i, ((F.col("q3") - F.col("q1")) / 32 / 1.349) ** 2)) if i == j else F.max(F.lit(0.0))).alias(f"c_{i}_{j}") for i, j in _PAIRS),
    )
    plain = _estimate(cells.groupBy("gid").agg(*_moments()), "gid")
    return _factor(first).withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1)))


def mcd_estimates(cells: DataFrame, share: float = 0.75, steps: int = MAX_STEPS) -> DataFrame:
    """Weighted vectors (gid, w, DIMS; landed) to one row a group: size ``total``, location m_i, factor l_i_j. A group and start
    leaves the steps when one brings no smaller determinant; one that still falls after ``steps`` is taken as it is."""
    cols = [*_M, *_L, "logdet"]
    params = land(_starts(cells).select("gid", "start", *_M, *_L).withColumn("logdet", F.lit(float("inf"))), "mcd")
    by, settled = "PARTITION BY gid, start", []
    for _ in range(steps):
        rows = _with_distance(cells.join(small_side(params.select("gid", "start", *_M, *_L)), "gid"))
        binned = rows.withColumn("bin", F.expr("floor(log2(__d2 + 1e-3D) * 16)")).groupBy("gid", "start", "bin").agg(*_moments())
        cum = binned.selectExpr("gid", "start", "bin", f"sum(n) OVER ({by}) AS total", *(f"sum({c}) OVER ({by} ORDER BY bin) AS {c}" for c in _SUMS))
        first = cum.filter(f"n >= {share}D * total").selectExpr("*", f"row_number() OVER ({by} ORDER BY bin) AS __rank").filter("__rank = 1")
        before = params.select("gid", "start", *(F.col(c).alias(f"__{c}") for c in cols))
        now = _estimate(first, "gid", "start", "total").join(small_side(before), ["gid", "start"])
        now = land(now.selectExpr("gid", "start", "total", *cols, *(f"__{c}" for c in cols), f"logdet < __logdet - {TOLERANCE}D AS falls"), "mcd")
        settled.append(now.filter("not falls").selectExpr("gid", "start", "total", *(f"__{c} AS {c}" for c in cols)))
        params = now.filter("falls").select("gid", "start", "total", *cols)
        if params.isEmpty():
            break
    else:
        settled.append(params)
    found = reduce(DataFrame.union, settled)
    best = found.selectExpr("gid", "total", *_M, *_L, "row_number() OVER (PARTITION BY gid ORDER BY logdet, start) AS __rank")
    return best.filter("__rank = 1").drop("__rank")


def outlier_limits(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", min_group: int = 100) -> DataFrame:
    """One row per language and source with the estimate that judges it: its own if at least
    ``min_group`` documents passed the base rules, else its language's, else that of all."""
    passed = stats.filter("not base_failed").select(F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), *(v.alias(k) for k, v in statistic_vector().items()))
    cells = land(passed.groupBy("__lang", "__source", *DIMS).agg(F.count(F.lit(1)).cast("double").alias("w")), "quality-cells")
    levels = cells.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    keyed = land(levels.select(_group_key(F.col("__level")).alias("gid"), *DIMS, "w").groupBy("gid", *DIMS).agg(F.sum("w").alias("w")), "quality-groups")
    found = land(mcd_estimates(keyed), "quality-estimates")
    groups = cells.select("__lang", "__source").distinct()
    asked = groups.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("gid", _group_key(F.col("__level")))
    enough = asked.join(small_side(found), "gid").filter((F.col("total") >= min_group) | (F.col("__level") == LEVELS - 1))
    first = enough.groupBy("__lang", "__source").agg(F.min(F.struct("__level", *(c for c in found.columns if c != "gid"))).alias("p"))
    return land(first.selectExpr("__lang", "__source", *(f"p.{c} AS __{c}" for c in [*_M, *_L])), "quality-limits")


def judge(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``kept`` for rows that have their base statistics (a landed frame: it is read twice): false if the
    base rules failed, else whether the squared robust distance is at most ``cutoff``."""
    limits = outlier_limits(stats, lang_col, source_col)
    own = stats.select("*", *(v.alias(f"__x_{k}") for k, v in statistic_vector().items()))
    same = F.col(lang_col).eqNullSafe(F.col("__lang")) & F.col(source_col).eqNullSafe(F.col("__source"))
    judged = _with_distance(own.join(small_side(limits), same, "left"), "__x_", "__")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("__d2") <= cutoff, F.lit(True))).select(*stats.columns, "kept")


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with the columns of ``docs`` as they were.

    Null text fails the base rules. Null language or source is a group of its own. Repeated rows count as
    often as they stand. Empty table: no rows.
    """
    packed = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.struct("*").alias("__row"))
    return judge(land(base_statistics(packed).drop("text"), "quality-stats"), cutoff=cutoff).filter("kept").select("__row.*")
