"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The patterns'
words are routed to the sources' quotas: pattern p can send its words to each of its sources, the
k-th repetition of them at cost k - 1, so the flow prefers fresh words and repeats evenly. A
pattern with flow f gets floor(f / words) copies of all its documents, and one more of a seeded
selection that fills the rest, in that of a few seeded orders in which documents come nearest to it.

Only totals per pattern reach the driver, a table as long as the mix itself. The selection is a
radix select: documents have a seeded hash of their content, and three aggregates find the hash up to
which documents fit, digit by digit, so a hot source is never sorted or gathered.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import BROADCAST_ROWS, land, small_side

MAX_COPIES = 3
#: Seeded orders that are tried for a selection.
ORDERS = 4
#: The digits of a 63-bit hash, from the most significant: shift and mask.
_DIGITS = ((51, (1 << 12) - 1), (39, (1 << 12) - 1), (0, (1 << 39) - 1))


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_by_weight(words: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = MAX_COPIES) -> dict[str | None, Fraction]:
    """Shares of all words: sources in code point order, null last, weigh ``weights`` in turn; a target
    stops at ``most`` times its source's words, and the excess is shared again among the others."""
    order = sorted((s for s in words if s is not None)) + [s for s in words if s is None]
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, fixed = sum(words.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        found = {s: left * weight[s] / share for s in free}
        over = [s for s in free if found[s] > most * words[s]]
        if not over:
            return {**found, **fixed}
        fixed |= {s: Fraction(most * words[s]) for s in over}


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def _min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a largest flow of least cost, by shortest augmenting paths."""
    out: list[list[_Arc]] = [[] for _ in range(n)]
    handles = []
    for a, b, room, cost in arcs:
        out[a].append(_Arc(b, room, cost, len(out[b])))
        out[b].append(_Arc(a, 0, -cost, len(out[a]) - 1))
        handles.append((a, len(out[a]) - 1, room))
    while True:
        dist: list[float] = [float("inf")] * n
        via: list[tuple[int, int] | None] = [None] * n
        dist[source], queue, queued = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k, arc in enumerate(out[a]):
                if arc.room and dist[a] + arc.cost < dist[arc.to]:
                    dist[arc.to], via[arc.to] = dist[a] + arc.cost, (a, k)
                    if arc.to not in queued:
                        queue.append(arc.to)
                        queued.add(arc.to)
        if via[sink] is None:
            return [room - out[a][k].room for a, k, room in handles]
        path, at = [], sink
        while at != source:
            a, k = via[at]
            path.append((a, k))
            at = a
        push = min(out[a][k].room for a, k in path)
        for a, k in path:
            arc = out[a][k]
            arc.room -= push
            out[arc.to][arc.back].room += push


def route(patterns: dict[tuple[str | None, ...], int], quotas: dict[str | None, int], most: int = MAX_COPIES) -> dict[tuple[str | None, ...], dict[str | None, int]]:
    """Words each pattern sends to each of its sources. Patterns that share a source, directly or through others,
    are one flow network; a source of its own is a network of one pattern."""
    flow: dict[tuple[str | None, ...], dict[str | None, int]] = {p: {} for p in patterns}
    up: dict[str | None, str | None] = {s: s for p in patterns for s in p}

    def top(s: str | None) -> str | None:
        while up[s] != s:
            up[s] = s = up[up[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            up[top(s)] = top(p[0])
    networks: dict[str | None, list[tuple[str | None, ...]]] = {}
    for p in patterns:
        if p:
            networks.setdefault(top(p[0]), []).append(p)
    for inside in networks.values():
        sources = sorted({s for p in inside for s in p}, key=lambda s: (s is None, s or ""))
        node = {s: 2 + len(inside) + i for i, s in enumerate(sources)}
        arcs, labels = [], []
        for i, p in enumerate(inside):
            arcs += [(0, 2 + i, patterns[p], copy) for copy in range(most)]
            labels += [None] * most
            for s in p:
                arcs.append((2 + i, node[s], most * patterns[p], 0))
                labels.append((p, s))
        arcs += [(node[s], 1, quotas.get(s, 0), 0) for s in sources]
        labels += [None] * len(sources)
        for label, f in zip(labels, _min_cost_flow(2 + len(inside) + len(sources), arcs, 0, 1), strict=True):
            if label and f:
                flow[label[0]][label[1]] = f
    return flow


def _key(members: Column) -> Column:
    """A pattern as a string: its distinct sources in order as JSON, null included."""
    return F.to_json(F.array_sort(F.array_distinct(members)))


def selection_hash(seed: int, *content: str | Column) -> Column:
    """A seeded hash of a document's content, 0 to 2^63 - 1. Documents that agree in it stay or go together."""
    return F.xxhash64(F.lit(seed), *content).bitwiseAND(F.lit((1 << 63) - 1))


def _order(h: str | Column, variant: str | Column) -> Column:
    """The place of a document in one of the seeded orders."""
    return F.xxhash64(h, variant).bitwiseAND(F.lit((1 << 63) - 1))


def _cuts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """For each pattern with ``rest`` words to fill, of ORDERS seeded orders the one that comes nearest:
    ``variant``; ``cut``, the place before which documents fit; ``extra``, the one further place (or -1) whose words come
    nearest to what is then missing."""
    variants = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    state = plan.select("pattern", "rest", F.lit(0).cast("long").alias("prefix"), variants.alias("variant"))
    placed = docs.select("pattern", "words", variants.alias("variant"), "h").withColumn("h", _order("h", "variant"))
    for shift, mask in _DIGITS:
        bits = mask.bit_length()
        inside = placed.join(small_side(state), ["pattern", "variant"]).filter(F.shiftright("h", shift + bits) == F.col("prefix"))
        digit = F.shiftright("h", shift).bitwiseAND(F.lit(mask))
        sums = inside.groupBy("pattern", "variant", "prefix", "rest", digit.alias("digit")).agg(F.sum("words").alias("words"))
        w = Window.partitionBy("pattern", "variant").orderBy("digit")
        cum = sums.withColumn("upto", F.sum("words").over(w)).filter("upto > rest")
        first = cum.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1")
        prefix = F.shiftleft("prefix", bits).bitwiseOR(F.col("digit"))
        state = land(first.select("pattern", "variant", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), prefix.alias("prefix")), "mix-cut")
    gap = F.abs(F.col("words") - F.col("rest"))
    beyond = placed.join(small_side(state), ["pattern", "variant"]).filter((F.col("h") >= F.col("prefix")) & (gap < F.col("rest")))
    best = beyond.groupBy("pattern", "variant").agg(F.min(F.struct(gap.alias("gap"), "h")).alias("best"))
    left = F.coalesce("best.gap", "rest")
    cut = F.struct(left.alias("left"), "variant", F.col("prefix").alias("cut"), F.coalesce("best.h", F.lit(-1)).alias("extra"))
    return state.join(best, ["pattern", "variant"], "left").groupBy("pattern").agg(F.min(cut).alias("c")).select("pattern", "c.variant", "c.cut", "c.extra")


def mix(docs: DataFrame, members: Column, words: Column, content: list[str | Column], weights: tuple[int, ...] = (5, 2, 1), seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__copies`` (long, 0 to 3), ``__words`` and ``__pattern`` added; and the mix: one row per source with
    ``source``, ``source_words``, ``target`` (double).

    ``members``: array of a document's sources (null is a source of its own); ``words``: its size;
    ``content``: the columns its selection depends on, together with ``seed`` alone, so reruns agree
    however rows are dealt out. Rows that agree in them get the same copies. A source's words are those of
    all documents that have it. Documents without words get no copies. Empty table: no rows.
    """
    spark = docs.sparkSession
    marked = docs.withColumn("__pattern", _key(members)).withColumn("__words", words)
    marked = marked.withColumn("__h", selection_hash(seed, *content))
    # equal documents are one weighted row from here on
    narrow = land(marked.groupBy(F.col("__pattern").alias("pattern"), F.col("__h").alias("h")).agg(F.sum("__words").alias("words")), "mix")
    names = {tuple(json.loads(r.pattern)): r for r in narrow.groupBy("pattern").agg(F.sum("words").alias("words")).collect()}
    patterns = {p: r.words for p, r in names.items()}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_by_weight(sizes, weights) if sum(sizes.values()) else {s: Fraction(0) for s in sizes}
    flow = route(patterns, {s: round(t) for s, t in targets.items()})
    rows = []
    for p, to in flow.items():
        n, f = patterns[p], sum(to.values())
        rows.append((names[p].pattern, f // n if n else 0, f % n if n else 0))
    plan = spark.createDataFrame(rows, "pattern string, copies long, rest long")
    cuts = _cuts(narrow, plan.filter("rest > 0"))
    chosen = land(plan.join(cuts, "pattern", "left").select(F.col("pattern").alias("__pattern"), "copies", "variant", "cut", "extra"), "mix-plan")
    place = _order("__h", "variant")
    more = F.coalesce((place < F.col("cut")) | (place == F.col("extra")), F.lit(False)).cast("long")
    out = marked.join(small_side(chosen, BROADCAST_ROWS), "__pattern").withColumn("__copies", F.col("copies") + more)
    report = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes], "source string, source_words long, target double")
    return out.select(*docs.columns, F.when(F.col("__words") > 0, F.col("__copies")).otherwise(0).alias("__copies"), "__words", "__pattern"), report


def mixed_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """The rows of the mix, each as often as it is repeated, with the columns of ``docs``."""
    out, _ = mix(docs, F.array(F.col(source_col)), word_count(F.col(text_col)), [id_col, source_col, text_col], seed=seed)
    return out.select(*docs.columns, F.explode(F.array_repeat(F.lit(True), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")
