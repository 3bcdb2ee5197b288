"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if some ``length``-byte string that covers it starts in another place too. Which places do is
read off sorted suffixes; but only suffixes that can matter are sorted:

1. Anchors. In every window of ``length`` bytes the place whose ``GRAM`` bytes have the smallest hash (the
   first of equals) is an anchor. Equal windows have their anchors at the same offset, so two
   places start equal strings exactly if two anchors agree in d bytes to their left and length - d bytes
   from them on, d being that offset.
2. If they do, they agree in half the length on one side. Anchors neither of whose halves (by hash) is
   found twice are dropped, by a count with map-side sums: unique text ends here.
3. Anchors with equal surroundings (a 128-bit BLAKE2 digest of their bytes) are one context with a number, so copies
   collapse before anything is exchanged. A context found twice is settled. What is left to compare are different
   contexts with the same gram.
4. Tasks sort the suffixes of their contexts, and exchange these runs front-coded (length of the prefix
   shared with the one before, and the rest), cut into ranges of the gram's hash. A range is
   merged by a loser tree that carries common prefix lengths and goes on comparing where the known
   prefix ends. Grams of the merged order with more than one context are compared: which offsets d
   have an equal partner.
5. A gram with more than ``hot`` contexts does not go to one task: its windows are counted by 128-bit digests.

Positions are found by rolling hash, which can only add work; equality is told by bytes in 4, else by digest. Texts stand in the shared folder
with row numbers once and are never shuffled; what tasks need for their rows they read from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import land, packed_text, shared_files, shared_folder, small_side, text_chunks
from marketlens.llm.kernels import mix, powers

GRAM = 32
RUN_ENTRIES = 50_000
_POSITION_BITS = 24
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(_inverses)) - 1, _INVERSE, np.uint64))])
    return _inverses[:n]


class RollingHash:
    """64-bit polynomial hashes of any range of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[:-1], out=self.sums[1:])
        self.inverse = _inverse_powers(len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, hashes: RollingHash) -> np.ndarray:
    """Places in packed rows that are the anchor of some window of ``length`` bytes inside a row."""
    if len(data) < length:
        return np.empty(0, np.int64)
    width, grams = length - GRAM + 1, hashes.grams(GRAM)
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= length
    edge = np.zeros(len(data) + 1, np.int64)  # window starts whose window is inside a row
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    whole = np.cumsum(edge)[: len(data) - length + 1] > 0
    mark = np.zeros(len(data), bool)
    step, low = 1 << 20, np.uint64((1 << _POSITION_BITS) - 1)
    for at in range(0, len(whole), step):
        n = min(step, len(whole) - at)
        part = (grams[at : at + n + width - 1] & ~low) | np.arange(n + width - 1, dtype=np.uint64)
        best = (_window_minima(part, width)[whole[at : at + n]] & low).astype(np.int64)
        mark[best + at] = True
    return np.flatnonzero(mark)


def _context(around: bytes, right: int) -> bytes:
    """The digest that stands for the bytes around an anchor and for where it lies among them."""
    return hashlib.blake2b(around, digest_size=16, salt=right.to_bytes(16, "little")).digest()


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    half, reach = length // 2, length - GRAM
    names = ["left", "right", "gram", "context", "uid", "pos"]
    for part in text_chunks(batches, "text"):
        data, offsets = packed_text(part.column("text"))
        hashes = RollingHash(data)
        at = find_anchors(data, offsets, length, hashes)
        if not len(at):
            continue
        row = np.searchsorted(offsets, at, side="right") - 1
        start, end = offsets[row], offsets[row + 1]
        to_left, to_right = np.maximum(at - reach, start), np.minimum(at + length, end)
        # the half on the right has one byte more if the length is odd
        has_left, has_right = at - half >= start, at + length - half <= end
        left = hashes.of(np.maximum(at - half, 0), at)
        right = hashes.of(at, np.minimum(at + length - half, len(data))) ^ np.uint64(0x5851F42D4C957F2D)
        raw = data.tobytes()
        around = [_context(raw[a:b], b - c) for a, b, c in zip(to_left.tolist(), to_right.tolist(), at.tolist(), strict=True)]
        gram = mix(hashes.of(at, at + GRAM) ^ np.uint64(0x2545F4914F6CDD1D))
        uid = part.column("uid").to_numpy()[row]
        cols = [pa.array(left.view(np.int64), mask=~has_left), pa.array(right.view(np.int64), mask=~has_right)]
        cols += [pa.array(gram.view(np.int64)), pa.array(around, pa.binary()), pa.array(uid), pa.array(at - start)]
        yield pa.RecordBatch.from_arrays(cols, names)


# --- rows that tasks need beside a text -------------------------------------------------------


def _land_by_block(df: DataFrame, name: str) -> str:
    """Write rows with a ``uid`` in one folder for each partition that numbered them."""
    path = shared_folder(df.sparkSession, name)
    block = F.shiftright("uid", 33)
    df.withColumn("block", block).repartition("block").sortWithinPartitions("block", "uid").write.partitionBy("block").parquet(path)
    return path


class _Beside:
    """Rows written by ``_land_by_block`` for the uids of a batch."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.block, self.rows = path, columns, None, {}

    def of(self, uid: int) -> tuple[np.ndarray, ...]:
        if self.block != uid >> 33:
            self.block = uid >> 33
            fs, path = shared_files(f"{self.path}/block={self.block}")
            files = [f for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".parquet")]
            tables = [pq.read_table(fs.open_input_file(f.path), columns=["uid", *self.columns]) for f in files]
            self.rows = {}
            if tables:
                table = pa.concat_tables(tables)
                cols = [table.column(c).to_numpy() for c in ("uid", *self.columns)]
                order = np.argsort(cols[0], kind="stable")
                cols = [c[order] for c in cols]
                first = np.flatnonzero(np.diff(cols[0], prepend=-1))
                for a, b in zip(first, [*first[1:], len(cols[0])], strict=True):
                    self.rows[int(cols[0][a])] = tuple(c[a:b] for c in cols[1:])
        return self.rows.get(uid, ())


# --- front-coded runs and their merge ---------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


_HEAD = np.dtype([("shared", "<u2"), ("key", "<u2"), ("same_left", "<u2"), ("left", "<u2"), ("n", "u1"), ("context", "V16")])


def front_code(entries: list[tuple[bytes, bytes, int, bytes | int]]) -> bytes:
    """Sorted entries (key, reversed left side, number, context) as heads and the bytes that are not
    shared with the entry before. A context is 16 bytes, or a number that fits them."""
    heads, rest = np.zeros(len(entries), _HEAD), []
    key = left = b""
    for i, (k, l, n, c) in enumerate(entries):
        shared, same = common_prefix(key, k), common_prefix(left, l)
        heads[i] = (shared, len(k), same, len(l), n, c if isinstance(c, bytes) else c.to_bytes(16, "little"))
        rest += [k[shared:], l[same:]]
        key, left = k, l
    return len(entries).to_bytes(4, "little") + heads.tobytes() + b"".join(rest)


def front_decode(blob: bytes) -> Iterator[tuple[bytes, bytes, int, bytes, int]]:
    """(key, reversed left side, number, context, prefix shared with the key before)."""
    n = int.from_bytes(blob[:4], "little")
    at = 4 + n * _HEAD.itemsize
    key = left = b""
    for shared, size, same, left_size, count, context in np.frombuffer(blob[4:at], _HEAD).tolist():
        key = key[:shared] + blob[at : at + size - shared]
        at += size - shared
        left = left[:same] + blob[at : at + left_size - same]
        at += left_size - same
        yield key, left, count, context, shared


def merge_runs(runs: list[Iterator[tuple[bytes, bytes, int, bytes, int]]]) -> Iterator[tuple[bytes, bytes, int, bytes, int]]:
    """Merge sorted runs by a loser tree; yields entries with the prefix each key shares with the one before.

    Every candidate carries its common prefix with the last key put out. Of two candidates the one with the
    longer is smaller; only equal ones are compared, from there on. The loser keeps its common prefix
    with the winner, which is the next key put out by way of that node.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]
    shared = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        n = common_prefix(x, y, shared[a])
        a_first = n == len(x) or (n < len(y) and x[n] < y[n])
        winner, loser = (a, b) if a_first else (b, a)
        shared[loser] = n
        return winner, loser

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while k and heads[winner] is not None:
        key, left, n, context, _ = heads[winner]
        yield key, left, n, context, shared[winner]
        heads[winner] = following = next(runs[winner], None)
        shared[winner] = following[4] if following else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


# --- offsets at which contexts of one gram have an equal partner ------------------------------


def equal_offsets(group: list[tuple[bytes, bytes, int, bytes, int]], length: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each context of a group with one gram, in key order: the ranges (first, last) of offsets d at which
    d bytes to the left and length - d bytes on the right are those of another member as well.

    Key: 8 bytes of range order, then the right side. A context with a number over 1 has itself as partner.
    """
    reach = length - GRAM
    out: dict[bytes, list[tuple[int, int]]] = {}
    if len(group) <= 24:
        for i, (key, left, _, context, _) in enumerate(group):
            for j in range(i):
                a = common_prefix(key, group[j][0], 8) - 8
                b = common_prefix(left, group[j][1])
                if length - a <= min(b, reach):
                    span = (max(0, length - a), min(b, reach))
                    out.setdefault(context, []).append(span)
                    out.setdefault(group[j][3], []).append(span)
        return out
    n = len(group)
    right_len = np.array([len(g[0]) - 8 for g in group])
    left_len = np.array([len(g[1]) for g in group])
    right_same = np.array([0, *(group[i][4] - 8 for i in range(1, n))])
    by_left = sorted(range(n), key=lambda i: group[i][1])
    left_same = np.array([0, *(common_prefix(group[by_left[i - 1]][1], group[by_left[i]][1]) for i in range(1, n))])
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    stops = np.unique(np.concatenate([[0, reach + 1], length - right_same, length - right_len, left_same + 1, left_len + 1]))
    stops = stops[(stops >= 0) & (stops <= reach + 1)]
    contexts = [g[3] for g in group]
    for d, after in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        fit = np.flatnonzero((right_len >= length - d) & (left_len >= d))
        if len(fit) < 2:
            continue
        right_class = np.cumsum(right_same < length - d)
        left_class = np.cumsum(left_same < d)[place]
        _, which, sizes = np.unique(right_class[fit] * (n + 1) + left_class[fit], return_inverse=True, return_counts=True)
        for i in fit[sizes[which] > 1].tolist():
            spans = out.setdefault(contexts[i], [])
            if spans and spans[-1][1] == d - 1:
                spans[-1] = (spans[-1][0], after - 1)
            else:
                spans.append((d, after - 1))
    return out


def _merged_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, int, int]] = []
        group: list[tuple[bytes, bytes, int, bytes, int]] = []

        def settle() -> None:
            if len(group) > 1:
                gram = int.from_bytes(group[0][0][:8], "big")
                gram -= (gram >> 63) << 64
                rows.extend((gram, c, a, b) for c, spans in equal_offsets(group, length).items() for a, b in spans)

        for entry in merge_runs([front_decode(b) for b in blobs]):
            if group and entry[4] < 8:  # another gram
                settle()
                group = []
            group.append(entry)
            if len(rows) > 100_000:
                yield _span_batch(rows)
                rows = []
        settle()
        yield _span_batch(rows)

    now, blobs = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now and blobs:
                yield from solve(blobs)
                blobs = []
            now = key
            blobs.append(blob)
    if blobs:
        yield from solve(blobs)


def _span_batch(rows: list[tuple[int, bytes, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["gram", "context", "first", "last"])


# --- the operator -----------------------------------------------------------------------------


def _front_coded_runs(texts: DataFrame, wanted: DataFrame, length: int, ranges: int) -> DataFrame:
    """(range, run): sorted front-coded runs of the contexts ``wanted`` (uid, pos, gram, context, n)."""
    path, reach = _land_by_block(wanted, "dedup-wanted"), length - GRAM

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside, entries = _Beside(path, ["pos", "gram", "context", "n"]), []

        def close() -> pa.RecordBatch:
            entries.sort()
            cut: dict[int, list] = {}
            for e in entries:
                cut.setdefault(int.from_bytes(e[0][:8], "big") * ranges >> 64, []).append(e)
            entries.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(cut), pa.int64()), pa.array([front_code(x) for x in cut.values()], pa.binary())], ["range", "run"])

        for part in text_chunks(batches, "text"):
            for uid, text in zip(part.column("uid").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                found = beside.of(uid)
                for pos, gram, context, n in zip(*(c.tolist() for c in found), strict=True):
                    key = gram.to_bytes(8, "big", signed=True) + text[pos : pos + length]
                    entries.append((key, text[max(0, pos - reach) : pos][::-1], min(n, 2), context))
                if len(entries) >= RUN_ENTRIES:
                    yield close()
        if entries:
            yield close()

    return texts.mapInArrow(runs, "range long, run binary")


def _hot_windows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, context, first, last) for contexts of hot grams: every window around them counted as a hash."""
    path, reach = _land_by_block(wanted, "dedup-hot"), length - GRAM

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = _Beside(path, ["pos", "gram", "context", "n"])
        for part in text_chunks(batches, "text", 1 << 16):
            for uid, text in zip(part.column("uid").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                for pos, gram, context, _ in zip(*(c.tolist() for c in beside.of(uid)), strict=True):
                    near = np.frombuffer(text[max(0, pos - reach) : pos + length], np.uint8)
                    at = min(pos, reach)
                    start = np.arange(max(0, at - reach), min(at, len(near) - length) + 1)
                    if not len(start):
                        continue
                    around = near.tobytes()
                    found = [hashlib.blake2b(around[a : a + length], digest_size=16).digest() for a in start.tolist()]
                    cols = [pa.array(found, pa.binary()), pa.array(at - start), pa.array(np.full(len(start), gram)), pa.array([context] * len(start), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["window", "d", "gram", "context"])

    rows = land(texts.mapInArrow(windows, "window binary, d long, gram long, context binary"), "dedup-windows")
    twice = land(rows.groupBy("window", "d").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"), "dedup-window-counts")
    return rows.join(twice, ["window", "d"], "left_semi").select("gram", "context", F.col("d").alias("first"), F.col("d").alias("last"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``spans`` (removed runs as byte ranges), ``kept`` (binary).

    Every byte covered by a ``length``-byte string that also starts anywhere else (same row included,
    overlaps count) goes; strings do not cross rows, and are judged on the input. Null text: empty. Texts
    shorter than ``length`` stay whole. Repeated rows and null ids are rows like others; of a repeated row
    of at least ``length`` bytes nothing stays. Empty table: no rows. ``length`` is at least 2 * GRAM.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = land(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid")), "dedup-texts")
    long = texts.filter(F.octet_length("text") >= length).select("uid", "text")
    anchors = land(long.mapInArrow(lambda it: _anchor_rows(it, length), "left long, right long, gram long, context binary, uid long, pos long"), "dedup-anchors")
    halves = anchors.select(F.explode(F.array("left", "right")).alias("half"), "gram", "context", "uid", "pos").filter("half is not null")
    # landed, so that both sides of the join are plain exchanges and a hot half can be split
    twice = land(halves.groupBy("half").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("half"), "dedup-halves")
    alive = land(halves.join(small_side(twice), "half", "left_semi").select("gram", "context", "uid", "pos").distinct(), "dedup-alive")
    contexts = land(alive.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "pos")).alias("at")), "dedup-contexts")
    sizes = land(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "dedup-grams")
    open_ = land(contexts.join(small_side(sizes), "gram").select("at.uid", "at.pos", "gram", "context", "n", "members"), "dedup-open")
    runs = _front_coded_runs(long, open_.filter(F.col("members") <= hot).drop("members"), length, n)
    spans = runs.repartition(n, "range").sortWithinPartitions("range").mapInArrow(lambda it: _merged_spans(it, length), "gram long, context binary, first long, last long")
    full = contexts.filter("n > 1").select("gram", "context", F.lit(0).cast("long").alias("first"), F.lit(length - GRAM).cast("long").alias("last"))
    found = full.union(spans)
    if not open_.filter(F.col("members") > hot).isEmpty():
        found = found.union(_hot_windows(long, open_.filter(F.col("members") > hot).drop("members"), length))
    found = land(found, "dedup-spans")
    places = alive.join(small_side(found), ["gram", "context"]).select("uid", (F.col("pos") - F.col("last")).alias("first"), (F.col("pos") - F.col("first")).alias("last"))
    path = _land_by_block(places.distinct(), "dedup-places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = _Beside(path, ["first", "last"])
        for part in text_chunks(batches, "text"):
            sizes_, removed, ranges, kept = [], [], [], []
            for uid, text in zip(part.column("uid").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                size, gone = len(text), []
                # window starts, clipped to the text, then the bytes of their windows as maximal runs
                for a, b in sorted(zip(*(c.tolist() for c in beside.of(uid)), strict=True)):
                    a, b = max(a, 0), min(b, size - length)
                    if a <= b:
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], b + length)
                        else:
                            gone.append([a, b + length])
                stay, at = [], 0
                for a, b in gone:
                    stay.append(text[at:a])
                    at = b
                sizes_.append(size)
                removed.append(sum(b - a for a, b in gone))
                ranges.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join([*stay, text[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [part.column("id"), pa.array(sizes_, pa.int64()), pa.array(removed, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_bytes", "n_removed", "spans", "kept"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
