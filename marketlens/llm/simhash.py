"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into a ring of ``SEGMENTS`` = 5 segments (13, 13, 13, 13 and 12 bits). If two
fingerprints differ in at most ``max_bits`` = t bits, then by the pigeonring principle some segment i
starts a chain of consecutive segments whose cumulative differences stay within the proportional
budgets floor(l * t / 5), l = 1..5; for t = 4: 0, 1, 2, 3, 4. The first two links of that chain are the
index: segment i equal, segment i + 1 within one bit. Each distinct fingerprint is dealt out under
the key (i, segment i, segment i + 1 with one bit masked), for every i and bit; pairs under a key
are pruned by the rest of the chain and by the full Hamming distance, vectorised.

Scale: equal fingerprints (exact and near copies) collapse to one node before any pair is made.
Keys with more than ``BLOCK`` fingerprints are cut into blocks, and the block pairs are dealt out
as tasks of bounded size; what leaves a task is a spanning forest of the links it has found, never all
pairs, which keeps every connection. Components are joined up by star steps (components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import land, ship_package, small_side
from marketlens.llm.components import connected_components
from marketlens.llm.places import in_files, place, rows_at

WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
BLOCK = 2_000
#: A-Z to a-z, and each of the six ASCII white-space bytes to itself.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text: see ``fingerprints``."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts, ends = np.concatenate([[0], ends[: len(words) - width] + 1]), ends[width - 1 :]
    digest, set_bits = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        hashes = b"".join([digest(body[a:b], 42) for a, b in spans])
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(starts)).tobytes(), "big")


def fingerprints(column: str | Column, shingle: int = 4) -> Column:
    """The 64-bit SimHash (as a signed long) of a text column: A-Z lower-cased, words are runs of
    characters other than ASCII white space, shingles of ``shingle`` words with repeats, joined by one
    space (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if set in over half of the
    hashes. Null or no words: 0."""

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        col = column.cast(pa.large_binary())
        values = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in col), np.uint64, len(col))
        return pa.array(values.view(np.int64))

    return simhash(column)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_within(diff: np.ndarray, max_bits: int) -> np.ndarray:
    """Pigeonring filter on XORed fingerprints: True if some segment starts a chain all of whose
    prefixes l stay within floor(l * max_bits / 5) differing bits. Implied by distance <= max_bits."""
    d = np.stack([_popcount((diff >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in zip(SHIFTS, WIDTHS, strict=True)]).astype(np.int64)
    ok = np.zeros(len(diff), bool)
    for i in range(SEGMENTS):
        run, alive = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
        for l in range(1, SEGMENTS + 1):
            run += d[(i + l - 1) % SEGMENTS]
            alive &= run <= l * max_bits // SEGMENTS
        ok |= alive
    return ok


def _masks() -> np.ndarray:
    """One AND-mask per key kind: bits of segment i and of segment i + 1 but one."""
    out = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        both = ((1 << WIDTHS[i]) - 1) << SHIFTS[i] | ((1 << WIDTHS[j]) - 1) << SHIFTS[j]
        out += [both & ~(1 << (SHIFTS[j] + b)) for b in range(WIDTHS[j])]
    return np.array(out, np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    kinds = np.arange(len(masks), dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for part in np.array_split(fp, len(fp) // 20_000 + 1):
            key = _mixed((part[:, None] & masks[None, :]) * np.uint64(0x9E3779B97F4A7C15) + kinds[None, :] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["key", "fp"])


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit bijection, so equal outputs only come from equal inputs up to the key arithmetic above;
    an accidental meeting of two keys only adds a pair that the Hamming check rejects."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Forest:
    """Union-find over the fingerprints that one task has linked; ``add`` keeps a link only if it joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.up[max(rx, ry)] = min(rx, ry)
                self.links.append((x, y))


def _link(a: np.ndarray, b: np.ndarray, max_bits: int, forest: _Forest) -> None:
    diff = a ^ b
    near = chain_within(diff, max_bits)
    near[near] = _popcount(diff[near]) <= max_bits
    if near.any():
        forest.add(a[near].view(np.int64), b[near].view(np.int64))


def _pairs_by_key(key: np.ndarray, fp: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """All pairs of rows with one key, by shifting the rows, which are sorted by key."""
    shift, alive = 1, np.arange(len(key) - 1)
    while len(alive):
        alive = alive[alive + shift < len(key)]
        alive = alive[key[alive] == key[alive + shift]]
        for part in np.array_split(alive, len(alive) // 500_000 + 1):
            _link(fp[part], fp[part + shift], max_bits, forest)
        shift += 1


def _linked(batches: Iterator[pa.RecordBatch], pairs: bool, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (a, b), or from rows (cell, fp) sorted by cell."""
    forest, rest = _Forest(), (np.empty(0, np.int64), np.empty(0, np.uint64))

    def flush() -> pa.RecordBatch:
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        forest.links.clear()
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        x, y = (batch.column(i).to_numpy() for i in (0, 1))
        if pairs:
            _link(x.view(np.uint64), y.view(np.uint64), max_bits, forest)
        elif len(x):  # the last cell of a batch may go on in the next
            key, fp = np.concatenate([rest[0], x]), np.concatenate([rest[1], y.view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1], side="left"))
            _pairs_by_key(key[:cut], fp[:cut], max_bits, forest)
            rest = (key[cut:], fp[cut:])
        if len(forest.up) > 500_000:  # bounded memory: these links are out, later ones may connect the same again
            yield flush()
            forest.up.clear()
    _pairs_by_key(*rest, max_bits, forest)
    yield flush()


def near_links(prints: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp: long) to links (a, b): a subset of the pairs at ``max_bits`` or fewer
    differing bits that connects everything the full set connects. ``max_bits`` is at most 4, as the
    index assumes budgets of 0 and 1 for the first two links of a chain.

    Most shared keys hold two fingerprints: the smallest and the largest of the key's aggregate are
    the pair. Only larger keys fetch their members.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be between 0 and 4")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a landed file of fingerprints is small; its 64-fold keys are not
    keyed = prints.select("fp").repartition(n).mapInArrow(_keys, "key long, fp long")
    shared = land(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-keys")
    two = shared.filter("n = 2").select("a", "b").mapInArrow(lambda it: _linked(it, True, max_bits), "a long, b long")
    members = keyed.join(small_side(shared.filter("n > 2").select("key", "n")), "key")
    # A row of block b meets those of block o in the cell (b, o): it is sent to the cells of its row and column.
    blocks = F.ceil(F.col("n") / block).cast("int")
    cells = (
        members.withColumn("b", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.xxhash64("key", F.greatest("b", "o"), F.least("b", "o")).alias("cell"), "fp")
    )
    more = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lambda it: _linked(it, False, max_bits), "a long, b long")
    return two.union(more).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (long), ``fingerprint`` (16 hex digits), ``component_id``: the
    smallest id reachable over links of at most ``max_bits`` differing bits, own id included.

    Rows whose texts are null or have no words have fingerprint zero and link like any other. Rows with
    a null id take part, and are never a smallest id; a component without any id has a null
    ``component_id``. Repeated rows stay. Empty table: no rows. Other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    prints = land(docs.select(F.col(id_col), fingerprints(F.col(text_col), shingle).alias("fp")), "simhash")
    return prints.join(component_ids(prints, id_col, max_bits), "fp").select(
        id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def component_ids(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(fp, component: its smallest fingerprint, component_id: its smallest id) for every distinct
    fingerprint of a landed frame."""
    nodes = land(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    comps = land(connected_components(near_links(nodes, max_bits)), "simhash-comps")
    joined = land(nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-members")
    # landed as well, so that the join has plain exchanges on either side and a large component can be split
    reps = land(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "simhash-reps")
    return joined.join(reps, "component").select("fp", "component", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that with the smallest id (null only if it has no
    other); of several with that id the one with the smallest fingerprint, then with the smallest hash of its columns (maps
    aside), then the first as it stands in the files. Same columns as ``docs``, whatever their names.

    Which row stays is settled on narrow rows told by their places; texts are read where they are and never shuffled.
    """
    ship_package(docs.sparkSession)
    docs = in_files(docs, "simhash-docs")
    file, at = place(docs)
    content = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    told = docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp"), F.xxhash64(*content).alias("tie"), file.alias("file"), at.alias("at"))
    prints = land(told, "simhash")
    comps = land(component_ids(prints.select("id", "fp"), "id", max_bits), "simhash-ids")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "tie", "file", "at")).alias("first")
    # rows that can be a component's first: of each fingerprint the least, before fingerprints meet their components
    least = prints.groupBy("fp").agg(first).join(comps, "fp").groupBy("component").agg(F.min("first").alias("first"))
    return rows_at(docs, least.select("first.file", "first.at"))
