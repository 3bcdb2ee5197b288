"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each row of it is a segment with the postings (word digest to sorted
positions) of some whole documents, stored as Parquet in the shared folder, so that neither building
nor searching it shuffles text or postings, and a word as frequent as can be only lengthens lists
inside segments. A phrase is found by intersecting the lists of its words, each adjusted by
the word's offset, from the rarest word of the segment on; a phrase with a word that the segment
lacks costs one lookup. The stated query set (the benchmark) is read by the tasks in blocks from the
shared folder, never through the driver, so it may be large as well.

Words are compared by 128-bit BLAKE2 digests of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import LONG_ROWS, land, packed_text, shared_files, ship_package, text_chunks
from marketlens.llm.kernels import word_digests

#: Text bytes of a segment (or one longer document), and items and text bytes of a block of the benchmark.
SEGMENT_BYTES = 2 << 20
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 1 << 20
#: Places of rarest words that a proximity search looks at together.
CANDIDATES = 1 << 20


class Segment:
    """Postings of some documents: ``terms`` sorted, ``begin[i]:begin[i + 1]`` the slice of term i in ``positions``."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, words: np.ndarray) -> None:
        self.terms, self.counts, self.positions, self.words = terms, counts, positions, words
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.doc_of = np.repeat(np.arange(len(words)), words)
        self._keys: np.ndarray | None = None

    @classmethod
    def of_text(cls, col: pa.Array) -> Segment:
        digests, word, rows = word_digests(*packed_text(col))
        by_digest = np.argsort(digests)
        rank = np.empty(len(digests), np.int64)
        rank[by_digest] = np.arange(len(digests))
        term = rank[word]
        return cls(digests[by_digest], np.bincount(term, minlength=len(digests)), np.argsort(term, kind="stable"), np.bincount(rows, minlength=len(col)))

    def lookup(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of words, and their counts (0: not in this segment)."""
        if not len(self.terms):
            return np.zeros(digests.shape, np.int64), np.zeros(digests.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, digests), len(self.terms) - 1)
        return at, np.where(self.terms[at] == digests, self.counts[at], 0)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the given terms, and which of the terms each belongs to."""
        n = self.counts[term]
        which = np.repeat(np.arange(len(term)), n)
        return self.positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[term][which]], which

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each (term, position) is in the lists."""
        wanted, keys = term << 32 | position, self.keys()
        return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted

    def keys(self) -> np.ndarray:
        """All (term, position) as sorted numbers."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.positions
        return self._keys

    def phrases(self, known: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of the phrases in the rows of ``words`` (n, width; numbers of looked-up words): (phrase, first position)."""
        width = words.shape[1]
        term, counts = known[0][words], known[1][words]
        alive = np.flatnonzero((counts > 0).all(axis=1))
        term, rank = term[alive], np.argsort(counts[alive], axis=1, kind="stable")
        ranked = np.take_along_axis(term, rank, axis=1)
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        position, which = self.postings(ranked[:, 0])
        start = position - rank[which, 0]
        ok = (start >= 0) & (start + width <= len(self.doc_of))
        start, which = start[ok], which[ok]
        ok = self.doc_of[start] == self.doc_of[start + width - 1]
        start, which = start[ok], which[ok]
        for r in range(1, width):
            ok = self.has(ranked[which, r], start + rank[which, r])
            start, which = start[ok], which[ok]
        return alive[which], start

    def near(self, known: tuple[np.ndarray, np.ndarray], words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, position): where a word of a row of ``words`` (n, width; numbers of looked-up words) stands from which on all words
        of the row stand, in any order, within ``reach`` words of the same document. The rarest word of the segment only finds
        the candidates."""
        term, counts = known[0][words], known[1][words]
        alive = np.flatnonzero((counts > 0).all(axis=1))
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        term, counts = term[alive], counts[alive]
        ranked = np.take_along_axis(term, np.argsort(counts, axis=1, kind="stable"), axis=1)
        bounds = np.concatenate([[0], np.cumsum(self.words)])
        pieces = np.cumsum(counts.min(axis=1)) // CANDIDATES
        out = [self._near(ranked[rows], reach, bounds, rows) for rows in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(pieces)) + 1)]
        return alive[np.concatenate([x[:, 0] for x in out])], np.concatenate([x[:, 1] for x in out])

    def _near(self, ranked: np.ndarray, reach: int, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found, which = self.postings(ranked[:, 0])
        for r in range(1, ranked.shape[1]):
            doc = self.doc_of[found]
            ok = self.between(ranked[which, r], np.maximum(found - reach + 1, bounds[doc]), np.minimum(found + reach, bounds[doc + 1]) - 1)
            found, which = found[ok], which[ok]
        out = [np.empty((0, 2), np.int64)]
        for back in range(reach if len(found) else 0):
            start, row = found - back, which
            ok = start >= bounds[self.doc_of[found]]
            start, row, last = start[ok], row[ok], np.minimum(start + reach, bounds[self.doc_of[found] + 1])[ok] - 1
            ok = np.zeros(len(start), bool)
            for r in range(ranked.shape[1]):
                ok |= self.has(ranked[row, r], start)
            for r in range(ranked.shape[1]):
                start, row, last = start[ok], row[ok], last[ok]
                ok = self.between(ranked[row, r], start, last)
            out.append(np.stack([rows[row[ok]], start[ok]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands at one of the positions ``low`` to ``high``."""
        keys = self.keys()
        at = np.searchsorted(keys, term << 32 | low)
        return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= (term << 32 | high))


_INDEX_SCHEMA = "words binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs``: one row a segment, with the ids of its documents (rows of ``docs``, repeated
    ones too, null ids too). Positions are stored as differences inside a list."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType
    ship_package(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", SEGMENT_BYTES):
            s = Segment.of_text(part.column("text"))
            gaps = np.diff(s.positions, prepend=0).astype(np.int64)
            gaps[s.begin[:-1]] = s.positions[s.begin[:-1]]
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
            raw = [s.words.astype("<u4"), s.terms, s.counts.astype("<u4"), gaps.astype("<u4")]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["ids", "words", "terms", "counts", "positions"])

    schema = f"ids array<{id_type.simpleString()}>, {_INDEX_SCHEMA}"
    return land(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(segments, schema), "postings", LONG_ROWS)


def _stored(batch: pa.RecordBatch, i: int) -> Segment:
    words, terms, counts, gaps = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("words", "<u4"), ("terms", "S16"), ("counts", "<u4"), ("positions", "<u4")))
    counts = counts.astype(np.int64)
    run = np.cumsum(gaps.astype(np.int64))
    first = np.cumsum(counts) - counts
    before = np.concatenate([[0], run])[first]
    return Segment(terms, counts, run - np.repeat(before, counts), words.astype(np.int64))


class _Block:
    """Windows of some benchmark items: digests of their words, and for each width the word numbers (n, width) and the
    item of each window."""

    def __init__(self, ids: list[str], texts: pa.Array, width: int) -> None:
        self.ids = ids
        self.digests, word, rows = word_digests(*packed_text(texts))
        words = np.bincount(rows, minlength=len(ids))
        first = np.cumsum(words) - words
        self.windows = {}
        for w in range(1, width + 1):
            items = np.flatnonzero(words >= w if w == width else words == w)
            n = words[items] - w + 1
            which = np.repeat(items, n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
            if len(which):
                self.windows[w] = (word[start[:, None] + np.arange(w)], which)


_blocks: dict[tuple[str, int], list[_Block]] = {}


def _read_blocks(files: list[str], width: int) -> Iterator[_Block]:
    """The benchmark in blocks; a worker keeps it parsed only if it is a single block."""
    for key in ((f, width) for f in files):
        if key in _blocks:
            yield from _blocks[key]
            continue
        source, path = shared_files(key[0])
        with source.open_input_file(path) as f:
            parsed = []
            for batch in text_chunks(pq.ParquetFile(f).iter_batches(BLOCK_ITEMS), "text", BLOCK_BYTES):
                block = _Block(batch.column("item").to_pylist(), batch.column("text"), width)
                parsed = [*parsed, block] if len(files) == 1 and not parsed else [None]
                yield block
        if parsed and parsed[0] is not None and len(files) == 1:
            _blocks.clear()
            _blocks[key] = parsed


def _hits(segments: list[Segment], files: list[str], width: int) -> Iterator[tuple[list, list]]:
    """For each segment: its hit word spans and its matching items, one list a document."""
    spans = [[] for _ in segments]
    items = [set() for _ in segments]
    for block in _read_blocks(files, width):
        for k, s in enumerate(segments):
            known = s.lookup(block.digests)
            for w, (words, item) in block.windows.items():
                phrase, start = s.phrases(known, words)
                if len(start):
                    spans[k].append(np.stack([start, start + w], axis=1))
                    pairs = np.unique(np.stack([s.doc_of[start], item[phrase]], axis=1), axis=0)
                    items[k].update((d, block.ids[i]) for d, i in pairs.tolist())
    for k, s in enumerate(segments):
        found: list[list[str]] = [[] for _ in s.words]
        for d, i in items[k]:
            found[d].append(i)
        covered = np.zeros(len(s.doc_of) + 1, np.int64)
        for part in spans[k]:
            np.add.at(covered, part[:, 0], 1)
            np.add.at(covered, part[:, 1], -1)
        inside = np.cumsum(covered)[:-1] > 0
        first = np.cumsum(s.words) - s.words
        out: list[list[dict[str, int]]] = [[] for _ in s.words]
        # a run of hit words ends at a gap or at the end of its document
        at = np.flatnonzero(inside)
        if len(at):
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(s.doc_of[at]) > 0)) + 1
            for run in np.split(at, cut):
                d = int(s.doc_of[run[0]])
                out[d].append({"start": int(run[0] - first[d]), "end": int(run[-1] + 1 - first[d])})
        yield out, found


_MATCH = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _match_columns(segments: list[Segment], files: list[str], width: int) -> Iterator[list[pa.Array]]:
    for s, (spans, found) in zip(segments, _hits(segments, files, width), strict=True):
        yield [pa.array(s.words.astype(np.int64)), pa.array(spans, _MATCH), pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))]


def _benchmark_files(benchmark: DataFrame, item_col: str, text_col: str) -> list[str]:
    """The query set as Parquet files in the shared folder; a null item id reads as the empty string."""
    landed = land(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")), "benchmark")
    return sorted(landed.inputFiles())


def phrase_matches(index: DataFrame, benchmark: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Search a stored index for every window of ``width`` consecutive benchmark words (an item of fewer
    words, but some: all of them). One row per document row: ``id``, ``n_words``, ``spans`` (maximal runs
    of hit words, as word numbers), ``items`` (sorted ids of items with a window in the document).

    Words are runs of 0-9, A-Z (lower-cased), a-z and non-ASCII characters. Null or word-less texts
    match nothing. Repeated item ids count as one item. Empty tables: no rows or no matches.
    """
    files = _benchmark_files(benchmark, item_col, text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                segments = [_stored(part, i) for i in range(part.num_rows)]
                for i, cols in enumerate(_match_columns(segments, files, width)):
                    yield pa.RecordBatch.from_arrays([part.column("ids").slice(i, 1).flatten(), *cols], ["id", "n_words", "spans", "items"])

    id_type = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(search, f"id {id_type}, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def near_matches(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 5, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Search a stored index for the windows of ``phrase_matches`` by proximity: all words of a window, in any order, in a span that is
    at most ``slop`` words longer than the window, of one document. One row per document row: ``id``, ``n_words``, ``n_near``
    (words at which such a span of some item begins), ``items`` (sorted ids of the items). Every phrase match is one
    of these too; neither the other documents of a segment nor the partitioning decide."""
    files = _benchmark_files(benchmark, item_col, text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                segments = [_stored(part, i) for i in range(part.num_rows)]
                items: list[list[set[str]]] = [[set() for _ in s.words] for s in segments]
                places = [np.zeros(len(s.doc_of), bool) for s in segments]
                for block in _read_blocks(files, width):
                    for k, s in enumerate(segments):
                        known = s.lookup(block.digests)
                        for w, (rows, item) in block.windows.items():
                            row, start = s.near(known, rows, w + slop)
                            places[k][start] = True
                            for d, i in np.unique(np.stack([s.doc_of[start], item[row]], axis=1), axis=0).tolist():
                                items[k][d].add(block.ids[i])
                for k, s in enumerate(segments):
                    n_near = np.bincount(s.doc_of[places[k]], minlength=len(s.words)).astype(np.int64)
                    cols = [part.column("ids").slice(k, 1).flatten(), pa.array(s.words.astype(np.int64)), pa.array(n_near), pa.array([sorted(x) for x in items[k]], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_near", "items"])

    id_type = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(search, f"id {id_type}, n_words long, n_near long, items array<string>")


def proximity_matches(index: DataFrame, words: str, slop: int) -> DataFrame:
    """(id, position): each place of one of ``words`` from which on all of them stand, in any order, at most ``slop`` words
    further in the same document. No words, or a word that is nowhere: no rows."""
    digests, _, _ = word_digests(*packed_text(pa.array([words])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows if len(digests) else 0):
                s = _stored(batch, i)
                _, found = s.near(s.lookup(digests), np.arange(len(digests))[None, :], slop + 1)
                doc = s.doc_of[found]
                place = found - (np.cumsum(s.words) - s.words)[doc]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten().take(pa.array(doc)), pa.array(place)], ["id", "position"])

    id_type = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(search, f"id {id_type}, position long")


def hit_words(spans: str | Column = "spans") -> Column:
    """The number of words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, with the columns of ``docs``. The postings of a task's documents
    are searched where they are made, so that rows need no identity; the rest is as in
    ``phrase_matches``."""
    files = _benchmark_files(benchmark, "item_id", "text")  # lands a frame, so the package is sent
    names = docs.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(text_chunks([batch], text_col, SEGMENT_BYTES))
            for at in range(0, len(parts), 8):
                some = parts[at : at + 8]
                segments = [Segment.of_text(p.column(text_col)) for p in some]
                for part, cols in zip(some, _match_columns(segments, files, width), strict=True):
                    clean = pa.array([not x for x in cols[1].to_pylist()])
                    yield part.filter(clean)

    return docs.mapInArrow(search, docs.schema).select(*names)
