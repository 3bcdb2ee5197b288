"""Two tokenizers' tokens of the same bytes, aligned by as-of merges.

1. Tasks take the texts in batches. Both tokenizers' tokens of a batch are frames of (document, start); ``merge_asof`` keyed
   by document gives each token the other side's token that covers its start. The union of both directions holds all
   overlaps; tokens that start together on both sides open groups, so groups are cut where both sides end.
2. A batch lands a row a document and a row a different id pair, with how often the batch links it. Pairs are counted over
   the corpus from the latter, and each B id's highest count is found.
3. Counts go back to the pairs of the batches, and cogrouping by batch gives each document the sums over its links. A group
   is a batch: at most ``BATCH_BYTES`` of text, or one document.

Nulls: a null or empty text, and one whose tokens on either side don't spell a space and the text, has no tokens, zeros and
an empty digest. Null ids stay. Repeated rows are documents of their own. An empty table gives no rows. Other columns are
left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.bytelevel import ByteLevel, byte_chars
from marketlens.llm.common import land, ship_package, text_chunks
from marketlens.llm.wordcut import Remembered, piece_text, words

#: Text of a batch, and pieces that a worker remembers: they bound its memory.
BATCH_BYTES, REMEMBERED = 2 << 20, 300_000


class Pair:
    """The two tokenizers, with the bytes of each token of a text, remembered by piece."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece

        self.a = ByteLevel(byte_level, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        chars = {c: b for b, c in byte_chars().items()}
        self.a_bytes = [b""] * self.a.tokenizer.get_vocab_size(True)
        for t, i in self.a.tokenizer.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(chars[c] for c in t)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.memory = Remembered(self._learn, REMEMBERED)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _learn(self, keys: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """B's ids of pieces that begin with a space, and whether they spell the piece."""
        b = [x or [self.space] for x in self.b.encode(list(keys), num_threads=1)]  # the model adds the space, but to an empty text
        count = np.fromiter(map(len, b), np.int64, len(b))
        spelled = [b"".join([self.b_bytes[i] for i in x]) == piece_text(k).encode() for x, k in zip(b, keys, strict=True)]
        return [(np.fromiter(chain.from_iterable(b), np.int64, int(count.sum())), count), (np.array(spelled, np.int64), np.ones(len(b), np.int64))]

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and documents of both sides' tokens of texts; a text that a side doesn't spell has none."""
        n = len(texts)
        whole = [" " + t if t else "" for t in texts]
        cut = [words(t) for t in whole]
        slots = self.memory.slots_of([k for c in cut for k in c])
        doc_of = np.repeat(np.arange(n), np.fromiter(map(len, cut), np.int64, n))
        found = [np.array(self.a.ids(t), np.int64) for t in whole]
        good = np.array([self.a_size[ids].sum() == len(t.encode()) for ids, t in zip(found, whole, strict=True)], bool)
        good[doc_of[self.memory.spread(slots, 1)[0] == 0]] = False
        kept = [ids if g else ids[:0] for ids, g in zip(found, good, strict=True)]
        slots, doc_of = slots[good[doc_of]], doc_of[good[doc_of]]
        b, n_b = self.memory.spread(slots, 0)
        return np.concatenate(kept), np.repeat(np.arange(n), np.fromiter(map(len, kept), np.int64, n)), b, np.repeat(doc_of, n_b)


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


def align(doc_a: np.ndarray, size_a: np.ndarray, doc_b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlaps of two sides' tokens, given by document (ascending) and length in bytes; both sides of a document have the same bytes.

    Returns ``(a, b, opens_a, opens_b)``: token numbers of each overlapping pair, and for each token of either side whether
    a token of the other starts with it.
    """
    frames = []
    for doc, size, name in ((doc_a, size_a, "a"), (doc_b, size_b, "b")):
        place = np.cumsum(size) - size  # over the batch: both sides of a document begin at the same place
        frames.append(pd.DataFrame({"at": place, "doc": doc, name: np.arange(len(doc))}))
    left, right = frames
    over_a = pd.merge_asof(left[["at", "doc"]], right, on="at", by="doc")["b"].to_numpy(np.int64)
    over_b = pd.merge_asof(right[["at", "doc"]], left, on="at", by="doc")["a"].to_numpy(np.int64)
    at_a, at_b = left["at"].to_numpy(), right["at"].to_numpy()
    opens_a, opens_b = at_b[over_a] == at_a, at_a[over_b] == at_b
    new = np.flatnonzero(~opens_b)  # tokens that start together are found from both sides
    return np.concatenate([np.arange(len(at_a)), over_b[new]]), np.concatenate([over_a, new]), opens_a, opens_b


def spelled_groups(a: np.ndarray, b: np.ndarray, opens_a: np.ndarray, opens_b: np.ndarray, doc_a: np.ndarray, n_docs: int, names: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document's groups."""
    if not len(a):
        return [b""] * n_docs
    group_a, group_b = np.cumsum(opens_a) - 1, np.cumsum(opens_b) - 1
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    out = np.empty(len(a) + len(b), object)
    end_a, end_b = np.append(opens_a[1:], True), np.append(opens_b[1:], True)
    out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = np.where(end_a, names[1][a], names[0][a])
    out[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = np.where(end_b, names[2][b], names[0][b])
    of_group = np.empty(len(in_a), np.int64)
    of_group[group_a] = doc_a
    stop = np.cumsum(np.bincount(of_group, weights=in_a + in_b, minlength=n_docs)).astype(np.int64)
    first = np.concatenate([[0], stop[:-1]])
    return [b"".join(out[x:y].tolist())[:-1] for x, y in zip(first.tolist(), stop.tolist(), strict=True)]


def _names(n: int) -> np.ndarray:
    """Each id as text before a comma, a bar and a semicolon."""
    return np.array([[b"%d%b" % (i, mark) for i in range(n)] for mark in (b",", b"|", b";")], object)


_spelled: dict[str, np.ndarray] = {}


def _aligned(part: pa.RecordBatch, both: Pair, batch: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows: one a document, one a different id pair."""
    n = part.num_rows
    a, doc_a, b, doc_b = both.tokens(part.column("text").to_pylist())
    size_a, size_b = both.a_size[a], both.b_size[b]
    link_a, link_b, opens_a, opens_b = align(doc_a, size_a, doc_b, size_b)
    if "names" not in _spelled:
        _spelled["names"] = _names(max(len(both.a_bytes), len(both.b_bytes)))
    groups = spelled_groups(a, b, opens_a, opens_b, doc_a, n, _spelled["names"])
    count = lambda x: np.bincount(x, minlength=n).astype(np.int64)
    which, pairs = pd.factorize(a[link_a] << 32 | b[link_b])
    link_doc, k = doc_a[link_a], len(pairs)
    same, held = pd.factorize(link_doc * k + which)
    order = np.argsort(held)
    held, often = held[order], np.bincount(same, minlength=len(held))[order]
    held_doc, held_pair = (held // k, (held % k).astype("<u4")) if k else (held, held.astype("<u4"))
    stop = np.cumsum(count(held_doc)) * 4
    first = np.concatenate([[0], stop[:-1]]) if n else stop
    raw_pair, raw_often = held_pair.tobytes(), often.astype("<u4").tobytes()
    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
    slices = list(zip(first.tolist(), stop.tolist(), strict=True))
    none = pa.nulls
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, batch)), part.column("id"), pa.array(count(doc_a)), pa.array(count(doc_b)), pa.array(count(doc_a[opens_a])), pa.array(count(link_doc)),
            pa.array(digests, pa.string()), pa.array([raw_pair[x:y] for x, y in slices], pa.binary()), pa.array([raw_often[x:y] for x, y in slices], pa.binary()),
            none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()),
        ],
        _COLUMNS,
    )
    blank = [none(k, part.column("id").type), *[none(k, pa.int64())] * 4, none(k, pa.string()), none(k, pa.binary()), none(k, pa.binary())]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, batch)), *blank, pa.array(np.arange(k)), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(np.bincount(which, minlength=k))], _COLUMNS)


_COLUMNS = ["batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often", "pair", "a", "b", "times"]


def _summed(documents: pa.Table, counted: pa.Table) -> pa.Table:
    """Sums over the links of each document of one batch."""
    place = counted.column("pair").to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = counted.column("total").to_numpy(), counted.column("best").to_numpy()
    sums, bests = [], []
    for pairs, often in zip(documents.column("pairs").to_pylist(), documents.column("often").to_pylist(), strict=True):
        p, o = np.frombuffer(pairs, "<u4"), np.frombuffer(often, "<u4").astype(np.int64)
        sums.append(int((total[p] * o).sum()))
        bests.append(int((best[p] * o).sum()))
    out = documents.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    return out.append_column("groups_sha256", documents.column("groups_sha256"))


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and the id pairs ``a, b, total, best``:
    the corpus-wide links of each pair, and whether that is the highest count of its B id (ties included)."""
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, batch = tokenizers(byte_level, pieces), TaskContext.get().partitionId() << 32
        for part in text_chunks(batches, "text", BATCH_BYTES):
            yield from _aligned(part, both, batch)
            batch += 1

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"batch long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, often binary, pair long, a long, b long, times long"
    landed = land(source.mapInArrow(rows, schema), "token-alignment")
    documents = landed.filter(F.col("pair").isNull()).select("batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often")
    links = landed.filter(F.col("pair").isNotNull()).select("batch", "pair", "a", "b", "times")
    totals = links.groupBy("a", "b").agg(F.sum("times").alias("total"))
    totals = land(totals, "token-pairs")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    totals = totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    counted = links.join(totals, ["a", "b"]).select(F.col("batch").alias("of"), "pair", "total", "best")
    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("batch").cogroup(counted.groupBy("of")).applyInArrow(_summed, out), totals
