"""Packing along a space-filling curve: documents of like words lie side by side in the sequences.

1. Tasks encode the texts and give each document a place: its token counts, damped by a logarithm, are hashed to
   ``BUCKETS`` numbers and projected by a seeded matrix of signs to ``DIMS`` dimensions; the unit vector's coordinates
   become 15-bit numbers, and their Hilbert index the key. Rows are landed with their ids (two bytes an id where the
   vocabulary allows).
2. Narrow rows (key, id, row number, tokens) are range-sorted, and a running sum over the ranges gives each document
   its place in the one stream of all tokens. Copies share a key and spread by id and row number.
3. Each document is cut where the sequences end: every ``length`` tokens, and the rest of the stream to powers of two,
   so that nothing is padded.

Nulls: a null text is empty, a null id sorts first and stays null. An empty text has the end id alone. Repeated rows are
documents of their own. An empty table has no pieces. Other columns are left out, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.bytelevel import ByteLevel
from marketlens.llm.common import land, ship_package, text_chunks
from marketlens.operators.ranking import rank_globally

BUCKETS, DIMS, BITS, SEED = 512, 4, 15, 17


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of rows of whole coordinates below 2^bits: each bit plane is reflected and turned as the planes above it say."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _signs() -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (BUCKETS, DIMS))


def places(ids: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Hilbert keys of documents from their token ids and each token's row."""
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)
    counts = np.log1p(np.bincount(rows * BUCKETS + bucket.astype(np.int64), minlength=n_rows * BUCKETS).reshape(n_rows, BUCKETS))
    flat = (counts @ _signs()) / np.maximum(np.sqrt((counts**2).sum(axis=1)), 1e-9)[:, None]
    # a sign projection of a unit vector is close to a standard normal number
    level = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(flat / math.sqrt(2)))
    return hilbert_index(np.minimum((level * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


_coders: dict[str, tuple[ByteLevel, np.dtype]] = {}


def _coder(path: str) -> tuple[ByteLevel, np.dtype]:
    if path not in _coders:
        coder = ByteLevel(path)
        _coders[path] = coder, np.dtype("<u2" if coder.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
    return _coders[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Landed rows ``uid, id, n, key, ids``: a document's ids with the end id, in bytes, and its place on the curve."""
    spark = docs.sparkSession
    ship_package(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = _coder(tokenizer)
        end = np.array([end_id], kind)
        for part in text_chunks(batches, "text"):
            found = [np.array(coder.ids(t or ""), kind) for t in part.column("text").to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            key = places(np.concatenate(found), np.repeat(np.arange(len(found)), n), len(found))
            packed = [np.append(ids, end).tobytes() for ids in found]
            columns = [part.column("id"), pa.array(n + 1), pa.array(key), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "key", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(encode, f"id {source.schema['id'].dataType.simpleString()}, n long, key long, ids binary")
    return land(rows.withColumn("uid", F.monotonically_increasing_id()), "curve-tokens")


def sequence_ends(total: int, length: int) -> list[int]:
    """Lengths of the sequences of the stream's rest, after the full ones: powers of two, largest first."""
    rest = total % length
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """``(from, tokens, sequence, offset)`` of the pieces of a document that holds tokens [start, start + n) of the stream."""
    out, at, full = [], start, total // length
    while at < start + n:
        sequence, first, size = at // length, at - at % length, length
        if sequence >= full:
            first = full * length
            for size in sequence_ends(total, length):
                if at < first + size:
                    break
                first, sequence = first + size, sequence + 1
        stop = min(start + n, first + size)
        out.append((at - start, stop - at, sequence, at - first))
        at = stop
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian u32) of sequences of ``length`` tokens.

    ``length`` is a power of two. Sequences but the last few are full, those are powers of two.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    tokens = encoded(docs, tokenizer, end_id, id_col, text_col)
    width = int(_width(tokens))
    narrow = tokens.select("key", "id", "uid", "n")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    placed = rank_globally(narrow, [("key", False), ("id", False), ("uid", False)], running_sum=("n", "upto"))
    starts = placed.select("uid", (F.col("upto") - F.col("n")).alias("at"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_chunks(iter([batch]), "ids", 4 << 20):
                rows, parts = [], []
                for r, (at, n, raw) in enumerate(zip(some.column("at").to_pylist(), some.column("n").to_pylist(), some.column("ids").to_pylist(), strict=True)):
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    for piece in cut(at, n, total, length):
                        rows.append(r)
                        parts.append((*piece, ids[piece[0] : piece[0] + piece[1]].tobytes()))
                start, size, sequence, offset, ids = zip(*parts, strict=True)
                of = pa.array(rows, pa.int64())
                columns = [some.column("id").take(of), pa.array(start, pa.int64()), pa.array(size, pa.int64()), some.column("n").take(of)]
                columns += [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = tokens.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return tokens.select("uid", "id", "n", "ids").join(starts, "uid").select("id", "at", "n", "ids").mapInArrow(pieces, schema)


def _width(tokens: DataFrame) -> int:
    """Bytes an id takes in landed rows (an empty table: any)."""
    one = tokens.select((F.length("ids") / F.col("n")).cast("int")).first()
    return one[0] if one else 2


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, documents``: whole sequences from their pieces (at most ``length`` tokens each)."""
    part = F.array_sort(F.collect_list(F.struct("offset", "length", "id", "ids")))
    made = pieces.groupBy("sequence_id").agg(part.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return made.select("sequence_id", total.alias("length"), joined.alias("ids"), F.transform("p", lambda x: x["id"]).alias("documents"))
