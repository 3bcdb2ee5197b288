"""Token ids in binary shards: documents compressed one by one with a shared zstandard dictionary.

Shard layout (all numbers little-endian):

    magic "MLTOK01\\n", SHA-256 of the dictionary (32 bytes)
    one zstandard frame a document: its ids as unsigned 32-bit integers
    index, a row a document: frame offset (u64), frame length (u32), number of ids (u32), id JSON offset (u64)
    id JSON lines
    footer: offset of the index (u64), documents (u64), ids (u64), magic

``dictionary.zdict`` beside the shards holds the dictionary. A short document costs a reader the footer
(once), one index row and one frame.

Documents are range-partitioned by id, so that shards follow each other in ascending id order, a hot
id included (the content's hash is the second key); a shard is written by one task as it goes through
its sorted rows. File names hold the task attempt, and only the files of the written manifest count,
so attempts of lost executors leave no trace in the result.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import land, packed_text, shared_files, shared_folder, text_chunks
from marketlens.llm.kernels import LOWER, distinct_ranges

MAGIC = b"MLTOK01\n"
_ROW = np.dtype([("offset", "<u8"), ("length", "<u4"), ("n", "<u4"), ("id", "<u8")])
_FOOTER = "<QQQ8s"
#: Bounds of what trains the dictionary (never of what is written): documents with the smallest hashes, and the bytes of their ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 8 << 20, 64 << 10
#: Distinct segments whose ids a worker remembers.
REMEMBERED = 1_000_000


def _classes() -> np.ndarray:
    """0 ASCII white space, 1 ASCII letter, 2 other printable ASCII but ' and <, 3 all else."""
    c = np.full(256, 3, np.uint8)
    c[0x21:0x7F] = 2
    c[[0x27, 0x3C]] = 3
    c[0x41:0x5B] = c[0x61:0x7B] = 1
    c[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0
    return c


_CLASS = _classes()


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut packed rows to segments that are encoded on their own: (bytes, starts, ends, rows, is a run of letters).

    A white-space separated piece of ASCII (no ' or <) and Latin-1 letters is cut to its runs of letters and of other
    characters, A-Z lower-cased; any other piece is one segment as it stands.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.empty(0, np.int64)
    after = data[lead + 1] if len(lead) else data[:0]
    lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]  # U+00C0 to U+00FF but the signs
    kind[lead] = kind[lead + 1] = 1
    text = kind > 0
    new = np.empty(len(data) + 1, bool)  # byte i begins a piece, or no piece goes on to it
    new[0] = new[-1] = True
    np.logical_not(text[1:] & text[:-1], out=new[1:-1])
    new[offsets] = True
    first = np.flatnonzero(new[:-1] & text)
    if not len(first):
        none = np.empty(0, np.int64)
        return data, none, none, none, np.empty(0, bool)
    odd = np.flatnonzero(np.add.reduceat(kind == 3, first, dtype=np.int64))  # a reduceat slice's white space is not odd
    piece = np.cumsum(new[:-1] & text) - 1
    plain = np.ones(len(first), bool)
    plain[odd] = False
    inside = plain[np.maximum(piece, 0)]
    cut = new.copy()
    cut[1:-1] |= (kind[1:] != kind[:-1]) & inside[1:]
    starts = np.flatnonzero(cut[:-1] & text)
    ends = np.flatnonzero(cut[1:] & text) + 1
    body = np.where(inside, LOWER[data], data)
    return body, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, (kind[starts] == 1) & inside[starts]


class Encoder:
    """Ids of texts by a tokenizers file, as little-endian u32 bytes.

    ``by_pieces``: the file's normalizer lower-cases, and its pre-tokenizer drops white space, joins nothing across it,
    and cuts between runs of letters and of other characters (an apostrophe aside). Then the ids of a text are those
    of its ``segments``. The distinct ones of a batch are looked up among those a worker remembers; runs of letters
    that are new are encoded many at a time, as each ends with a token that ends a word. Other files: text by text.
    """

    def __init__(self, path: str, by_pieces: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_pieces = Tokenizer.from_file(path), by_pieces
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)  # of each slot, in ids
        self.ids = np.empty(0, "<u4")

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of runs of letters, encoded as one text and cut after the tokens that end a word."""
        (found,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return np.split(ids, ends[:-1]) if len(ends) == len(words) else self._whole(words)

    def _learn(self, words: list[bytes], letters: bool) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            found = self._letters(some) if letters else self._whole(some)
            self.slots.update(zip(some, range(len(self.slots), len(self.slots) + len(some)), strict=True))
            count = np.fromiter(map(len, found), np.int64, len(found))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, *found])

    def encode(self, col: pa.Array) -> list[bytes]:
        if not self.by_pieces:
            texts = [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
            return [x.tobytes() for x in self._whole(texts)]
        data, offsets = packed_text(col)
        body, starts, ends, rows, letters = segments(data, offsets)
        at, which = distinct_ranges(body, starts, ends)
        raw = body.tobytes()
        words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        new = [i for i, w in enumerate(words) if w not in self.slots]
        if len(self.slots) + len(new) > REMEMBERED and self.slots:
            self._forget()
            new = list(range(len(words)))
        runs = letters[at]
        self._learn([words[i] for i in new if runs[i]], True)
        self._learn([words[i] for i in new if not runs[i]], False)
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))[which]
        n = self.count[slots]
        upto = np.cumsum(n)
        ids = self.ids[np.arange(n.sum()) + np.repeat(self.first[slots] - upto + n, n)].tobytes()
        per_row = np.bincount(rows, weights=n, minlength=len(col)).astype(np.int64)
        stop = np.cumsum(per_row) * 4
        return [ids[a:b] for a, b in zip((stop - per_row * 4).tolist(), stop.tolist(), strict=True)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_pieces: bool) -> Encoder:
    if (path, by_pieces) not in _encoders:
        _encoders.clear()
        _encoders[path, by_pieces] = Encoder(path, by_pieces)
    return _encoders[path, by_pieces]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, text_col: str, by_pieces: bool) -> bytes:
    """A dictionary from whole serialised id arrays of a bounded sample, in the order of hashes, trained in a task; too little to
    train on: an empty one. Only the dictionary comes to the driver."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, samples, size = encoder(tokenizer, by_pieces), [], 0
        end = np.array([end_id], "<u4").tobytes()
        for part in text_chunks(batches, "text"):
            ids = [x + end for x in enc.encode(part.column("text"))] if size < SAMPLE_BYTES else []
            samples += ids
            size += sum(map(len, ids))
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["d"])

    # the limit is on hashes alone; their texts are then one row each, so neither texts nor copies pile up
    hashed = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = hashed.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).coalesce(1).sortWithinPartitions("h").select("text")
    rows = sample.mapInArrow(train, "d binary").collect()
    return max((r.d for r in rows), key=len, default=b"")


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_pieces: bool = True, level: int = 3, shards: int | None = None
) -> DataFrame:
    """Write all rows of ``docs`` as token shards to a new shared folder; returns the landed manifest: ``shard``
    (number, in ascending id order), ``path``, ``n_docs``, ``n_ids``, ``dictionary`` (path).

    A null text is empty: only the end id. Null ids come last. Equal ids are ordered by their text's hash;
    repeated rows are written as often as they stand. Very long texts are one frame. Empty table: no shards.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer, end_id, text_col, by_pieces)
    dict_path = f"{folder}/dictionary.zdict"
    fs, path = shared_files(dict_path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer, by_pieces)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.tok"
        fs, path = shared_files(uri)
        index, ids, at, n_ids, id_at = [], io.BytesIO(), len(MAGIC) + len(digest), 0, 0
        with fs.open_output_stream(path) as out:
            out.write(MAGIC + digest)
            for part in text_chunks(_chain(first, batches), "text"):
                for key, found in zip(part.column("id").to_pylist(), enc.encode(part.column("text")), strict=True):
                    frame = zip_.compress(found + end)
                    out.write(frame)
                    n = len(found) // 4 + 1
                    index.append((at, len(frame), n, id_at))
                    at, n_ids = at + len(frame), n_ids + n
                    id_at += ids.write(json.dumps(key, default=str).encode() + b"\n")
            rows = np.array(index, _ROW)
            rows["id"] += at + rows.nbytes
            out.write(rows.tobytes())
            out.write(ids.getvalue())
            out.write(struct.pack(_FOOTER, at, len(rows), n_ids, MAGIC))
        cols = [pa.array([shard], pa.int64()), pa.array([uri]), pa.array([len(rows)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([dict_path])]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "path", "n_docs", "n_ids", "dictionary"])

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return land(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_ids long, dictionary string"), "manifest")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str, dictionary: str) -> None:
        fs, path = shared_files(uri)
        self.file, size = fs.open_input_file(path), fs.get_file_info(path).size
        head = self._range(0, len(MAGIC) + 32)
        index, n, self.n_ids, magic = struct.unpack(_FOOTER, self._range(size - struct.calcsize(_FOOTER), struct.calcsize(_FOOTER)))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        fs, path = shared_files(dictionary)
        with fs.open_input_stream(path) as f:
            known = f.read()
        if hashlib.sha256(known).digest() != head[len(MAGIC) :]:
            raise ValueError(f"{uri} was written with another dictionary than {dictionary}")
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
        self.rows = np.frombuffer(self._range(index, n * _ROW.itemsize), _ROW)
        self.end = size - struct.calcsize(_FOOTER)

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, i: int) -> bytes:
        """The serialised ids of document i of this shard."""
        return self.unzip.decompress(self._range(int(self.rows["offset"][i]), int(self.rows["length"][i])))

    def keys(self, a: int, b: int) -> list:
        """The ids (JSON values) of documents a to b - 1."""
        at = int(self.rows["id"][a])
        until = int(self.rows["id"][b]) if b < len(self.rows) else self.end
        return [json.loads(x) for x in self._range(at, until - at).splitlines()]


def read_tokens(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """All documents of the shards of a manifest: ``id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids`` (serialised)."""
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("before", F.coalesce(before, F.lit(0)))  # one row a shard
    kind = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}[id_type]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, start = Shard(row["path"], row["dictionary"]), row["before"]
                for a in range(0, len(shard.rows), 256):
                    b = min(a + 256, len(shard.rows))
                    n = shard.rows["n"][a:b].astype(np.int64)
                    starts = start + np.cumsum(n) - n
                    start += int(n.sum())
                    cols = [pa.array(shard.keys(a, b), kind), pa.array(starts), pa.array(n), pa.array([shard.document(i) for i in range(a, b)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(n, "shard").mapInArrow(read, f"id {id_type}, start long, n_tokens long, ids binary")
