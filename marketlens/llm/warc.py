"""WARC records in ZIP packages: written as stored members, read back by ranges without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj`` (one JSON line a
record: its offset and length), both stored, with ZIP64 sizes and directory. The reader takes any such
package: it finds the end record, follows the ZIP64 locator if there is one, walks the central
directory, and reads only index ranges and record ranges.

Payloads that occur more than once (100 bytes or more) are kept once: the smallest page id has the
response, others are revisit records that refer to it. Which payloads repeat is a count of digests,
pre-aggregated by task; nothing else is shuffled while that list is small, else rows meet it by a
shuffled join in which adaptive execution splits a hot digest. Packages are rolled at a bounded size,
named by attempt, and only those in the written manifest count.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import land, shared_files, shared_folder, small_side, text_chunks

#: Compressed bytes after which a package is closed; bytes of records a reader fetches at once.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 1 << 20
MIN_REVISIT_BYTES = 100
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_NONE32, _NONE16 = 0xFFFFFFFF, 0xFFFF
_END, _END64, _LOCATOR = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
_CENTRAL, _LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


# --- ZIP ------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP64 package with all members stored."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        out += _LOCAL.pack(b"PK\x03\x04", 45, 0x800, 0, 0, 0x21, crc, _NONE32, _NONE32, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        central += _CENTRAL.pack(b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0x21, crc, _NONE32, _NONE32, len(raw), len(extra), 0, 0, 0, 0, _NONE32) + raw + extra
    start, n = len(out), len(members)
    out += central
    out += _END64.pack(b"PK\x06\x06", _END64.size - 12, 45, 45, 0, 0, n, n, len(central), start)
    out += _LOCATOR.pack(b"PK\x06\x07", 0, start + len(central), 1)
    out += _END.pack(b"PK\x05\x06", 0, 0, _NONE16, _NONE16, _NONE32, _NONE32, 0)
    return bytes(out)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipRanges:
    """The members of a ZIP file, plain or ZIP64, of which only ranges are read: ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        tail_at = max(0, size - _END.size - 0xFFFF)
        tail = read(tail_at, size - tail_at)
        at = len(tail) - _END.size
        # the end record is the last one whose comment reaches exactly to the end of the file
        while at >= 0 and not (tail[at : at + 4] == b"PK\x05\x06" and at + _END.size + _END.unpack_from(tail, at)[7] == len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at + 3)
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        _, _, _, _, n, length, start, _ = _END.unpack_from(tail, at)
        if _NONE16 == n or _NONE32 in (length, start):
            sig, _, where, _ = _LOCATOR.unpack(read(tail_at + at - _LOCATOR.size, _LOCATOR.size))
            if sig == b"PK\x06\x07":
                sig, *_, n, length, start = _END64.unpack(read(where, _END64.size))
                if sig != b"PK\x06\x06":
                    raise ValueError("damaged ZIP64 end record")
        self.members = {m.name: m for m in self._directory(start, length, n)}

    def _directory(self, start: int, length: int, n: int) -> Iterator[Member]:
        buffer, at, end = b"", start, start + length

        def take(size: int) -> bytes:
            nonlocal buffer, at
            while len(buffer) < size:
                more = self.read(at, min(RANGE_BYTES, end - at))
                if not more:
                    raise ValueError("damaged central directory")
                buffer, at = buffer + more, at + len(more)
            out, buffer = buffer[:size], buffer[size:]
            return out

        for _ in range(n):
            sig, _, _, flags, method, _, _, _, packed, size, name, extra, comment, _, _, _, header = _CENTRAL.unpack(take(_CENTRAL.size))
            if sig != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            label, rest = take(name).decode("utf-8" if flags & 0x800 else "cp437"), take(extra)
            take(comment)
            while len(rest) >= 4:
                kind, width = struct.unpack_from("<2H", rest)
                if kind == 1:  # 64-bit values of the fields that are full, in this order
                    wide = iter(struct.unpack(f"<{width // 8}Q", rest[4 : 4 + width // 8 * 8]))
                    size = next(wide) if size == _NONE32 else size
                    packed = next(wide) if packed == _NONE32 else packed
                    header = next(wide) if header == _NONE32 else header
                rest = rest[4 + width :]
            yield Member(label, method, size, header)

    def data_offset(self, member: Member) -> int:
        """Where a stored member's bytes begin in the file."""
        if member.method:
            raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
        sig, *_, name, extra = _LOCAL.unpack(self.read(member.header, _LOCAL.size))
        if sig != b"PK\x03\x04":
            raise ValueError(f"damaged local header of {member.name}")
        return member.header + _LOCAL.size + name + extra


# --- WARC -----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16])}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP header and no payload. Characters of the URL
    that can't stand in a header line are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(first, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's named fields; for a response also its payload, whose digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    page = fields.get("warc-page-id")
    out = {
        "record_id": fields["warc-record-id"],
        "page_id": None if page is None else int(page),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload_digest": digest,
        "refers_to_record": fields.get("warc-refers-to"),
        "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(out["payload"]).hexdigest() != digest:
            raise ValueError(f"payload of {out['record_id']} does not match its digest")
    return out


# --- Spark ----------------------------------------------------------------------------------


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` to packages in a new shared folder; the landed manifest: ``path``,
    ``records``, ``bytes``.

    Null html is an empty payload. Rows with the same payload and the same, smallest id are all
    responses. A row without an id is a revisit if a row with one has its payload, else a response.
    Empty table: no packages. Other columns are not looked at.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    # a digest with a single row has nothing to refer to
    large = base.filter(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest")
    firsts = land(large.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first"), "warc-first")
    rows = base.join(small_side(firsts), "digest", "left").select("page_id", "url", "html", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            lines = "".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in index)
            package = zip_stored([(_DATA, bytes(data)), (_INDEX, lines.encode())])
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            fs, path = shared_files(uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(package)
            row = [pa.array([uri]), pa.array([len(index)], pa.int64()), pa.array([len(package)], pa.int64())]
            data.clear()
            index.clear()
            return pa.RecordBatch.from_arrays(row, ["path", "records", "bytes"])

        for part in text_chunks(batches, "html"):
            for page, url, html, digest, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                revisit = first is not None and page != first
                raw = gzip.compress(warc_record(page, url, html.encode(), digest, first, revisit), 1, mtime=0)
                index.append((len(data), len(raw)))
                data.extend(raw)
                if len(data) >= PACKAGE_BYTES:
                    yield close()
        if index:
            yield close()

    return land(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def _open(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    fs, path = shared_files(uri)
    file = fs.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read, file.size()


def record_ranges(packages: DataFrame) -> DataFrame:
    """Packages (``path``) to ranges of about RANGE_BYTES: ``path``, ``offset``, ``length``, ``sizes`` of the records in it."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            read, size = _open(path)
            package = ZipRanges(read, size)
            base = package.data_offset(package.members[_DATA])
            member = package.members[_INDEX]
            at, end, rest = package.data_offset(member), member.size, b""
            end += at
            offset, sizes = base, []

            def row() -> pa.RecordBatch:
                cols = [pa.array([path]), pa.array([offset]), pa.array([sum(sizes)], pa.int64()), pa.array([sizes], pa.list_(pa.int64()))]  # noqa: B023
                return pa.RecordBatch.from_arrays(cols, ["path", "offset", "length", "sizes"])

            while at < end:
                more = read(at, min(RANGE_BYTES, end - at))
                at += len(more)
                *lines, rest = (rest + more).split(b"\n")
                for x in map(json.loads, lines):
                    if sizes and (base + x["offset"] != offset + sum(sizes) or sum(sizes) >= RANGE_BYTES):
                        yield row()
                        sizes = []
                    if not sizes:
                        offset = base + x["offset"]
                    sizes.append(x["length"])
            if sizes:
                yield row()

    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(n).mapInArrow(ranges, "path string, offset long, length long, sizes array<long>")


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of packages (``path``): ``record_id``, ``page_id``, ``url``, ``record_type``, ``payload_digest``,
    ``refers_to_record``, ``payload`` (binary; null for revisits). Ranges are dealt out, so a large package is read
    by many tasks."""
    schema = "record_id string, page_id long, url string, record_type string, payload_digest string, refers_to_record string, payload binary"
    arrow = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "page_id" else pa.string()) for n in [x.split()[0] for x in schema.split(", ")]])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str | None, Callable[[int, int], bytes] | None] = (None, None)
        for row in (r for b in batches for r in b.to_pylist()):
            if opened[0] != row["path"]:
                opened = (row["path"], _open(row["path"])[0])
            raw, at, found = opened[1](row["offset"], row["length"]), 0, []
            for n in row["sizes"]:
                found.append(parse_record(gzip.decompress(raw[at : at + n])))
                at += n
            yield pa.RecordBatch.from_pylist(found, arrow)

    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return record_ranges(packages).repartition(n).mapInArrow(records, schema)


def resolved_records(records: DataFrame) -> DataFrame:
    """Records without payloads, revisits resolved to the response that they refer to: ``page_id``, ``url``, ``record_type``,
    ``payload_bytes``, ``payload_digest`` and ``refers_to`` (the response's page id; null for responses, and with null
    ``payload_bytes`` for a revisit whose response is in none of the packages)."""
    narrow = land(records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "warc-records")
    targets = narrow.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record"))
    targets = targets.agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("__n"), F.max("payload_digest").alias("__d"))
    out = narrow.join(small_side(land(targets, "warc-targets")), "refers_to_record", "left")
    return out.select(
        "page_id", "url", "record_type", F.coalesce("payload_bytes", "__n").alias("payload_bytes"), F.coalesce("__d", "payload_digest").alias("payload_digest"), "refers_to"
    )
