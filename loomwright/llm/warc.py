"""WARC records in ZIP-packaged archives: writer, and a reader that range-reads without extraction.

An archive is a ZIP file whose members are all stored (method 0): `archive/data.warc.gz`, in which
every record is a gzip member of its own, and `indexes/index.cdxj`, which has one JSON line per
record with its offset and length inside the WARC member. The reader needs only a function that
gives a range of bytes. It finds the end record from the tail, follows the ZIP64 locator where
there is one, walks the central directory, works out where each stored member's data begin from its
local header, reads the index, and then each record by its own range; the archive is never unpacked,
nor held whole. Deflated, encrypted or damaged members raise an error that names them; a record's
checksum is verified by its gzip member, the index by the ZIP's.

Archives are kept in one of two ways. `write_archives` gives them as rows, to be written as a table that
any of Spark's storage can hold; `read_archives` reads such cells, each by ranges of its bytes.
`write_files` stores them as files in a folder that all executors reach, under names that are digests of
their content, so that a task which runs again writes the same files; `read_files` lists a folder, reads
only directories and indexes in one step, spreads the index lines, and range-reads each record from
storage in the next, so that a large archive is read by many tasks.

Of records with equal payloads of at least 100 bytes, that with the smallest key is a response and
others revisit it, without a payload of their own. Which those are comes from digests alone: one row
per digest meets the records again, and a digest that a third of all rows share only makes a skewed
join, which Spark splits.

Defined results: payloads of any length are stored whole; null payloads are empty; payloads under 100 bytes are always responses; rows that
repeat the responding key and payload are responses too; where all of a group's keys are null, all
are responses; an empty table gives no archives and no records; other columns aren't stored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import shuffle_partitions

#: Signatures of ZIP structures. Fixed values.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 100
#: An archive is closed at so many bytes of records, so that a task holds one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Bytes of a file that stay together when its records are dealt to tasks.
SPREAD = 4 << 20

Range = Callable[[int, int], bytes]


def gz(data: bytes) -> bytes:
    """data as one gzip member without name or time."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record of a resource; payload length and digest stand in every header, the payload only in responses."""
    name = lambda k: f"<urn:page:{'null' if k is None else k}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(key)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if kind == "revisit" else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one uncompressed record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("record is cut short")
    return headers, rest[:n]


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with ZIP64 fields where sizes or counts need them, or everywhere if asked."""
    out, central = io.BytesIO(), []
    for name, data in members:
        raw, at, crc, big = name.encode(), out.tell(), zlib.crc32(data), zip64 or len(data) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = 0xFFFFFFFF if big else len(data)
        out.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        far = zip64 or at >= 0xFFFFFFFF
        fields = ([len(data)] * 2 if big else []) + ([at] if far else [])
        extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
        central.append(
            struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if fields else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if far else at)
            + raw + extra
        )
    at, body = out.tell(), b"".join(central)
    out.write(body)
    n, big = len(members), zip64 or len(members) >= 0xFFFF or at >= 0xFFFFFFFF
    if big:
        end64 = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(body), at))
        out.write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
    short = lambda x, most: most if big else x
    out.write(struct.pack("<IHHHHIIH", END, 0, 0, short(n, 0xFFFF), short(n, 0xFFFF), short(len(body), 0xFFFFFFFF), short(at, 0xFFFFFFFF), 0))
    return out.getvalue()


def _unpack(form: str, data: bytes, at: int, what: str) -> tuple:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise ValueError(f"{what} is cut short")
    return struct.unpack_from(form, data, at)


def directory(read: Range, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: (place of the data, bytes, CRC-32), for stored members; raises for others."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, at, _ = _unpack("<IHHHHIIH", tail, end, "end record")
    if n == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        where = tail_at + end - 20
        mark, _, end64, _ = _unpack("<IIQI", read(where, 20) if where >= 0 else b"", 0, "ZIP64 locator")
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, n, length, at = _unpack("<IQHHIIQQQQ", read(end64, 56), 0, "ZIP64 end record")
        if mark != END64:
            raise ValueError("no ZIP64 end record")
    data, pos, out = read(at, length), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, crc, packed, plain, nn, ne, nc, _, _, _, local = _unpack("<IHHHHHHIIIHHHHHII", data, pos, "central directory")
        if mark != CENTRAL:
            raise ValueError("damaged central directory")
        name = data[pos + 46 : pos + 46 + nn].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = data[pos + 46 + nn : pos + 46 + nn + ne], 0
        while x + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                field = x + 4
                if plain == 0xFFFFFFFF:
                    (plain,), field = _unpack("<Q", extra, field, name), field + 8
                if packed == 0xFFFFFFFF:
                    (packed,), field = _unpack("<Q", extra, field, name), field + 8
                if local == 0xFFFFFFFF:
                    (local,) = _unpack("<Q", extra, field, name)
            x += 4 + k
        if method != 0 or flags & 1 or packed != plain:
            raise ValueError(f"member {name} isn't stored plainly")
        mark, _, _, _, _, _, _, _, _, ln, le = _unpack("<IHHHHHIIIHH", read(local, 30), 0, f"header of {name}")
        if mark != LOCAL:
            raise ValueError(f"no local header for {name}")
        out[name] = (local + 30 + ln + le, plain, crc)
        pos += 46 + nn + ne + nc
    return out


def index_lines(read: Range, size: int) -> Iterator[tuple[int, int, dict]]:
    """(place in the archive, bytes, index line) of each record, from the directory and the index alone."""
    members = directory(read, size)
    at, length, crc = members[INDEX_NAME]
    index = read(at, length)
    if zlib.crc32(index) != crc:
        raise ValueError("damaged index")
    base, whole, _ = members[WARC_NAME]
    for line in index.decode().splitlines():
        entry = json.loads(line[line.index("{") :])
        offset, length = int(entry["offset"]), int(entry["length"])
        if offset < 0 or length < 0 or offset + length > whole:
            raise ValueError("index points outside the archive")
        yield base + offset, length, entry


def read_archive(read: Range, size: int) -> Iterator[tuple[dict, dict[str, str], bytes]]:
    """(index line, headers, body) of each record, by range."""
    for at, length, entry in index_lines(read, size):
        yield entry, *parse_record(zlib.decompress(read(at, length), 31))


def build_archive(rows: list[tuple]) -> bytes:
    """Archive of (key, url, payload, refers) rows; refers set makes a revisit."""
    warc, lines = io.BytesIO(), []
    for key, url, payload, refers in rows:
        digest = hashlib.sha256(payload).hexdigest()
        member = gz(record("response" if refers is None else "revisit", key, url, payload, digest, refers))
        lines.append(f"page:{key} 20240101000000 " + json.dumps({"offset": str(warc.tell()), "length": str(len(member)), "digest": digest}))
        warc.write(member)
    return write_zip([(WARC_NAME, warc.getvalue()), (INDEX_NAME, "".join(f"{x}\n" for x in lines).encode())])


def first_copies(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages (_key, url, _payload) with refers: the smallest key of the same payload, null for responses.

    Digest groups are summed before the shuffle; only digests that occur on several keys come back.
    """
    digest = F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)
    long = F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= MIN_REVISIT
    keyed = pages.withColumn("_digest", F.when(long, digest))
    firsts = (
        keyed.where("_digest IS NOT NULL").groupBy(F.col("_digest").alias("_d")).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    ).where("_first < _last").select("_d", "_first")
    # a digest under the limit is null: keyed by row so that such rows don't meet in one task
    side = F.coalesce("_digest", F.concat(F.lit("-"), F.xxhash64(key).cast("string")))
    return keyed.withColumn("_side", side).join(firsts, F.col("_side") == F.col("_d"), "left").withColumn(
        "refers", F.when(F.col("_first").isNull() | (F.col(key) == F.col("_first")), F.lit(None)).otherwise(F.col("_first"))
    )


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives of all rows, as (name, content) rows: store them as a binary column or file by file."""
    p = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), F.col(payload).cast("string").alias("_payload"))
    rows = first_copies(p, "_key", "_payload").select("_key", "_url", "_payload", F.col("refers").cast("long").alias("_refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done():
            content = build_archive(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".zip"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.large_binary()).cast(pa.binary())], ["name", "content"])

        for b in batches:
            for k, u, t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                # a null key can't be told from the first copy's; it revisits like any other
                held.append((k, u, raw, r))
                size += len(raw) + 512
                if size >= ARCHIVE_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return rows.mapInArrow(run, "name string, content binary")


def _storage(name: str):
    """pyarrow's file system for a file that Spark names so, and its path there."""
    from pyarrow import fs

    if name.startswith("file:"):
        return fs.LocalFileSystem(), "/" + name[5:].lstrip("/")
    return fs.FileSystem.from_uri("s3" + name[3:] if name.startswith("s3a://") else name)


def opened(name: str) -> tuple[Range, int]:
    """A range-reading function for a file of storage that pyarrow knows, and the file's size."""
    where, path = _storage(name)
    file = where.open_input_file(path)
    return lambda at, n: file.read_at(n, at), file.size()


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Stores rows of archives as files; (path, length) of each, once they are there. A file appears whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _storage(folder.rstrip("/"))
        where.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                path, part = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                where.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([len(content.as_buffer())])], ["path", "length"])

    return archives.select("name", "content").mapInArrow(run, "path string, length long")


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
#: Records, and bytes of payloads, that a reader holds before it hands them on.
HELD_RECORDS, HELD_BYTES = 2_000, 16 << 20


def _number(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last not in ("", "null") else None


def _rows(records: Iterator[tuple[dict[str, str], bytes]], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Batches of records; a response's payload is digested again and must agree with its header."""
    schema = pa.schema(_FIELDS + [("payload", pa.binary())] * payloads)
    out, size = [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for h, body in records:
        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError("a payload differs from its digest")
        row = [_number(h["warc-record-id"]), int(h["x-payload-length"]), digest, kind, _number(h.get("warc-refers-to")), json.loads(f'"{h["warc-target-uri"]}"')]
        out.append(row + [body] * payloads)
        size += len(body) * payloads
        if len(out) >= HELD_RECORDS or size >= HELD_BYTES:
            yield done()
            out, size = [], 0
    if out:
        yield done()


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = False) -> DataFrame:
    """Records of archives held in a binary column.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload if asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                if cell.is_valid:
                    view = memoryview(cell.as_buffer())
                    records = read_archive(lambda at, n, v=view: bytes(v[at : at + n]), len(view))
                    yield from _rows(((h, body) for _, h, body in records), payloads)

    return archives.select(F.col(f"`{content}`")).mapInArrow(run, _DDL + ", payload binary" * payloads)


def read_files(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in a folder, as `read_archives` gives them. Files whose names begin with _ or . don't count."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # contents aren't read

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                read, size = opened(path)
                at = list(index_lines(read, size))
                for i in range(0, len(at), 10_000):
                    some = at[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64())], ["path", "at", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> Iterator[tuple[dict[str, str], bytes]]:
            path, read = None, None
            for b in batches:
                for p, at, n in zip(*(c.to_pylist() for c in b.columns)):
                    if p != path:
                        path, (read, _) = p, opened(p)
                    yield parse_record(zlib.decompress(read(at, n), 31))

        yield from _rows(one(), payloads)

    found = files.mapInArrow(lines, "path string, at long, length long")
    spread = found.repartition(shuffle_partitions(spark), "path", F.floor(F.col("at") / SPREAD)).sortWithinPartitions("path", "at")
    return spread.mapInArrow(records, _DDL + ", payload binary" * payloads)
