"""MPEG audio columns: write, resynchronise, parse and verify streams held in binary columns.

`parse` walks a stream of unknown quality: an ID3v2 tag in front, ID3v1 behind, junk anywhere. A
position counts as a frame only if its header is valid and another valid header of the same kind, an
ID3v1 tag or the end of the data follows at the computed distance; else the search goes on one byte
later and the skipped bytes are counted. An ID3v1 tag is looked for where frames end, never inside of
one. The first frame's Xing, Info or VBRI table is read; checksums of protected frames (CRC-16,
polynomial 0x8005, over the last header half and the side information of Layer III or the bit
allocation of Layer I) are verified, and protected Layer II frames, whose checksum covers a part that
takes decoding, are counted as unchecked; the duration is exact, samples over rate; every frame's
offset is kept for seeking.

`encode` stores a payload losslessly as MPEG-1 Layer III, mono, 48 kHz: a TXXX frame of an ID3v2.3
tag holds the payload's length, an Info frame the frame and byte counts and the table of contents,
and protected frames of silence carry the payload behind their side information. At 48 kHz frames
have no padding; the last uses the lowest bitrate that holds the rest. `decode` takes the payload
back out of the frames.

Defined results: null content parses to null, and a null text is stored as an empty one; empty or
frameless content has no frames and duration 0; texts of any length and with any bytes, tag and header
marks included, come back whole; broken checksums are counted, never fatal; rows that repeat give equal
results, and nothing depends on order, so there are no ties; empty tables give empty results; extra
columns are carried by `parse_column`, where a column of the result's name is replaced by it.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bitrates in kbit/s by (MPEG-1?, layer) and index, sampling rates, and the Xing mark. Fixed values.
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

SIDE = 17  # bytes of side information, MPEG-1 mono
OVERHEAD = 4 + 2 + SIDE
TAG_KEY = b"payload-bytes"


@functools.lru_cache(maxsize=4096)
def header(word: bytes) -> tuple[int, int, int, int, int, bool, int] | None:
    """Of four header bytes: version bits, layer, rate in Hz, bytes, samples, protected, channels. None if invalid."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_at, hertz_at = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate_at in (0, 15) or hertz_at == 3 or word[3] & 3 == 2:
        return None
    kbit, hertz, pad = RATES[version == 3, layer][rate_at] * 1000, HERTZ[version][hertz_at], word[2] >> 1 & 1
    if layer == 1:
        size, samples = (12 * kbit // hertz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples // 8 * kbit // hertz + pad
    return version, layer, hertz, size, samples, not word[1] & 1, 1 if word[3] >> 6 == 3 else 2


@functools.lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def side_bytes(version: int, channels: int) -> int:
    if version == 3:
        return 17 if channels == 1 else 32
    return 9 if channels == 1 else 17


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def read_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """End of the ID3v2 tag at the start (0 if none) and its text frames; TXXX as TXXX:description."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    end, at, texts = min(len(data), 10 + _syncsafe(data[6:10]) + (10 if data[5] & 16 else 0)), 10, {}
    major = data[3]
    if data[5] & 64 and major in (3, 4) and len(data) >= 14:  # an extended header
        at += 4 + struct.unpack(">I", data[10:14])[0] if major == 3 else _syncsafe(data[10:14])
    while major in (3, 4) and at + 10 <= end and data[at : at + 1].isalnum():
        size = _syncsafe(data[at + 4 : at + 8]) if major == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            parts = body[1:].decode(coding, "replace").split("\0")
            if name == "TXXX":
                texts[f"TXXX:{parts[0]}"] = parts[1] if len(parts) > 1 else ""
            else:
                texts[name] = parts[0]
        at += 10 + size
    return end, texts


def _table(data: bytes, at: int, h) -> dict | None:
    """Xing, Info or VBRI of the frame at `at`: kind, frames, bytes and toc, as far as stored."""
    x = at + 4 + 2 * h[5] + side_bytes(h[0], h[6])
    for where in (x, at + 4 + side_bytes(h[0], h[6])):  # writers differ on whether the checksum shifts it
        kind = data[where : where + 4]
        if kind in (b"Xing", b"Info"):
            break
    else:
        v = at + 36
        if data[v : v + 4] != b"VBRI" or len(data) < v + 18:
            return None
        size, frames = struct.unpack(">II", data[v + 10 : v + 18])
        out = {"kind": "VBRI", "frames": frames, "bytes": size, "toc": None, "seek": None}
        if len(data) >= v + 26:
            n, scale, width, each = struct.unpack(">HHHH", data[v + 18 : v + 26])
            if n and each and 1 <= width <= 4 and len(data) >= v + 26 + n * width:
                steps = [int.from_bytes(data[v + 26 + i * width : v + 26 + (i + 1) * width], "big") * scale for i in range(n)]
                out["toc"] = data[v + 26 : v + 26 + n * width]
                out["seek"] = list(accumulate(steps, initial=0))[:-1]
        return out
    if len(data) < where + 8:
        return None
    flags, where = struct.unpack(">I", data[where + 4 : where + 8])[0], where + 8
    out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None, "seek": None}
    for bit, key in ((1, "frames"), (2, "bytes")):
        if flags & bit and len(data) >= where + 4:
            out[key], where = struct.unpack(">I", data[where : where + 4])[0], where + 4
    if flags & 4 and len(data) >= where + 100:
        out["toc"] = data[where : where + 100]
        if out["bytes"]:
            out["seek"] = [x * out["bytes"] // 256 for x in out["toc"]]
    return out


def _id3v1(data: bytes, at: int) -> bool:
    return at == len(data) - 128 and data[at : at + 3] == b"TAG"


def _covered(data: bytes, at: int, h) -> bytes | None:
    """What a protected frame's checksum covers, behind the header: Layer III's side information, Layer I's bit allocation."""
    if h[1] == 3:
        n = side_bytes(h[0], h[6])
    elif h[1] == 1:  # four bits a subband and channel; from the bound on, joint channels share them
        joint = data[at + 3] >> 6 == 1
        n = 16 if h[6] == 1 else (32 + 4 * ((data[at + 3] >> 4 & 3) + 1)) // 2 if joint else 32
    else:
        return None
    return data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]


def parse(data: bytes | None) -> dict | None:
    """All that is known of a stream; offsets are of every frame, the table's own included."""
    if data is None:
        return None
    start, tags = read_tag(data)
    stop = len(data)
    at, offsets, samples, lost, bad, checked, unchecked, hertz, table, kind = start, [], 0, 0, 0, 0, 0, None, None, None
    while at + 4 <= stop:
        h = header(data[at : at + 4])
        ok = h is not None and h[3] >= 4 and at + h[3] <= stop and (kind is None or h[:3] == kind)
        if ok and at + h[3] + 4 <= stop and not (offsets and offsets[-1][1] == at):
            after = header(data[at + h[3] : at + h[3] + 4])  # a lone match may be chance
            ok = after is not None and after[:3] == h[:3] or _id3v1(data, at + h[3])
        if not ok:
            if _id3v1(data, at):
                stop = at
                break
            found = data.find(b"\xff", at + 1, stop)
            found = stop if found < 0 else found
            if at < stop - 128 < found and _id3v1(data, stop - 128):
                found = stop - 128
            lost, at = lost + found - at, found
            continue
        end = at + h[3]
        if not offsets:
            kind, hertz, table = h[:3], h[2], _table(data, at, h) if h[1] == 3 else None
        if h[5]:
            covered = _covered(data, at, h)
            checked, unchecked = checked + (covered is not None), unchecked + (covered is None)
            bad += covered is not None and crc16(covered) != struct.unpack(">H", data[at + 4 : at + 6])[0]
        if table is None or offsets:
            samples += h[4]
        offsets.append((at, end))
        at = end
    lost += max(0, stop - at)
    return {
        "tags": tags, "tag_bytes": start, "table": table, "layer": kind[1] if kind else None, "hertz": hertz, "samples": samples,
        "duration_us": round(samples * 1_000_000 / hertz) if hertz else 0, "offsets": [a for a, _ in offsets], "lost_bytes": lost,
        "crc_checked": checked, "crc_bad": bad, "crc_unchecked": unchecked, "stream_end": offsets[-1][1] if offsets else start,
    }


def seek(info: dict, sample: int) -> int | None:
    """Byte offset of the frame that holds a sample, by the stored frame offsets."""
    each = {1: 384, 2: 1152, 3: 1152 if (info["hertz"] or 0) >= 32000 else 576}.get(info["layer"])
    frames = info["offsets"][1 if info["table"] else 0 :]
    return frames[sample // each] if each and 0 <= sample < len(frames) * each else None


@functools.lru_cache(maxsize=64)
def _front(index: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information for a bitrate index, and the frame's bytes."""
    word = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(SIDE)
    return word + struct.pack(">H", crc16(word[2:] + side)) + side, header(word)[3]


def _fit(n: int) -> int:
    """The lowest bitrate index whose frame holds n bytes of payload."""
    return next(i for i in range(1, 15) if _front(i)[1] - OVERHEAD >= n)


def encode(payload: bytes) -> bytes:
    """The payload as an MPEG stream; equal payloads give equal streams."""
    front, full = _front(14)
    each, frames = full - OVERHEAD, []
    for at in range(0, len(payload), each):
        part = payload[at : at + each]
        if len(part) < each:
            head, size = _front(_fit(len(part)))
            frames.append(head + part + bytes(size - OVERHEAD - len(part)))
        else:
            frames.append(front + part)
    head, size = _front(_fit(8 + 8 + 100))
    total = size + sum(map(len, frames))
    starts, at = [], size
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * starts[i * len(starts) // 100] // total) for i in range(100)) if starts else bytes(100)
    info = b"Info" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\0" + TAG_KEY + b"\0" + str(len(payload)).encode()
    body = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(body)
    tag = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body
    return tag + head + info + bytes(size - OVERHEAD - len(info)) + b"".join(frames)


def decode(data: bytes, info: dict | None = None) -> bytes:
    """The payload that `encode` stored, out of the frames that parsing found."""
    info = info or parse(data)
    frames = info["offsets"][1 if info["table"] else 0 :]
    ends = [*frames[1:], info["stream_end"]]
    n = int(info["tags"].get(f"TXXX:{TAG_KEY.decode()}", -1))
    body = b"".join(data[a + OVERHEAD : b] for a, b in zip(frames, ends))
    if not 0 <= n <= len(body) or info["crc_bad"]:
        raise ValueError("not a whole payload stream")
    return body[:n]


INFO = pa.struct([
    ("tag_bytes", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("table_kind", pa.string()), ("table_frames", pa.int64()),
    ("table_bytes", pa.int64()), ("seek_table", pa.list_(pa.int64())), ("layer", pa.int32()), ("hertz", pa.int32()), ("samples", pa.int64()),
    ("duration_us", pa.int64()), ("frame_offsets", pa.list_(pa.int64())), ("lost_bytes", pa.int64()), ("crc_checked", pa.int64()),
    ("crc_bad", pa.int64()), ("crc_unchecked", pa.int64()),
])
INFO_DDL = (
    "struct<tag_bytes: bigint, tags: map<string, string>, table_kind: string, table_frames: bigint, table_bytes: bigint,"
    " seek_table: array<bigint>, layer: int, hertz: int, samples: bigint, duration_us: bigint, frame_offsets: array<bigint>,"
    " lost_bytes: bigint, crc_checked: bigint, crc_bad: bigint, crc_unchecked: bigint>"
)


def _as_row(info: dict | None) -> dict | None:
    if info is None:
        return None
    out = {k: info[k] for k in ("tag_bytes", "layer", "hertz", "samples", "duration_us", "lost_bytes", "crc_checked", "crc_bad", "crc_unchecked")}
    t = info["table"] or {}
    out |= {"table_kind": t.get("kind"), "table_frames": t.get("frames"), "table_bytes": t.get("bytes"), "seek_table": t.get("seek")}
    return out | {"tags": list(info["tags"].items()), "frame_offsets": info["offsets"]}


def parse_column(df: DataFrame, content: str, out: str = "audio") -> DataFrame:
    """df with a struct column of what its binary column holds. Row by row in Arrow batches; no shuffle."""
    rest = [c for c in df.columns if c != out]
    schema = df.select(*[f"`{c}`" for c in rest]).schema.add(out, _ddl(INFO_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            infos = pa.array([_as_row(parse(x)) for x in b.column(content).to_pylist()], INFO)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], infos], [*rest, out])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def _ddl(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


ROUND = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def features(payload: bytes, info: dict) -> str:
    """Stream facts and the payload's statistics as unsigned 8-bit samples: exact duration, frames, mean, power, sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    power, crossings = int((x * x).sum()), int((np.diff(x >= 0) != 0).sum())
    frames = len(info["offsets"]) - bool(info["table"])
    return f"frames={frames};samples={info['samples']};us={info['duration_us']};seek_half={seek(info, info['samples'] // 2)};sum={int(x.sum())};power={power};cross={crossings}"


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's text through a stored stream and back: key, n_bytes, digests of the payload read back and of the stream, feature.

    The payload is the UTF-8 text (null: empty) with zero bytes up to a positive multiple of 64.
    """
    renamed = ROUND.set(0, pa.field(key, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                stored = encode(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
                info = parse(stored)
                back = decode(stored, info)
                out.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, info)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), renamed)] if out else [pa.array([], f.type) for f in renamed], schema=renamed)

    ddl = f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    from pyspark.sql import functions as F

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, ddl)
