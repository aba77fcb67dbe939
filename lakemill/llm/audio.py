"""MPEG audio columns (operator 12): bytes kept in valid Layer III streams, and an index of any stream.

A written stream has an ID3 tag with the number of bytes, an information frame (Xing table and the encoder's extension
with its checksums) and frames of silence: side information of zeros, so all bytes behind it are ancillary and hold the
payload, one byte a unit. Players play silence of that length; the bytes come back as they were.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import staged, tidy

# Fixed values of the format: kbit/s by (version 1?, layer) and index, samples a second by version and index.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: Bytes of media that a batch has at most, one value apart.
SLICE = 8 << 20

_LEFT = np.arange(256, dtype=np.uint32) << 8
for _ in range(8):
    _LEFT = ((_LEFT << 1) ^ np.where(_LEFT & 0x8000, 0x8005, 0)) & 0xFFFF
_RIGHT = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _RIGHT = (_RIGHT >> 1) ^ np.where(_RIGHT & 1, 0xA001, 0)
_RIGHT_LIST = _RIGHT.tolist()


def crc_left(rows: np.ndarray) -> np.ndarray:
    """The frames' checksum (polynomial 8005, high bit first, from FFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ _LEFT[(crc >> 8) ^ rows[:, k]]
    return crc


def _right(data: bytes, crc: int = 0) -> int:
    for x in data:
        crc = (crc >> 8) ^ _RIGHT_LIST[(crc ^ x) & 255]
    return crc


@functools.lru_cache
def _past(width: int) -> tuple[list[int], list[int]]:
    """What ``width`` zero bytes make of a checksum's low and of its high byte."""
    step = [_right(bytes(width), 1 << bit) for bit in range(16)]
    return tuple([functools.reduce(operator.xor, (step[8 * k + b] for b in range(8) if x >> b & 1), 0) for x in range(256)] for k in (0, 1))


def crc_right(data: bytes) -> int:
    """The information frame's checksum (polynomial 8005, low bit first, from 0): rows of bytes side by side, then joined, as it is linear."""
    width = 1 << max(0, len(data).bit_length() // 2 - 2)
    rows = -(-len(data) // width)  # zeros ahead change nothing
    block = np.frombuffer(bytes(rows * width - len(data)) + data, np.uint8).reshape(rows, width)
    crc = np.zeros(rows, np.uint32)
    for column in block.T:
        crc = (crc >> 8) ^ _RIGHT[(crc ^ column) & 255]
    (low, high), total = _past(width), 0
    for x in crc.tolist():
        total = low[total & 255] ^ high[total >> 8] ^ x
    return total


@dataclass(frozen=True)
class Header:
    """The first four bytes of a frame."""

    version: int
    layer: int
    checked: bool
    bitrate: int
    rate: int
    mono: bool
    size: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 3 else 1152

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    """The header at ``at``, or None where no frame of a known length can begin."""
    four = data[at : at + 4]
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    if four not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[four] = _parsed(four)
    return _headers[four]


def _parsed(four: bytes) -> Header | None:
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbit, hertz = BITRATES[version == 3, layer][index], RATES[version][rate]
    per = 12 if layer == 1 else 72 if layer == 3 and version != 3 else 144
    size = per * kbit * 1000 // hertz + pad
    return Header(version, layer, not four[1] & 1, kbit, hertz, four[3] >> 6 == 3, size * 4 if layer == 1 else size)


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


@dataclass
class Index:
    """What a stream holds. Offsets are those of the audio frames' first bytes, the information frame left out."""

    kind: tuple | None = None
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    checked: int = 0
    failed: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        """Exact length: all frames' samples, without what the encoder says it added at both ends."""
        every = sum(h.samples for h in self.headers)
        return max(0, every - self.table.get("delay", 0) - self.table.get("padding", 0))

    @property
    def rate(self) -> int:
        return self.kind[2] if self.kind else 0


def _tag_text(body: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(code, "replace").rstrip("\0")


def _read_tags(data: bytes, found: dict[str, str]) -> tuple[int, int]:
    """Reads ID3 and APE tags at both ends; where the audio begins and ends."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
        body = data[at + 10 : at + 10 + size]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        pos = 0
        if flags & 0x40 and len(body) >= 4:
            pos = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4])
        while major >= 3 and pos + 10 <= len(body) and body[pos : pos + 1].isalnum():
            name, four = body[pos : pos + 4].decode("latin-1"), body[pos + 4 : pos + 8]
            n = _syncsafe(four) if major == 4 else int.from_bytes(four)
            if name.startswith("T"):
                text = _tag_text(body[pos + 10 : pos + 10 + n])
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                found.setdefault(key, value)
            pos += 10 + n
        at = min(end, at + 10 + size + 10 * bool(flags & 0x10))
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        found.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(at, end - size - 32 * bool(flags >> 31))
    return at, end


def _sound(data: bytes, at: int, end: int, h: Header) -> bool:
    """Whether the frame at ``at`` is whole and, if it is a checked one of Layer III, its checksum right."""
    if at + h.size > end:
        return False
    if not (h.checked and h.layer == 3):
        return True
    part = np.frombuffer(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side], np.uint8)
    return int(crc_left(part[None])[0]) == int.from_bytes(data[at + 4 : at + 6])


def _holds(data: bytes, at: int, end: int, h: Header, first: bool) -> bool:
    """Whether a frame is taken where it is due: if its kind or the end follows it, or else its checksum is right; the first one needs that."""
    after = at + h.size
    follows = after == end or (after < end and (x := header(data, after)) is not None and x.kind == h.kind)
    return follows and not first or _sound(data, at, end, h)


def _resync(data: bytes, at: int, end: int, kind: tuple | None) -> int:
    """The next place where a sound frame begins that the stream's end, or a frame of its kind, follows; else the end."""
    for m in re.finditer(rb"\xff[\xe0-\xff]", memoryview(data)[at:end]):
        here = at + m.start()
        h = header(data, here)
        if h and (kind is None or h.kind == kind) and _sound(data, here, end, h):
            after = header(data, here + h.size)
            if here + h.size == end or (after and after.kind == h.kind):
                return here
    return end


def _read_table(frame: bytes, h: Header) -> dict:
    """The variable-bitrate table of an information frame: Xing or Info with the encoder's extension, or VBRI; else nothing."""
    at = 4 + h.side
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        at += 2  # some writers count the checksum
    if frame[at : at + 4] in (b"Xing", b"Info"):
        found, flags, pos = {"name": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8]), at + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                value = frame[pos : pos + size]
                found[name] = list(value) if name == "toc" else int.from_bytes(value)
                pos += size
        if len(frame) >= pos + 36 and frame[pos : pos + 4].strip(b"\0"):
            more = frame[pos : pos + 36]
            ends = int.from_bytes(more[21:24])
            found |= {"encoder": more[:9].decode("latin-1").strip("\0 "), "delay": ends >> 12, "padding": ends & 0xFFF}
            found |= {"music_bytes": int.from_bytes(more[28:32]), "music_crc": int.from_bytes(more[32:34])}
            found["tag_sound"] = _right(frame[: pos + 34]) == int.from_bytes(more[34:36])
        return found
    if frame[36:40] == b"VBRI":
        delay, _, size, frames, entries, scale, width, per = struct.unpack(">HHIIHHHH", frame[42:62])
        sizes = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return {"name": "VBRI", "frames": frames, "bytes": size, "frames_an_entry": per, "entry_bytes": sizes}
    return {}


def index_stream(data: bytes) -> Index:
    """Tags, table, checksums and frames of a stream. Bytes between frames are skipped and counted; no frames: an empty index.

    Checksums of Layers I and II (of their bit allocation) aren't verified; streams of free bitrate aren't indexed.
    """
    out = Index()
    at, end = _read_tags(data, out.tags)
    frames: list[tuple[int, Header]] = []
    begin = at
    while at < end:
        h = header(data, at)
        if not h or (out.kind and h.kind != out.kind) or not _holds(data, at, end, h, first=not frames):
            found = _resync(data, at, end, out.kind)
            out.skipped += found - at
            at = found
            continue
        out.kind = out.kind or h.kind
        frames.append((at, h))
        at += h.size
    if frames and frames[0][1].layer == 3:
        first, h = frames[0]
        out.table = _read_table(data[first : first + h.size], h)
        if out.table:
            begin = first + h.size
            frames = frames[1:]
            if "music_crc" in out.table:
                music = data[begin : first + out.table["music_bytes"]]
                out.table["music_sound"] = crc_right(music) == out.table["music_crc"]
    out.offsets, out.headers = [x for x, _ in frames], [h for _, h in frames]
    raw = np.frombuffer(data, np.uint8)
    for side in {h.side for _, h in frames if h.checked and h.layer == 3}:
        places = np.array([x for x, h in frames if h.checked and h.layer == 3 and h.side == side])
        got = crc_left(raw[places[:, None] + np.array([2, 3, *range(6, 6 + side)])])
        want = raw[places + 4].astype(np.uint32) << 8 | raw[places + 5]
        out.checked += len(places)
        out.failed += int((got != want).sum())
    return out


# What is written: MPEG 1, Layer III, 32000 samples a second, mono, with checksums.
_KIND, _RATE, _MONO = 0xFA, 2, 0xC0
_SIZES = [144 * kbit // 32 for kbit in BITRATES[True, 3]]
_HEAD = 23


def _frame_head(index: int) -> bytes:
    two = bytes([index << 4 | _RATE << 2, _MONO])
    crc = int(crc_left(np.frombuffer(two + bytes(17), np.uint8)[None])[0])
    return bytes([0xFF, _KIND]) + two + crc.to_bytes(2) + bytes(17)


_HEADS = [b"", *map(_frame_head, range(1, 15))]


def write_stream(payload: bytes) -> bytes:
    """A stream that holds ``payload``: frames of the highest bitrate, the last of the least one that holds the rest."""
    room = _SIZES[14] - _HEAD
    sizes, parts = [], []
    for lo in range(0, len(payload), room):
        own = payload[lo : lo + room]
        index = next(i for i in range(1, 15) if _SIZES[i] - _HEAD >= len(own))
        sizes.append(_SIZES[index])
        parts += [_HEADS[index], own, bytes(_SIZES[index] - _HEAD - len(own))]
    music, info_size = b"".join(parts), _SIZES[3]
    ends = info_size + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    whole = info_size + len(music)
    seek = ends[np.arange(100) * len(sizes) // 100]
    info = bytes([0xFF, _KIND | 1, 3 << 4 | _RATE << 2, _MONO]) + bytes(17) + b"Xing" + struct.pack(">III", 15, len(sizes), whole)
    info += np.minimum(255, 256 * seek // whole).astype(np.uint8).tobytes() + struct.pack(">I", 0)
    info += b"lakemill\0" + bytes([4, 0]) + bytes(10) + bytes(3) + bytes(4) + struct.pack(">IH", whole, crc_right(music))
    info += _right(info).to_bytes(2)
    text = b"\3payload-bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + _safe(len(text)) + bytes(2) + text
    return b"ID3\4\0\0" + _safe(len(frame)) + frame + info + bytes(info_size - len(info)) + music


def _safe(n: int) -> bytes:
    return bytes(n >> 7 * k & 127 for k in (3, 2, 1, 0))


def read_payload(data: bytes, index: Index) -> bytes:
    """The bytes that ``write_stream`` put into the stream; none of a stream of others."""
    size = index.tags.get("payload-bytes", "")
    if not size.isdigit():
        return b""
    return b"".join(data[at + _HEAD : at + h.size] for at, h in zip(index.offsets, index.headers, strict=True))[: int(size)]


def feature(index: Index) -> str:
    """The stream in short: format, frames, exact seconds as a fraction, bitrates, checksums and a digest of the seek offsets."""
    if not index.headers:
        return f"no frames; skipped={index.skipped}"
    whole = gcd(index.samples, index.rate)
    rates = [h.bitrate for h in index.headers]
    seek = zlib.crc32(np.array(index.offsets, "<i8").tobytes())
    table = index.table
    return (
        f"mpeg{VERSIONS[index.kind[0]]} layer{index.kind[1]} {index.rate} Hz; frames={len(rates)}; seconds={index.samples // whole}/{index.rate // whole}; kbit={min(rates)}-{max(rates)}; "
        f"checksums={index.checked - index.failed}/{index.checked}; table={table.get('name', 'none')}:{table.get('frames', 0)}:{int(table.get('tag_sound', False))}{int(table.get('music_sound', False))}; skipped={index.skipped}; seek={seek:08x}"
    )


def _sliced(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)


def audio_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and media: every whole text's UTF-8 bytes, zeros appended up to a positive multiple of ``unit``, as an MPEG stream.

    A null text is empty; ids may be null or repeat; a very long text is a long stream of its own; an empty table gives no
    rows; further columns don't matter, whatever their names. Equal texts give equal streams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for doc, text in zip(b.column(0), b.column(1), strict=True):
                    data = (text.as_py() or "").encode()
                    yield doc.as_py(), len(data), write_stream(data + bytes(-len(data) % unit if data else unit))

        yield from _sliced(rows(), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], lambda x: len(x[2]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


INDEX = (
    "media_bytes long, media_sha256 string, version string, layer int, rate int, frames long, samples long, duration_us long, seek_offsets array<long>, "
    "bitrates array<int>, tags map<string,string>, table_frames long, table_sound boolean, music_sound boolean, checked long, failed long, skipped long, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long"
)


def index_audio(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and the index of every stream: format, exact length, offset and bitrate of each frame, tags, checks, and what of a written payload was read back.

    Frames are found again behind damaged bytes. A null stream, or one without frames, has zeros and no offsets. Streams
    are read one by one, so memory holds a batch of them; rows repeat as they come, an empty table gives no rows.
    """
    kept = media.select(*(F.col(f"`{c}`") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                columns = list(zip(*(_described(x.as_py() or b"") for x in part.column(len(keep))), strict=True))
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(list(x), t) for x, t in zip(columns, TYPES, strict=True))], [*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), INDEX])
    return media.select(*(F.col(f"`{c}`") for c in keep), F.col(media_col)).mapInArrow(tidy(run), schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}
TYPES = [_ARROW[x.split()[1]] for x in INDEX.split(", ")]


def _described(data: bytes) -> tuple:
    index = index_stream(data)
    payload = read_payload(data, index)
    version, layer = (VERSIONS[index.kind[0]], index.kind[1]) if index.kind else (None, None)
    table = index.table
    return (
        len(data), hashlib.sha256(data).hexdigest(), version, layer, index.rate, len(index.headers), index.samples, index.samples * 1_000_000 // max(index.rate, 1), index.offsets,
        [h.bitrate for h in index.headers], list(index.tags.items()), table.get("frames"), table.get("tag_sound"), table.get("music_sound"), index.checked, index.failed, index.skipped, feature(index),
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
    )


def media_digests(docs: DataFrame) -> DataFrame:
    """Writes the media column of ``docs`` to the shared folder, reads the stored streams back and indexes them."""
    stored = staged(audio_column(docs), "media")
    return index_audio(stored, keep=("doc_id", "n_bytes"))
