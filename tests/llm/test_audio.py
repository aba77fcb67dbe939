"""MPEG audio columns: exact round trips, and indexes of whole, tagged and damaged streams against a plain reader."""

import hashlib
import random
import zlib

import duckdb

from lakemill.llm import audio
from lakemill.llm import queries as Q

KBIT = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]


def frames(data, at):
    """Offset and size of the frames from ``at``, by the written kind's rule alone."""
    out = []
    while at < len(data):
        assert data[at] == 0xFF and data[at + 1] in (0xFA, 0xFB)
        out.append((at, 144 * KBIT[data[at + 2] >> 4] // 32))
        at += out[-1][1]
    assert at == len(data)
    return out


def crc(data):
    """The frames' checksum, bit by bit."""
    value = 0xFFFF
    for x in data:
        for k in range(7, -1, -1):
            top = (value >> 15) ^ (x >> k & 1)
            value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def random_bytes(n, seed=0):
    return random.Random(seed).randbytes(n)


def test_streams_hold_every_byte_and_their_index_is_right():
    for n in (64, 1408, 1472, 64 * 777):
        for payload in (random_bytes(n, n), b"\xff\xfa\xe8\xc0" * (n // 4)):  # the second looks like headers throughout
            data = audio.write_stream(payload)
            head = 10 + data[9]
            found = frames(data, head)
            assert b"".join(data[a + 23 : a + s] for a, s in found[1:])[:n] == payload
            for a, s in found[1:]:
                assert crc(data[a + 2 : a + 4] + data[a + 6 : a + 23]) == int.from_bytes(data[a + 4 : a + 6])
            index = audio.index_stream(data)
            assert index.offsets == [a for a, _ in found[1:]] and index.samples == 1152 * (len(found) - 1) and index.rate == 32000
            assert (index.checked, index.failed, index.skipped) == (len(found) - 1, 0, 0)
            assert index.table["frames"] == len(found) - 1 and index.table["bytes"] == len(data) - head
            assert index.table["tag_sound"] and index.table["music_sound"] and index.tags["payload-bytes"] == str(n)
            assert audio.read_payload(data, index) == payload


def test_damaged_streams_are_found_again():
    payload = random_bytes(64 * 400, 3)
    data = audio.write_stream(payload)
    whole = audio.index_stream(data)
    at = whole.offsets[6]
    flipped = bytearray(data)
    flipped[at + 9] ^= 4
    assert audio.index_stream(bytes(flipped)).failed == 1
    between = audio.index_stream(data[:at] + b"\xff\xfa\xe8\xc0junk" * 9 + data[at:])
    assert between.skipped == 72 and [x - 72 for x in between.offsets[6:]] == whole.offsets[6:]
    assert audio.read_payload(data[:at] + b"\xff\xfa\xe8\xc0junk" * 9 + data[at:], between) == payload
    lost = audio.index_stream(data[:at] + data[at + 500 :])  # a frame's head is gone
    assert lost.offsets[6:] == [x - 500 for x in whole.offsets[7:]] or len(lost.offsets) == len(whole.offsets) - 1
    short = audio.index_stream(data[: at + 700])
    assert short.offsets == whole.offsets[:6] and short.skipped == 700
    table = audio.index_stream(data[:20] + bytes([data[20]]) + data[21:])
    assert table.offsets == whole.offsets
    assert not audio.index_stream(b"").headers and audio.index_stream(random_bytes(9000, 5)).samples == 0


def test_tags_and_other_kinds_of_streams():
    # layer 2, version 2, 64 kbit/s at 22050 Hz with padding every other frame
    one = lambda pad: bytes([0xFF, 0xF5, 8 << 4 | 0 << 2 | pad << 1, 0xC0]).ljust(144 * 64000 // 22050 + pad, b"\x11")
    stream = b"".join(one(k % 2) for k in range(10))
    text = b"\0A title"
    tag = b"ID3\3\0\0" + bytes([0, 0, 0, 10 + len(text)]) + b"TIT2" + len(text).to_bytes(4) + b"\0\0" + text
    last = b"TAG" + b"Other".ljust(125, b"\0")
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(4) + bytes(4) + bytes(8)
    index = audio.index_stream(tag + stream + ape + last)
    assert len(index.offsets) == 10 and index.samples == 11520 and index.kind == (2, 2, 22050)
    assert index.tags["TIT2"] == "A title" and index.skipped == 0
    vbri = bytes([0xFF, 0xFB, 9 << 4, 0xC0]).ljust(36, b"\0") + b"VBRI" + bytes([0, 1, 0, 0, 0, 0]) + (900).to_bytes(4) + (2).to_bytes(4) + bytes([0, 2, 0, 2, 0, 1, 0, 1]) + bytes([200, 217])
    frame = bytes([0xFF, 0xFB, 9 << 4, 0xC0]).ljust(417, b"\0")
    index = audio.index_stream(vbri.ljust(417, b"\0") + frame * 2)
    assert index.table["name"] == "VBRI" and index.table["entry_bytes"] == [400, 434] and len(index.offsets) == 2


def test_whole_table(spark):
    found = {x.doc_id: x for x in Q.QUERIES["op12_audio"](spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert len(found) == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media, x = audio.write_stream(payload), found[doc]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (x.tail_crc32, x.media_bytes, x.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_odd_rows(spark):
    rows = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "é" * 32, "c"), (3, "x" * 3_000_000, "d"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string").withColumn("feature", audio.F.lit(1))
    got = sorted((x.doc_id or 0, x.n_bytes, x.payload_bytes, x.feature) for x in audio.media_digests(df).collect())
    assert [g[:3] for g in got] == [(0, 0, 64), (1, 0, 64), (1, 0, 64), (2, 64, 64), (3, 3_000_000, 3_000_000), (4, 0, 64)]
    assert got[1] == got[2] and got[0][3] == got[5][3] == got[1][3]
    assert audio.media_digests(df.filter("false")).count() == 0


def test_an_index_of_foreign_streams(spark):
    stream = audio.write_stream(b"a" * 6400)
    df = spark.createDataFrame([(1, bytearray(stream)), (2, None), (3, bytearray(b"no audio"))], "id int, clip binary")
    found = {x.id: x for x in audio.index_audio(df, "clip", ("id",)).collect()}
    assert found[1].frames == 5 and found[1].duration_us == 5 * 1152 * 1_000_000 // 32000 and len(found[1].seek_offsets) == 5
    assert found[2].frames == found[3].frames == 0 and found[3].version is None
