"""Removal of long repeated byte strings by merging sorted suffixes of shards (operator 5).

Any string of ``length`` bytes has an anchor: of its 48-byte windows the one of least hash (the leftmost of equal
ones). Equal strings have equal anchors at equal offsets, so only suffixes of one anchor need to be merged:

1. every text's anchors, each with the starts that it is the anchor of, a narrow row each;
2. anchors that occur once are dropped; occurrences with the same text around them, told apart by two 64-bit hashes,
   are one shard;
3. the shards' suffixes at those starts are interleaved anchor by anchor: each round refines the interleave by the
   next 8 bytes, only in blocks that still hold suffixes of two starts, until ``length`` bytes are equal. A round's
   number bounds the common prefixes of the blocks that it splits; what is left are the repeated intervals;
4. repeated starts are joined to spans and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import dropped, narrow, staged, tidy

GRAM = 48
#: Rows up to which a table of text hashes (8 bytes each, about 20 MB as a hash table) is broadcast to filter texts before they are shuffled; else it is joined.
BROADCAST = 200_000
#: Shards of one anchor from which they are dealt out by offset and by the bytes that a range of offsets shares.
HOT = 1024
#: Offsets in such a range.
RANGE = 16
#: Rows of shards that are merged at once (more only if one key has more), and texts that are cut at once.
ROWS, TEXTS = 2048, 256
#: Bytes of a text that are hashed at once.
CHUNK = 4 << 20

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_up, _down = _powers(_ROOT, 1 << 16), _powers(_BACK, 1 << 16)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte window of a byte array, by prefix sums of a polynomial."""
    global _up, _down
    n = len(text)
    if len(_up) < n:
        _up, _down = _powers(_ROOT, 2 * n), _powers(_BACK, 2 * n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[text] * _up[:n], out=sums[1:])
    x = (sums[GRAM:] - sums[:-GRAM]) * _down[: n - GRAM + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, position and first and last start of each anchor that some starts of ``length``-byte strings have."""
    width, parts = length - GRAM + 1, []
    for at in range(0, max(1, len(text) - length + 1), CHUNK):
        h = gram_hashes(np.frombuffer(text[at : at + CHUNK + length - 1], np.uint8))
        n = len(h) - width + 1
        # hash above, position below: the least is the leftmost of the least hashes
        keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // width) * width, 2**64 - 1, np.uint64)
        padded[: len(h)] = keyed
        rows = padded.reshape(-1, width)
        front = np.minimum.accumulate(rows, 1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = (np.minimum(back[:n], front[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        last = np.append(first[1:], n) - 1
        where = least[first]
        parts.append((h[where], where + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """From (text_hash, text): a row for each anchor with its starts and a hash of all bytes they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, 8 * TEXTS) for x in batches for lo in range(0, len(x), 8 * TEXTS)):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for of, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if len(text) < length:
                    continue
                h, where, first, last = anchors(text, length)
                view = memoryview(text)
                around = [xxhash.xxh64_intdigest(view[i : j + length], p - i) for p, i, j in zip(where.tolist(), first.tolist(), last.tolist(), strict=True)]
                for k, x in enumerate((h.view(np.int64), np.asarray(around, np.uint64).view(np.int64), np.full(len(h), of), where, where - first, last - first + 1)):
                    out[k].append(x)
            if out[0]:
                columns = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), *(pa.array(x, pa.int32()) for x in columns[3:])], ["anchor", "around", "text_hash", "at", "back", "starts"])

    return texts.select("text_hash", "text").mapInArrow(tidy(run), "anchor long, around long, text_hash long, at int, back int, starts int")


def repeated_starts(block: np.ndarray, at: np.ndarray, buffer: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of the buffer at ``at`` share ``length`` bytes with another one of their block.

    Interleave refinement: each round orders the suffixes of every block by their next 8 bytes and splits it; blocks
    of a single suffix are settled and leave.
    """
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
    alive = np.arange(len(at))
    for depth in range(0, length, 8):
        step = min(depth, length - 8)  # the last round may overlap the one before
        word = words[at[alive] + step]
        order = np.lexsort((word, block[alive]))
        alive, word = alive[order], word[order]
        own = block[alive]
        new = np.empty(len(alive), bool)
        new[:1] = True
        new[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
        ids = np.cumsum(new) - 1
        keep = np.bincount(ids, minlength=1)[ids] > 1
        block[alive] = ids
        alive = alive[keep]
        if not len(alive):
            break
    return alive


def merge_shards(shards: DataFrame, length: int) -> DataFrame:
    """text_hash and ranges of repeated starts, from rows (key, text_hash, base, back, starts, bytes) dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            key, of, base, back, starts = (np.asarray(rows[c]) for c in ("key", "text_hash", "base", "back", "starts"))
            pieces = rows["bytes"].to_pylist()
            sizes = np.asarray([len(x) for x in pieces], np.int64)
            buffer = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
            row = np.repeat(np.arange(len(key)), starts)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            # equal strings have the anchor at equal offsets
            block = np.unique(np.stack([key[row], back[row] - offset], 1), axis=0, return_inverse=True)[1].ravel()
            found = np.sort(repeated_starts(block, (np.cumsum(sizes) - sizes)[row] + offset, buffer, length))
            if len(found):
                new = np.flatnonzero(np.diff(found, prepend=-2) != 1)
                new = np.union1d(new, np.flatnonzero(np.diff(row[found], prepend=-1)))
                first, last = found[new], found[np.append(new[1:], len(found)) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(of[row[first]]), pa.array(base[row[first]] + offset[first], pa.int64()), pa.array(base[row[first]] + offset[last], pa.int64())], ["text_hash", "first", "last"])

        def portions(rows: pa.Table) -> Iterator[pa.Table]:
            """Runs of whole keys of about ROWS rows; the last one's key may go on."""
            key, lo = np.asarray(rows["key"]), 0
            borders = np.flatnonzero(np.diff(key)) + 1
            while lo < len(key):
                at = int(np.searchsorted(borders, lo + ROWS))
                hi = int(borders[at]) if at < len(borders) else len(key)
                yield rows.slice(lo, hi - lo)
                lo = hi

        for b in batches:
            held.append(b)
            *whole, rest = portions(pa.Table.from_batches(held)) if sum(map(len, held)) > ROWS else [pa.Table.from_batches(held)]
            for x in whole:
                yield from solved(x)
            held = rest.combine_chunks().to_batches() if whole else held
        for x in portions(pa.Table.from_batches(held)) if held else ():
            yield from solved(x)

    return shards.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "text_hash long, first long, last long")


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts whose hash is in ``keys`` (small enough: broadcast, so no other text is shuffled)."""
    keys = staged(keys.select("text_hash").distinct(), "suffix-keys")
    return texts.join(narrow(keys, BROADCAST), "text_hash", "left_semi")


def repeated_ranges(texts: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(text_hash, first, last): ranges of starts of strings that also start elsewhere, among texts of different hash or in one text."""
    rows = staged(anchor_rows(texts, length), "suffix-anchors")
    place = F.xxhash64("text_hash", "at")
    twice = rows.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("anchor")
    # tables of anchors are written first: a join right above an aggregate could not split the rows of a hot anchor
    twice = staged(twice, "suffix-twice")
    rows = staged(rows.join(twice, "anchor", "left_semi"), "suffix-repeated")
    kinds = rows.groupBy("anchor", "around", "back", "starts").agg(F.min(F.struct("text_hash", "at")).alias("one"), F.max(F.struct("text_hash", "at")).alias("other"))
    kinds = staged(kinds.select("anchor", "around", "back", "starts", "one.text_hash", "one.at", (F.col("one") != F.col("other")).alias("shared")), "suffix-shards")
    same = rows.join(kinds.filter("shared").select("anchor", "around", "back", "starts"), ["anchor", "around", "back", "starts"], "left_semi")
    whole = same.select("text_hash", (F.col("at") - F.col("back")).cast("long").alias("first"), (F.col("at") - F.col("back") + F.col("starts") - 1).cast("long").alias("last")).distinct()
    many = kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").withColumn("hot", F.col("n") > hot).select("anchor", "hot")
    many = staged(many, "suffix-many")
    wanted = staged(kinds.join(many, "anchor").select("text_hash", "anchor", "at", "back", "starts", "shared", "hot"), "suffix-wanted")
    listed = wanted.groupBy("text_hash").agg(F.collect_list(F.struct("anchor", "at", "back", "starts", "hot")).alias("places"))
    cut = _only(texts, wanted).dropDuplicates(["text_hash"]).join(listed, "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, TEXTS) for x in batches for lo in range(0, len(x), TEXTS)):
            out: list[tuple] = []
            for of, text, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                for p in places:
                    begin, n = p["at"] - p["back"], p["starts"]
                    if not p["hot"]:
                        out.append((p["anchor"], of, begin, p["back"], n, text[begin : begin + n - 1 + length]))
                        continue
                    # starts are cut at multiples of RANGE of their distance to the anchor, alike in all shards
                    back = p["back"]
                    while n:
                        take = min(n, back % RANGE + 1)
                        near = p["at"] - back // RANGE * RANGE
                        core = text[near : p["at"] - (back // RANGE + 1) * RANGE + 1 + length]
                        key = xxhash.xxh64_intdigest(core, (p["anchor"] + back // RANGE) & (2**64 - 1))
                        out.append((key - (1 << 64) if key >> 63 else key, of, begin, back, take, text[begin : begin + take - 1 + length]))
                        begin, back, n = begin + take, back - take, n - take
                if len(out) > 4096:
                    yield _shard_batch(out)
                    out = []
            if out:
                yield _shard_batch(out)

    shards = cut.select("text_hash", "text", "places").mapInArrow(tidy(run), "key long, text_hash long, base long, back int, starts int, bytes binary")
    return whole.union(merge_shards(shards, length))


def _shard_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "text_hash", "base", "back", "starts", "bytes"])


def spans_of(firsts: list[int], lasts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting in these ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(firsts, lasts, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def text_keys(rows: DataFrame, outlive) -> tuple[DataFrame, DataFrame]:
    """``rows`` (text, n_bytes) with a 64-bit text_hash that no two different texts share, and (text_hash, n, size) of repeated texts.

    Where 128-bit digests show that a hash stands for several texts, these take a hash of their digests instead; ``outlive``
    stages the list of such hashes.
    """
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "digest": F.unhex(F.md5(F.col("text").cast("binary")))})

    def counted(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.max("n_bytes").alias("size"), (F.min("digest") != F.max("digest")).alias("several"))
        return staged(found.filter("n > 1"), "suffix-copies")

    copies = counted(rows.select("text_hash", "digest", "n_bytes"))
    several = copies.filter("several").select(F.col("text_hash").alias("shared"))
    if not several.isEmpty():
        several = outlive(several, "suffix-several")  # a few in billions of texts
        rows = rows.join(F.broadcast(several), F.col("text_hash") == F.col("shared"), "left")
        rows = rows.withColumn("text_hash", F.when(F.col("shared").isNull(), F.col("text_hash")).otherwise(F.xxhash64("digest"))).drop("shared")
        copies = counted(rows.select("text_hash", "digest", "n_bytes"))
    return rows.drop("digest"), copies.select("text_hash", "n", "size")


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, the columns ``keep`` and, if asked for, its left text.

    Bytes are removed that a ``length``-byte string covers that also starts anywhere else. Texts of two rows and more
    are removed whole if long enough, whatever their ids; a null text is an empty one; null and repeated ids stay. Very
    long texts are searched whole, further columns don't matter, columns to keep may have any name, an empty table gives no rows.
    Left bytes that aren't UTF-8 (a string may start inside a character) are kept in the digest and dropped in the text.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [f"keep{k}" for k in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    with dropped(spark) as outlive:
        rows, copies = text_keys(rows, outlive)
        copies = copies.filter(F.col("size") >= length).select("text_hash", F.lit(0).cast("long").alias("first"), (F.col("size") - length).alias("last"))
        long_ = rows.filter(F.col("n_bytes") >= length).select("text_hash", "text")
        ranges = staged(repeated_ranges(long_, length, hot).union(copies), "suffix-ranges")
        # only texts that lose something are shuffled
        hit = outlive(ranges.groupBy("text_hash").agg(F.collect_list(F.struct("first", "last")).alias("found")), "suffix-found")
    keys = narrow(hit.select("text_hash"), BROADCAST)
    names = ["doc_id", *carried, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else [])]
    schema = ", ".join([f"doc_id {kinds[id_col]}", *(f"{k} {kinds[c]}" for c, k in zip(keep, carried, strict=True)), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["text string"] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.slice(lo, 1024).columns], whole.schema.names)
                got: list[tuple] = []
                for text, found in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("found").to_pylist(), strict=True):
                    spans = spans_of([x["first"] for x in found], [x["last"] for x in found], length)
                    at, left = 0, []
                    for i, j in spans:
                        left.append(text[at:i])
                        at = j
                    rest = b"".join([*left, text[at:]])
                    got.append((sum(j - i for i, j in spans), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
                columns = [pa.array(x, k) for x, k in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *carried, "n_bytes")), *columns[: 3 + with_text]], names)

    cut = rows.join(keys, "text_hash", "left_semi").join(hit, "text_hash")
    cut = cut.select("doc_id", *carried, "n_bytes", "text", "found").mapInArrow(tidy(run), schema)
    clean = rows.join(keys, "text_hash", "left_anti").select("doc_id", *carried, "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *(["text"] if with_text else []))
    out = cut.unionByName(clean)
    return out.select("doc_id", *(F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)), *names[1 + len(keep) :])
