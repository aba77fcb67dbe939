"""Token ids in flat binary files with 64-bit document offsets (operator 1).

Layout of a folder: ``ids-X.bin`` has the token ids of one range of documents (a shard), little-endian unsigned
integers of ``dtype`` (16 bits if the vocabulary fits, else 32); ``docs-X.bin`` its document ids (int64);
``offsets-X.bin`` one int64 more than it has documents: where each document starts among the ids of *all* shards.
Shards follow each other in ascending document id order. ``manifest.json`` names their files with their bases. X tells
the shard and the attempt that wrote it, so nothing is renamed or overwritten: files of attempts that failed are not named.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import give_back, scratch

#: Stored for a null document id.
NULL_ID = -(2**63)
#: Chunks whose ids an encoder keeps, at most: the first it meets, so mostly common ones. About 300 bytes each.
KEPT = 150_000
#: Bytes of text whose distinct chunks are looked up at once.
SLICE = 24 << 20
#: Chunks that are encoded at once, and chunks of whole texts that are turned into ids at once.
PIECE, GATHER = 4096, 1 << 19

#: Letters that NFC and lower-casing leave as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes texts with a ``tokenizers`` file, each distinct white-space-delimited chunk of a slice only once.

    Right for tokenizers that drop white space between their pre-tokens, as no token then spans a chunk's border; a
    probe finds whether one does, and any other gets its texts whole. Probes also find whether ASCII letters may be
    lowered first and whether a word and the comma or full stop behind it may be encoded apart, without normaliser.
    Of earlier slices only KEPT chunks are kept, so memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}
        probe = "ab, cd\n\tef  1 2.\r\n"
        self.chunked = self._whole([probe])[0] == b"".join(self._whole(probe.split()))
        self.lowers = self.chunked and self._whole(["QÉ A"]) == self._whole(["qÉ a"])
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        some = ["a", "the", "ÿé", "straße", "queêment", "thonblestioneaer"]
        self.apart = self.lowers and self._whole(some) == self._plain(some) and self._whole(["ab,", "üb."]) == [x + y for x, y in zip(self._plain(["ab", "üb"]), self._whole([",", "."]), strict=True)]
        self.stops = {x: self._whole([x])[0] for x in ("", ",", ".")}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self._run(self.tokenizer, texts)

    def _plain(self, letters: list[str]) -> list[bytes]:
        return self._run(self.bare, letters)

    def _run(self, tokenizer, texts: list[str]) -> list[bytes]:
        got, kind = [], "H" if self.dtype.itemsize == 2 else "I"
        for lo in range(0, len(texts), PIECE):  # an encoding takes far more memory than its ids
            for x in tokenizer.encode_batch_fast(texts[lo : lo + PIECE], add_special_tokens=False):
                ids = x.ids
                got.append(struct.pack(f"<{len(ids)}{kind}", *ids))
        return got

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the texts: all their ids, ``end_id`` behind each text, and where each text ends among them."""
        texts, lo = pa.concat_arrays([texts]).cast(pa.large_string()).fill_null(""), 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, "right")))
            yield from self._slice(pa.concat_arrays([texts.slice(lo, hi - lo)]), end_id)  # kernels misread some slices; a copy is safe
            give_back()
            lo = hi

    def _slice(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.chunked:
            if self.lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are matched before letters are lowered
                texts = pc.ascii_lower(texts)
            split = pc.ascii_split_whitespace(texts)
            coded, borders = split.flatten().dictionary_encode(), np.asarray(split.offsets) - split.offsets[0].as_py()
            del split
            order, ids = coded.indices.to_numpy(zero_copy_only=False), self._known(coded.dictionary.to_pylist())
        else:
            order, borders = np.arange(len(texts)), np.arange(len(texts) + 1)
            ids = self._whole(texts.to_pylist())
        n = len(texts)
        del texts
        lengths = np.asarray([len(x) for x in ids] + [self.dtype.itemsize]) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([np.frombuffer(b"".join(ids), self.dtype), np.asarray([end_id], self.dtype)])
        del ids
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(borders, borders[lo] + GATHER, "right")) - 1)
            some = np.insert(order[borders[lo] : borders[hi]], borders[lo + 1 : hi + 1] - borders[lo], len(lengths) - 1)  # the end id is one chunk more
            own = lengths[some]
            ends = np.cumsum(own)
            at = np.repeat(starts[some] - (ends - own), own)
            at += np.arange(len(at))
            yield flat[at], ends[borders[lo + 1 : hi + 1] - borders[lo] + np.arange(hi - lo)]
            lo = hi

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        got = [*map(self.kept.get, chunks)]
        plain: list[tuple[int, str, str]] = []
        missing = rest = [k for k, x in enumerate(got) if x is None]
        if self.apart:
            rest = []
            for k in missing:
                x = chunks[k]
                stop = x[-1:] if x[-1:] in ",." else ""
                letters = x[: len(x) - len(stop)]
                if PLAIN(letters):
                    plain.append((k, letters, stop))
                else:
                    rest.append(k)
            for (k, _, stop), x in zip(plain, self._plain([x for _, x, _ in plain]), strict=True):
                got[k] = x + self.stops[stop]
        for k, x in zip(rest, self._whole([chunks[k] for k in rest]), strict=True):
            got[k] = x
        for k in missing[: KEPT - len(self.kept)]:
            self.kept[chunks[k]] = got[k]
        return got


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for the file; Python workers are reused, so it is loaded once in each."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _put(where: fs.FileSystem, path: str, parts) -> None:
    with where.open_output_stream(path) as out:
        for x in parts:
            out.write(x)


def _tag(shard: int) -> str:
    """A name for a shard's files that no other attempt has."""
    context = TaskContext.get()
    return f"{shard:05d}-{context.stageId()}-{context.taskAttemptId()}"


def _mapped(where: fs.FileSystem, path: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped if the store is a file system, else read."""
    if isinstance(where, fs.LocalFileSystem):
        with open(path, "rb") as f:
            if not os.fstat(f.fileno()).st_size:
                return np.empty(0, dtype)
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes all documents' ids and returns the manifest. One shuffle, by ranges of the id.

    A document's ids are those of its whole text and ``end_id``; a null text is empty. Null ids come first; rows of
    one id follow each other in order of their texts' hashes (ranges also split by it, so a hot id takes many
    shards), repeated rows stay, further columns don't matter, an empty table gives an empty manifest. Very long texts
    are encoded whole, each as a slice of its own. Only counts a shard reach the driver; their prefix sums are the
    shards' bases, from which a second step writes the offsets.
    """
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mixed", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        enc, shard, ids, lengths = encoder(tokenizer), TaskContext.get().partitionId(), [], []
        tag = _tag(shard)

        def parts():
            for b in batches:
                ids.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                for flat, ends in enc.encode(b.column(1), end_id):
                    lengths.append(np.diff(ends, prepend=0))
                    yield flat.tobytes()

        _put(where, f"{path}/ids-{tag}.bin", parts())
        _put(where, f"{path}/docs-{tag}.bin", [np.concatenate(ids or [np.empty(0)]).astype("<i8").tobytes()])
        _put(where, f"{path}/lengths-{tag}.bin", [(n := np.concatenate(lengths or [np.empty(0)]).astype("<i8")).tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([tag]), pa.array([len(n)], pa.int64()), pa.array([n.sum()], pa.int64())], ["shard", "tag", "n_docs", "n_tokens"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns a shard's lengths into global offsets."""
        where, path = _open(folder)
        for b in batches:
            for shard, tag, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = _tag(shard)
                lengths = _mapped(where, f"{path}/lengths-{tag}.bin", "<i8")
                _put(where, f"{path}/offsets-{own}.bin", [(base + np.concatenate([[0], np.cumsum(lengths)])).astype("<i8").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own])], ["shard", "tag"])

    ranged = rows.repartitionByRange("id", "mixed").sortWithinPartitions("id", "mixed", "text").select("id", "text")
    counts = sorted(map(tuple, ranged.mapInArrow(encode, "shard int, tag string, n_docs long, n_tokens long").collect()))
    shards, base = [], 0
    for shard, tag, n_docs, n_tokens in counts:
        shards.append({"shard": shard, "tag": tag, "n_docs": n_docs, "n_tokens": n_tokens, "base": base})
        base += n_tokens
    listed = docs.sparkSession.createDataFrame([(x["shard"], x["tag"], x["base"]) for x in shards], "shard int, tag string, base long").repartition(max(1, len(shards)), "shard")
    offsets = dict(map(tuple, listed.mapInArrow(place, "shard int, tag string").collect()))
    manifest = {"dtype": encoder(tokenizer).dtype.str, "n_tokens": base, "shards": [{**x, "offsets": offsets[x["shard"]]} for x in shards]}
    _put(where, f"{path}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: a task maps the ids and offsets of a shard. Empty folder: no rows."""
    where, path = _open(folder)
    with where.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        for tag, place, base in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            offsets, doc_ids = _mapped(where, f"{path}/offsets-{place}.bin", "<i8"), _mapped(where, f"{path}/docs-{tag}.bin", "<i8")
            ids = _mapped(where, f"{path}/ids-{tag}.bin", dtype)
            for lo in range(0, len(doc_ids), 8192):
                own = doc_ids[lo : lo + 8192]
                at = offsets[lo : lo + len(own) + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64(), mask=own == NULL_ID),
                    pa.array(at[:-1], pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([crc32_u32(ids[a - base : b - base]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = [(x["tag"], x["offsets"], x["base"]) for x in manifest["shards"] if x["n_docs"]]
    listed = spark.createDataFrame(shards, "tag string, place string, base long").repartition(max(1, len(shards)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``docs`` to a new folder of token files in the shared folder and reads them back."""
    folder = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
