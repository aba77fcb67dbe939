"""Sum-of-squares packing of documents into sequences of bounded length (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import staged, tidy
from lakemill.llm.tokens import crc32_u32, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs. Its open bins at the end are the only waste that a task adds.
GROUP = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of at most ``limit`` tokens of every document (its ids and ``end_id``), without a shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            doc_ids, lo = b.column(0).to_pylist(), 0
            for flat, ends in enc.encode(b.column(1), end_id):
                rows, begin = [], 0
                for doc, end in zip(doc_ids[lo : lo + len(ends)], ends.tolist(), strict=True):
                    for piece, start in enumerate(range(begin, end, limit)):
                        own = flat[start : min(end, start + limit)]
                        rows.append((doc, piece, start - begin, len(own), crc32_u32(own)))
                    begin = end
                lo += len(ends)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(cut), PIECES)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item, placed in the given order.

    An item goes into the open bin for which the sum of squared counts of open bins per gap becomes smallest, of
    equal ones the fullest; a bin is opened where no open one has room. Full bins are closed.
    """
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    counts = np.zeros(limit + 1, np.int64)
    of, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        held = counts[size:]
        # moving a bin from gap g to g - size changes the sum by 2 * (count[g - size] - count[g]) + 2, by 1 less if it closes
        change = np.where(held > 0, counts[: len(held)] - held, limit * len(lengths) + 1)
        change[0] -= held[0] > 0
        gap = size + int(np.argmin(change)) if len(held) else limit + 1
        if gap > limit or not counts[gap]:
            bin_, gap, n = n, limit, n + 1
        else:
            bin_ = open_bins[gap].pop()
            counts[gap] -= 1
        of[k], offsets[k] = bin_, limit - gap
        if gap > size:
            open_bins[gap - size].append(bin_)
            counts[gap - size] += 1
    return of, offsets


def pack(pieces: DataFrame, limit: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``limit``.

    Pieces are dealt evenly to groups of about ``group``, whatever they are, so rows repeated without end fill no group, and
    packed longest first, each group in one task; no task depends on another. Null ids, ties, repeated rows and empty
    documents (their end id alone) are packed like others; an empty table gives no rows.
    """
    parts = max(1, -(-pieces.count() // group))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [x for x in frames if len(x)]
        if own:
            x = pd.concat(own, ignore_index=True)
            of, offsets = sum_of_squares(x["length"].to_numpy(), limit)
            yield x.assign(sequence_id=(TaskContext.get().partitionId() << 40) + of, offset=offsets)

    dealt = pieces.repartition(parts).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return dealt.mapInPandas(tidy(place), f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """Encodes, cuts and packs all documents. Pieces are staged, so no text is encoded twice.

    A null text is empty; ids may be null or repeat; very long texts are cut into pieces; further columns don't matter,
    whatever their names; no documents: no rows.
    """
    return pack(staged(token_pieces(docs, tokenizer, end_id, limit), "pieces"), limit)
