"""Hard-negative mining by norm-bucketed search (operator 13).

Candidates are sorted by their norm and dealt into bands of falling norms; a task cuts its bands into buckets. An inner
product is at most the product of two norms, so a bucket is passed over for an anchor whose norm times the bucket's
largest one is below what the anchor asks for: the lower limit of its window and the worst score it would still take.
Bands are searched in waves of doubling size, so that later ones start from the scores found by earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.common import dropped, staged, tidy
from lakemill.llm.tokens import _open
from lakemill.llm.vectors import _large, _product, scaled

#: Rows of a band, of a bucket, and anchors compared with a bucket at once.
BAND, BUCKET, ANCHORS = 16_384, 2048, 256
#: Components that a task holds at once while it reads all anchors.
HELD = 1 << 23
LEAST = -(2**63)


class Slot:
    """What an anchor asks for: its ``k`` best candidates within ``low`` and ``high``, and the best found so far."""

    def __init__(self, low: int, high: int, worst: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.floor = low if worst is None else max(low, worst)
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if not len(fits):
            return
        ids, scores = np.concatenate([self.ids, ids[fits]]), np.concatenate([self.scores, scores[fits]])
        best = np.lexsort((ids, ~scores))[: self.k]  # ~x turns the order of all 64-bit numbers round
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:  # equal scores may still win by their ids
            self.floor = max(self.floor, int(self.scores[-1]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows, held at the limits of 64 bits."""
    if _large(a).any() or _large(b).any():
        return np.clip(a.astype(object) @ b.astype(object).T, LEAST, 2**63 - 1).astype(np.int64)
    return _product(a, b)


def search(buckets: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, slots: list[list[Slot]], same: bool) -> None:
    """Fills the slots of a block of anchors from buckets (ids, labels, vectors, largest norm) of falling norms."""
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1)) * (1 + 1e-9)
    for c_ids, c_labels, c_vectors, largest in buckets:
        bounds = norms * largest + 1
        live = [i for i in range(len(ids)) if any(s.low <= s.high and s.floor <= bounds[i] for s in slots[i])]
        if not live:
            continue
        scores = products(vectors[live], c_vectors)
        for row, i in enumerate(live):
            mine = np.flatnonzero(((c_labels == labels[i]) == same) & (c_ids != ids[i]))
            for slot in slots[i]:
                if slot.floor <= bounds[i]:
                    slot.take(c_ids[mine], scores[row, mine])


def _buckets(batches: list[pa.RecordBatch]) -> dict[int, list]:
    """Buckets of the rows by the length of their vectors."""
    found: dict[int, list] = {}
    for b in batches:
        ids, labels, sizes = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2).value_lengths())
        flat, starts = b.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            own = flat[starts[at][:, None] + np.arange(n)].reshape(len(at), n)
            norms = np.sqrt((own.astype(float) ** 2).sum(1)) * (1 + 1e-9)
            found.setdefault(int(n), []).append((ids[at], labels[at], own, float(norms.max(initial=0))))
    return {n: sorted(x, key=lambda y: -y[3]) for n, x in found.items()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task in buckets, as many at once as HELD allows."""
    held, values = [], 0
    for batch in batches:
        for lo in range(0, len(batch), BUCKET):
            part = batch.slice(lo, BUCKET)
            held.append(part)
            values += len(part.column(2).flatten())
            if values >= HELD:
                yield held
                held, values = [], 0
    if held:
        yield held


def _wave(bands: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor (its number), slot, vec_id and score: of each task the ``k`` best for every slot of all anchors."""
    files = asked.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for held in _pieces(batches):
            by_length = _buckets(held)
            for uri in files:
                where, path = _open(uri)
                with where.open_input_file(path) as f:
                    for q in pq.ParquetFile(f).iter_batches(ANCHORS, columns=["anchor", "vec_id", "label", "vector", "slots"]):
                        yield from answers(q.to_pydict(), by_length)

    def answers(q: dict, by_length: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for n, buckets in by_length.items():
            at = [i for i, v in enumerate(q["vector"]) if len(v) == n]
            if not at:
                continue
            slots = [[Slot(s["low"], s["high"], s["worst"], k) for s in q["slots"][i]] for i in at]
            vectors = np.asarray([q["vector"][i] for i in at], np.int64).reshape(len(at), n)
            search(buckets, np.asarray([q["vec_id"][i] for i in at]), np.asarray([q["label"][i] for i in at]), vectors, slots, same)
            out = [(q["anchor"][i], no, s) for i, own in zip(at, slots, strict=True) for no, s in enumerate(own) if len(s.ids)]
            if out:
                counts = [len(s.ids) for _, _, s in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in out], counts)), pa.array(np.repeat([x[1] for x in out], counts).astype(np.int32)),
                     pa.array(np.concatenate([s.ids for _, _, s in out])), pa.array(np.concatenate([s.scores for _, _, s in out]))],
                    ["anchor", "slot", "vec_id", "score"])

    return bands.select("vec_id", "label", "vector").mapInArrow(tidy(run), "anchor long, slot int, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(bands: DataFrame, n_bands: int, asked: DataFrame, k: int, same: bool, first: int) -> DataFrame:
    """anchor, slot, rank, vec_id and score of the ``k`` best of all bands, in waves of ``first``, 2 ``first``, ... bands."""
    best, at, size = None, 0, max(1, first)
    while at < max(n_bands, 1):
        if best is not None:  # the worst score of a full slot is where the next wave begins
            worst = best.groupBy("anchor", "slot").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("score")).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("worst"))
            known = F.transform("slots", lambda s, i: s.withField("worst", F.try_element_at("worst", i.cast("int"))))
            asked = staged(asked.join(worst, "anchor", "left").withColumn("slots", F.when(F.col("worst").isNull(), F.col("slots")).otherwise(known)).drop("worst"), "negative-anchors")
        new = _wave(bands.filter(F.col("band").between(at, at + size - 1)), asked, k, same)
        best = staged(_best(new if best is None else best.drop("rank").union(new), k), "negative-best")
        at, size = at + size, 2 * size
    return best


def banded(rows: DataFrame, band_rows: int) -> tuple[DataFrame, int]:
    """``rows`` in bands of falling norms, staged; and their number. Equal rows are told apart by a row number, so none fills a band beyond its share."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n = max(1, -(-rows.count() // band_rows))
    keys = [F.desc("norm"), F.asc("vec_id"), F.asc("row")]
    sorted_ = rows.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    bands = staged(sorted_.withColumn("band", F.spark_partition_id()).drop("row", "norm"), "negative-bands")
    return bands, int(bands.agg(F.max("band")).first()[0] or 0) + 1


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", band_rows: int = BAND, first: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components become floor(scale * x); a score is the integer inner product. ``anchors`` tells the rows that are anchors.
    An anchor's positives are its ``positives`` best other rows of its label; a positive's negatives are the ``negatives``
    best rows of another label whose score lies within ``low`` and ``high`` percent of the positive's (none if that is
    negative). Ties go to the smaller id. Rows take no part with a null id, label or vector, or a null or non-finite
    component. Rows repeated in an id each count as candidates, but never for an anchor of that id; anchors repeated in full
    ask once. Vectors meet those of their own length only. Scores beyond 64 bits are held at the limits. Extra columns
    don't matter, whatever their names; no rows or no anchors: no rows.

    The anchors are a table in the shared folder that every task reads in blocks; no side is collected or broadcast.
    """
    spark = vectors.sparkSession
    asked_for = F.coalesce(anchors, F.lit(False)).alias("asked")
    label = F.col(label) if isinstance(label, str) else label
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled(F.col(vector_col), scale).alias("vector"), asked_for)
    clean = clean.filter("vec_id is not null and label is not null and vector is not null")
    with dropped(spark) as outlive:
        bands, n = banded(clean, band_rows)
        first = first or 2 * spark.sparkContext.defaultParallelism
        limits = lambda lo, hi: F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"), F.lit(None).cast("long").alias("worst"))
        asked = bands.filter("asked").select("vec_id", "label", "vector").distinct().withColumn("anchor", F.monotonically_increasing_id())
        asked = staged(asked.withColumn("slots", F.array(limits(F.lit(LEAST), F.lit(2**63 - 1)))), "negative-anchors")
        found = _searched(bands, n, asked, positives, True, first)
        near = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("near"))
        near = asked.drop("slots").join(near, "anchor")
        share = lambda x, percent: x["score"].cast("decimal(38,0)") * F.lit(percent) / F.lit(100)
        slots = F.transform("near", lambda x: limits(F.ceil(share(x, low)), F.floor(share(x, high))))
        asked = staged(near.withColumn("slots", slots), "negative-pairs")
        found = _searched(bands, n, asked, negatives, False, first)
        pairs = asked.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("near").alias("slot", "x"))
        named = found.join(pairs, ["anchor", "slot"])
        return outlive(named.select("anchor_id", F.col("x.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("x.score").alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
