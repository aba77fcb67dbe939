"""Exact top-k inner-product search with a vector-approximation file (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.common import staged
from lakemill.llm.tokens import _open

#: Queries compared with a partition's vectors at once, and vectors of a partition at once, where components are large.
QUERIES, VECTORS = 256, 16_384


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null unless all are finite numbers."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: by floating point while sums stay below 2 ** 53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 2**53 else a @ b.T


def _large(vectors: np.ndarray) -> np.ndarray:
    """Whether a vector has a component so large that products of two such vectors, or their bounds, might leave 64 bits."""
    return (np.abs(vectors.astype(float)) > math.isqrt(2**60 // max(vectors.shape[1], 1))).any(1)


def _search_large(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, vec_ids, scores) of the k best of each query, ties to smaller ids, by integers of any size; scores beyond 64 bits are held at their limits."""
    exact = vectors.astype(object)
    for row, query in enumerate(queries.astype(object)):
        scores = np.clip(exact @ query, -(2**63), 2**63 - 1).astype(np.int64)
        mine = np.flatnonzero(query_ids[row] != ids)
        # ~x turns the order of all 64-bit numbers round, -x not that of the least
        mine = mine[np.lexsort((ids[mine], ~scores[mine]))[:k]]
        yield row, ids[mine], scores[mine]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best of ``vectors``, its own id left out.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite component take no part;
    ids too if null. A query meets vectors of its own length only. Ties go to the smaller id; repeated rows each
    count. Components and scores beyond 64 bits are held at its limits. Further columns don't matter, whatever their names.
    No vectors or queries: no rows.

    The search scans a file of cells (``cells``); if any component is so large that bounds might leave 64 bits, all scores
    are computed instead, by wide integers, in tasks that read the queries in blocks. Neither side is collected or broadcast.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vector")).filter("vec_id is not null and vector is not null")
    rows, asked = clean(vectors), clean(queries)
    most = lambda df: df.agg(F.max(F.size("vector")).alias("n"), F.max(F.array_max(F.transform("vector", lambda x: F.greatest(F.abs(x.cast("double")), F.lit(0.0))))).alias("top")).first()
    ends = [x for x in (most(rows), most(asked)) if x.n is not None]
    if len(ends) == 2 and all((x.top or 0) <= math.isqrt(2**60 // max(x.n, 1)) for x in ends):
        from lakemill.llm.cells import search_cells

        return search_cells(rows, asked, k)
    listed = staged(asked, "queries")
    files = listed.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for whole in batches:
            for lo in range(0, len(whole), VECTORS):
                b = whole.slice(lo, VECTORS)
                ids, sizes = np.asarray(b.column(0)), np.asarray(b.column(1).value_lengths())
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                blocks = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
                blocks = {n: (ids[at], flat[starts[at][:, None] + np.arange(n)].reshape(len(at), n)) for n, at in blocks.items()}
                for uri in files:
                    where, path = _open(uri)
                    with where.open_input_file(path) as f:
                        for q in pq.ParquetFile(f).iter_batches(QUERIES):
                            yield from _batch(q, blocks)

    def _batch(q: pa.RecordBatch, blocks: dict) -> Iterator[pa.RecordBatch]:
        q_ids, q_sizes = np.asarray(q.column(0)), np.asarray(q.column(1).value_lengths())
        values = q.column(1).to_pylist()
        for n, (ids, vectors) in blocks.items():
            at = np.flatnonzero(q_sizes == n)
            if not len(at):
                continue
            asked = np.asarray([values[x] for x in at], np.int64).reshape(len(at), n)
            found = [(np.full(len(x), q_ids[at[row]]), x, s) for row, x, s in _search_large(ids, vectors, q_ids[at], asked, k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    near = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    # each task ranks what it has of a query before it is sent
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
