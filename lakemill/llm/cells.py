"""A vector-approximation file in the shared folder, and exact top-k search over it (operator 7).

Equal vectors are one class. The file has a class's cells, a byte a component, beside the table of exact vectors; a search
scans the cells alone. The inner product of a query with the lowest corner of a cell, its base, is below the score by at
most a width that depends on the query alone, so bases bound scores on both sides. Exact vectors are read for the
candidates of highest bounds first, then for all whose bound reaches the kth score that these gave: then it is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.common import staged, tidy
from lakemill.llm.tokens import _open
from lakemill.llm.vectors import _product

#: Queries compared at once, cells compared with them at once, and bytes of cells that a task holds while it reads the queries.
QUERIES, BLOCK, HELD = 256, 8192, 1 << 26
#: So many times k candidates are read exactly first.
FIRST = 2


def classes(rows: DataFrame, k: int) -> DataFrame:
    """class, vector, ids (the k + 1 smallest, one of which may be the query's own) and one, the id of a class of one row; staged."""
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    found = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    found = found.withColumn("class", F.monotonically_increasing_id()).withColumn("one", F.when(F.size("ids") == 1, F.col("ids")[0]))
    return staged(found, "vector-classes")


def corners(found: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The lowest component and the cells' width of each place, by the vectors' length: two numbers a place reach the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for n, _, own in _by_length(b.column(0)):
                low, high = seen.get(n, (own.min(0), own.max(0)))
                seen[n] = [np.minimum(low, own.min(0)), np.maximum(high, own.max(0))]
        for n, (low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], ["n", "place", "low", "high"])

    sides = found.select("vector").mapInArrow(tidy(ends), "n int, place int, low long, high long")
    out: dict[int, tuple] = {0: ([], [])}  # vectors without components meet each other with a score of 0
    for x in sides.groupBy("n", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("n", "place").collect():
        out.setdefault(x.n, ([], []))
        out[x.n][0].append(x.low)
        out[x.n][1].append(max(1, -(-(x.high - x.low + 1) // 256)))
    return {n: (np.array(low, np.int64), np.array(step, np.int64)) for n, (low, step) in out.items()}


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of each length in a column of lists."""
    sizes = np.asarray(column.value_lengths())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, flat[starts[at][:, None] + np.arange(n)].reshape(len(at), n)


def cell_file(found: DataFrame, sides: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """class, one, n and cells (n bytes) of every class, staged."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, at, own in _by_length(b.column(2)):
                low, step = sides[n]
                cells = ((own - low) // step).astype(np.uint8)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(at), n, np.int32)), pa.array([x.tobytes() for x in cells], pa.binary())], ["class", "one", "n", "cells"])

    return staged(found.select("class", "one", "vector").mapInArrow(tidy(cut), "class long, one long, n int, cells binary"), "vector-cells")


def width_of(queries: np.ndarray, step: np.ndarray) -> np.ndarray:
    """How far a score may lie from its base: between ``down`` and ``up`` times the cells' widths less one; here their difference."""
    return np.abs(queries) @ (step - 1)


def scan(cells: DataFrame, asked: DataFrame, sides: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query, class and base of what each task cannot rule out: bases that reach the kth highest of its own, less the query's width."""
    files = asked.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for held in _held(batches):
            for uri in files:
                where, path = _open(uri)
                with where.open_input_file(path) as f:
                    for q in pq.ParquetFile(f).iter_batches(QUERIES, columns=["query", "vec_id", "vector"]):
                        yield from answers(q, held)

    def answers(q: pa.RecordBatch, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for n, at, queries in _by_length(q.column(2)):
            if n not in held:
                continue
            low, step = sides[n]
            own_ids, width = np.asarray(q.column(1))[at], width_of(queries, step)
            best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in at]
            for ids, many, ones, block in held[n]:
                base = _product(queries, low + block.astype(np.int64) * step)
                for row in range(len(at)):
                    mine = np.flatnonzero(many | (ones != own_ids[row]))
                    bases = np.concatenate([best[row][1], base[row, mine]])
                    keys = np.concatenate([best[row][0], ids[mine]])
                    if len(bases) > k:
                        fits = bases >= np.partition(bases, -k)[-k] - width[row]
                        keys, bases = keys[fits], bases[fits]
                    best[row] = keys, bases
            counts = [len(x[0]) for x in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(q.column(0))[at], counts)), pa.array(np.concatenate([x[0] for x in best])), pa.array(np.concatenate([x[1] for x in best]))], ["query", "class", "base"]
            )

    return cells.mapInArrow(tidy(run), "query long, class long, base long")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list]]:
    """The cells of a task by length, in blocks of (classes, whether of more rows than one, else the row's id, cells), as many at once as HELD allows."""
    held: dict[int, list] = {}
    size = 0
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            b = batch.slice(lo, BLOCK)
            ids, ns = np.asarray(b.column(0)), np.asarray(b.column(2))
            many, ones = b.column(1).is_null().to_numpy(zero_copy_only=False), b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            data = b.column(3)
            for n in np.unique(ns):
                at = np.flatnonzero(ns == n)
                own = np.frombuffer(b"".join(data[int(i)].as_py() for i in at), np.uint8).reshape(len(at), n)
                held.setdefault(int(n), []).append((ids[at], many[at], ones[at], own))
                size += own.size
            if size >= HELD:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _ranked(found: DataFrame, order: list[Column], most: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)


def exact(candidates: DataFrame, found: DataFrame, asked: DataFrame) -> DataFrame:
    """query, vec_id and score of the candidates' rows, from the exact vectors of their classes; a query's own id is left out."""
    joined = candidates.join(found.select("class", "vector", "ids"), "class").join(asked.select("query", F.col("vec_id").alias("own"), F.col("vector").alias("asked")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(len(b), np.int64)
            others = dict((n, (at, v)) for n, at, v in _by_length(b.column(2)))
            for n, at, v in _by_length(b.column(1)):
                out[at] = (v * others[n][1]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), b.column(3), b.column(4)], ["query", "score", "ids", "own"])

    scored = joined.select("query", "vector", "asked", "ids", "own").mapInArrow(tidy(score), "query long, score long, ids array<long>, own long")
    return scored.select("query", "own", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> own").drop("own")


def search_cells(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of each query. Both sides: vec_id and vector, of components whose products and their bounds fit 64 bits."""
    asked = staged(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    found = classes(rows, k)
    sides = corners(found)
    near = staged(scan(cell_file(found, sides), asked, sides, k), "vector-candidates")
    # a query's width again, by the JVM: what its bases may lie below its scores
    steps = F.create_map(*(x for n, (_, step) in sides.items() for x in (F.lit(n), F.array(*(F.lit(int(s - 1)) for s in step)).cast("array<bigint>")))) if sides else F.lit(None).cast("map<int,array<bigint>>")
    width = F.aggregate(F.zip_with("vector", F.try_element_at(steps, F.size("vector")), lambda x, s: F.abs(x) * s), F.lit(0).cast("long"), lambda a, x: a + x)
    up = F.aggregate(F.zip_with("vector", F.try_element_at(steps, F.size("vector")), lambda x, s: F.greatest(x, F.lit(0).cast("long")) * s), F.lit(0).cast("long"), lambda a, x: a + x)
    bounds = asked.select("query", F.coalesce(width, F.lit(0)).alias("width"), F.coalesce(up, F.lit(0)).alias("up"))
    kth = _ranked(near, [F.desc("base")], k).filter(F.col("rank") == k).select("query", F.col("base").alias("kth"))
    near = near.join(bounds, "query").join(kth, "query", "left").filter("kth is null or base >= kth - width")
    near = staged(near.withColumn("order", F.row_number().over(W.partitionBy("query").orderBy(F.desc("base"), "class"))).select("query", "class", "base", "order", "up"), "vector-candidates")
    first = staged(exact(near.filter(F.col("order") <= FIRST * k).select("query", "class"), found, asked), "vector-scores")
    certain = _ranked(first, [F.desc("score"), F.asc("vec_id")], k).filter(F.col("rank") == k).select("query", F.col("score").alias("certain"))
    rest = near.filter(F.col("order") > FIRST * k).join(certain, "query", "left").filter("certain is null or base + up >= certain").select("query", "class")
    best = _ranked(first.unionByName(exact(rest, found, asked)), [F.desc("score"), F.asc("vec_id")], k)
    return best.join(asked.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
