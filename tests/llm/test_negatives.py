"""Hard negatives against brute force: over many bands and waves, with ties, odd rows and large components."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lakemill.llm import negatives
from lakemill.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>, label long"


def brute(rows, is_anchor, p=5, n=10, low=30, high=90):
    clean = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked, out = {(i, tuple(v), y) for i, v, y in clean if is_anchor(i)}, []
    for a, q, label in asked:
        scored = sorted((-sum(x * z for x, z in zip(q, v, strict=True)), i, y) for i, v, y in clean if i != a and len(v) == len(q))
        for s, i, _ in [x for x in scored if x[2] == label][:p]:
            fits = [(-t, j) for t, j, y in scored if y != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, i, k, j, -s, t) for k, (t, j) in enumerate(fits[:n], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dims) * rng.choice([0.05, 0.3, 1.0, 4.0])).round(2).tolist(), int(rng.integers(3))) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 3) for i in range(40)]


def test_many_bands_and_waves(spark):
    rows = vectors(900, 6, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for band, first in ((60, 1), (5000, 8)):
        found = negatives.hard_negatives(df, F.col("vec_id") % 30 == 0, band_rows=band, first=first)
        assert got(found) == brute(rows, lambda i: i % 30 == 0)


def test_buckets_below_the_window_are_passed_over(monkeypatch):
    asked = []
    monkeypatch.setattr(negatives, "products", lambda a, b, real=negatives.products: asked.append(len(a) * len(b)) or real(a, b))
    rng = np.random.default_rng(2)
    block = lambda scale, at: (np.arange(at, at + 50), np.zeros(50, np.int64), (v := (rng.normal(size=(50, 8)) * scale).astype(np.int64)), float(np.sqrt((v.astype(float) ** 2).sum(1)).max()))
    buckets = [block(1000, 0), block(100, 50), block(1, 100)]
    slots = [[negatives.Slot(10_000_000, 2**63 - 1, None, 3)]]
    negatives.search(buckets, np.array([999]), np.array([1]), np.full((1, 8), 2000), slots, False)
    assert asked == [50]  # later buckets can't reach the window's lower limit
    assert all(s >= 10_000_000 for s in slots[0][0].scores)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, [0.0, 0.0], 2), (300, [-1.0, -2.0], 1), (5, [1.0, 1.5], 1), (6, [0.5, 1.0], 2), (6, [0.5, 1.0], 2), (7, [0.4, 1.0], 3),
            (8, None, 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 2), (11, [None, 1.0], 2), (12, [1.0], 1), (13, [], 1), (None, [1.0, 1.0], 1), (14, [1.0, 1.0], None), (400, [3.0], 4), (100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("band", F.lit(1))
    clean = [r for r in rows if r[0] is None or r[2] is None or r[1] is None or None not in r[1]]
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == brute(clean, lambda i: i % 100 == 0)
    assert negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_scores_beyond_the_exact_floats(spark):
    rng = random.Random(4)
    made = lambda top: [(i, [rng.uniform(-1, 1) * top for _ in range(4)], i % 2) for i in range(60)]
    rows = made(2.0**22)  # scores near 2 ** 61, held by integers of any size
    found = got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    assert found == brute(rows, lambda i: i % 10 == 0) and max(r[4] for r in found) > 2**59
    assert negatives.hard_negatives(spark.createDataFrame(made(2.0**60), SCHEMA), F.col("vec_id") % 10 == 0).count() >= 0


def test_whole_table(spark):
    rows = duckdb.sql("select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end from '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    assert got(Q.QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001")) == brute(rows, lambda i: i % 100 == 0)
