"""The search over a file of cells: exact against brute force with crowds of equal vectors, and reading few exact vectors."""

import numpy as np
from pyspark.sql import functions as F

from lakemill.llm import cells, vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k, scale=1024):
    whole = [(i, np.floor(np.array(v) * scale).astype(np.int64).tolist()) for i, v in rows]
    out = []
    for q, v in [x for x in whole if asked(x[0])]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(x) for x in df.collect())


def test_crowds_of_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[100][1]) for i in range(300)] + [(900 + i, [5.0] * 8) for i in range(200)] + [(2000, [1.0, 2.0]), (2100, [0.5, 1.0]), (2200, []), (2300, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k in (1, 7):
        assert got(vectors.exact_top_k(df, df.filter("vec_id % 100 = 0"), k)) == brute(rows, lambda i: i % 100 == 0, k)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=32) / 6).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    read = []
    monkeypatch.setattr(cells, "exact", lambda c, f, a, real=cells.exact: read.append(c.count()) or real(c, f, a))
    assert got(vectors.exact_top_k(df, df.filter("vec_id % 300 = 0"), 10)) == brute(rows, lambda i: i % 300 == 0, 10)
    assert sum(read) < 0.05 * 10 * len(rows)  # of ten queries against all


def test_cells_bound_scores():
    rng = np.random.default_rng(3)
    own, queries = rng.integers(-500, 500, (200, 16)), rng.integers(-500, 500, (20, 16))
    low = own.min(0)
    step = np.maximum(1, -(-(own.max(0) - low + 1) // 256))
    base = queries @ (low + (own - low) // step * step).T
    score = queries @ own.T
    up = np.maximum(queries, 0) @ (step - 1)
    assert (score <= base + up[:, None]).all() and (score >= base + up[:, None] - cells.width_of(queries, step)[:, None]).all()


def test_large_components_are_scored_in_full(spark):
    rows = [(0, [2.0**40, 1.0]), (100, [-(2.0**40), 3.0]), (1, [1.0, 1.0]), (2, [2.0**40, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    found = {(x[0], x[1]): x[2] for x in got(vectors.exact_top_k(df, df.filter("vec_id % 100 = 0"), 2))}
    assert found[0, 1] == 2 and found[100, 1] == 1
