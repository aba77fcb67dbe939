"""Groups of close copies that are joined only by links a little above the threshold."""

import random

import pytest

from lakemill.llm import neardup


def two_groups(size, seed):
    """``size`` copies of a text and of its variant with 16 of 200 words replaced; each has an own last word: 0.835 across, 0.99 within."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**9)}" for _ in range(199)]
    other = [*words[:90], *(f"v{rng.randrange(10**9)}" for _ in range(16)), *words[106:]]
    return [" ".join([*x, f"e{rng.randrange(10**9)}"]) for x in (words, other) for _ in range(size)]


def joined(texts, percent=80):
    """The least number of each text's component, by brute force over two-word shingles."""
    sets = [set(zip(x.split(), x.split()[1:])) for x in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(sets))}


def found(spark, texts, **options):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(table, shingle=2, **options).collect()}


def test_weak_links_between_groups(spark):
    texts = [t for size, n in ((5, 12), (50, 4)) for seed in range(n) for t in two_groups(size, 1000 * size + seed)]
    want = joined(texts)
    assert len(set(want.values())) == 16
    assert found(spark, texts) == want


def test_weak_links_between_large_groups(spark):
    assert set(found(spark, two_groups(5000, 1)).values()) == {0}


def test_large_regions(spark):
    """Documents with much boilerplate in regions that are dealt out: many components, links between 0.8 and 0.9."""
    rng = random.Random(3)
    notice = [f"n{rng.randrange(10**9)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        own = [f"o{rng.randrange(10**9)}" for _ in range(35)]
        for k in range(5):
            texts.append(" ".join([*notice, *own[: 35 - 7 * k], *(f"p{rng.randrange(10**9)}" for _ in range(7 * k))]))
    texts = [t for t in texts if rng.random() < 0.7]
    want = joined(texts, 85)
    assert len(set(want.values())) > 20
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert found(spark, texts, percent=85, hot=40, leaf=1 << 20) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_crowded_regions(spark):
    """Families among documents that share half of their words, in regions that are split to full depth: recall of links."""
    rng = random.Random(4)
    notice = [f"n{rng.randrange(10**9)}" for _ in range(100)]
    texts = []
    for _ in range(400):
        own = [f"o{rng.randrange(10**9)}" for _ in range(90)]
        texts.append(" ".join([*notice, *own]))
        texts.append(" ".join([*notice, *own[:70], *(f"p{rng.randrange(10**9)}" for _ in range(20))]))
    want = joined(texts)
    assert len(set(want.values())) == 400
    for options in ({"leaf": 8}, {"leaf": 8, "hot": 16}):
        got = found(spark, texts, **options)
        assert all(got[i] in (want[i], i) for i in got)  # no false link
        assert sum(got[i] == want[i] for i in range(1, 800, 2)) >= 0.97 * 400


def test_spanning():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (2, 5, 60, 300):
        i, j = rng.integers(0, n, 4 * n), rng.integers(0, n, 4 * n)
        i, j = i[i != j], j[i != j]
        at = neardup.spanning(i, j, rng.integers(0, 5, len(i)).astype(np.float32), n)

        def parts(edges):
            label = np.arange(n)
            for _ in range(n):
                for x, y in edges:
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
            return label.tolist()

        assert parts(list(zip(i[at].tolist(), j[at].tolist()))) == parts(list(zip(i.tolist(), j.tolist()))) if n < 100 else len(at) < n
