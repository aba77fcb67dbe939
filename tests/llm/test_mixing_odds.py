"""Inclusion frequencies of the Pareto sample, and odd rows of the mix."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lakemill.llm.mixing import mix, mixed


def test_inclusion_frequencies(spark):
    """Documents of one size with emphasis 1, 2 and 4: over many seeds each is taken as often as its inclusion probability."""
    rows = [(i, "w " * 10, "s", float((1, 2, 4)[i % 3])) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, e double")
    taken, seeds = Counter(), 6
    for seed in range(seeds):
        for x in mix(docs, weights=(1,), share=0.4, seed=f"s{seed}", emphasis=F.col("e")).collect():
            taken[x["doc_id"] % 3] += x["copies"]
            assert x["copies"] in (0, 1) and math.isclose(x["target"], 720)
    # 720 words: 72 documents; scale * (1 + 2 + 4) * 60 = 72
    for kind, weight in enumerate((1, 2, 4)):
        want = 72 / 420 * weight
        assert abs(taken[kind] / (60 * seeds) - want) < 5 * math.sqrt(want * (1 - want) / (60 * seeds)) + 0.01


def test_certain_inclusion(spark):
    """An emphasis so large that its inclusion is certain: always taken; one of zero or null: last."""
    rows = [(i, "w " * 10, "s", 1000.0 if i < 5 else 0.0 if i < 8 else None if i < 10 else 1.0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, e double")
    got = {x["doc_id"]: x["copies"] for x in mix(docs, weights=(1,), share=0.5, emphasis=F.col("e")).collect()}
    assert sum(got.values()) == 20 and all(got[i] == 1 for i in range(5)) and not any(got[i] for i in range(5, 10))


def test_odd_rows(spark):
    data = [(1, "a b", None), (1, "a b", None), (2, None, "x"), (None, "c " * 9, "x"), (3, "c " * 9, "x"), (4, "", "y"), (5, " \n\t", "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "0 as size", "0 as rank", "0 as u", "0 as level", "0 as row", "0 as copies", "0 as quota")
    got = mix(docs).collect()
    assert Counter((x["doc_id"], x["size"], x["source_size"]) for x in got) == Counter({(1, 2, 4): 2, (2, 0, 18): 1, (None, 9, 18): 1, (3, 9, 18): 1, (4, 0, 0): 1, (5, 0, 0): 1})
    sums = Counter()
    for x in got:
        sums[x["source"]] += x["taken"]
        assert 0 <= x["taken"] <= 2 * x["size"]
    # weights 3 (x), 1 (y), 2 (null); 33 words: x stops at its share of 33 * 3 / 5 or 36, null stops at 8
    assert sums[None] == 8 and sums["y"] == 0 and abs(sums["x"] - 25) <= 9
    rows = mixed(docs)
    assert rows.columns == docs.columns
    want = Counter()
    for x in got:
        want[x["doc_id"]] += x["copies"]
    assert Counter(x["doc_id"] for x in rows.collect()) == +want
    assert mix(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id")))
    assert sorted(x["taken"] for x in mix(named).collect())[-1] > 0
