"""Each stage of the pipeline on odd rows, on an empty table and with clashing columns; two of them against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lakemill.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, target double"
GOOD = " ".join(f"word{k}" for k in range(80))
OTHER = " ".join(f"term{k}" for k in range(90))


def odd(spark):
    rows = [
        (1, GOOD, "en", "a", 0, "k", 1, 0.5), (1, GOOD, "en", "a", 0, "k", 1, 0.5), (1, GOOD, "en", "b", 0, "z", 9, 0.5), (2, GOOD + " end", "en", None, None, None, None, None),
        (None, OTHER, None, None, 5, "x", 2, 1.0), (3, None, "de", "a", None, "", 3, None), (4, "", "de", "a", 0, "", 3, None), (5, " \n\t", "de", "b", 3, "y", 4, None),
        (6, " ".join(f"long{k}" for k in range(120_000)), "fr", "c", 1, "q", 5, 2.0), (7, "short text", "en", "a", 10, "r", 6, 3.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def stage(name):
    return dict(P.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_tables(spark, name):
    got = stage(name)(spark, odd(spark).filter("false"), SF)
    assert got.count() == 0 and (name == "packing" or got.columns == odd(spark).columns)


def test_quality_rules(spark):
    got = stage("quality_rules")(spark, odd(spark), SF)
    assert got.columns == odd(spark).columns
    assert sorted((x.doc_id or 0, x.source or "", x.key or "") for x in got.collect()) == [(0, "", "x"), (1, "a", "k"), (1, "a", "k"), (1, "b", "z"), (2, "", ""), (6, "c", "q")]


def test_near_duplicates(spark):
    runs = [sorted(map(str, stage("near_duplicates")(spark, odd(spark).repartition(n), SF).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]  # the same row of the repeated ones, however they come
    kept = stage("near_duplicates")(spark, odd(spark), SF).collect()
    assert Counter(x.doc_id for x in kept) == Counter([1, None, 3, 4, 5, 6, 7])
    assert next(x for x in kept if x.doc_id == 1).source == "a"


def test_suffix_dedup_by_brute_force(spark):
    got = stage("suffix_dedup")(spark, odd(spark), SF).collect()
    texts = [x.text or "" for x in odd(spark).collect()]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    left = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        left.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    assert Counter(x.text for x in got) == Counter(left)
    assert all(x.n_chars == len(x.text) for x in got) and Counter(x.doc_id for x in got) == Counter(x.doc_id for x in odd(spark).collect())


def test_mixing_by_counting(spark):
    docs = Q.table(spark, SF, "documents")
    got = stage("mixing")(spark, docs, SF)
    times = Counter(x.doc_id for x in got.select("doc_id").collect())
    assert max(times.values()) <= 2
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    taken = {x.source: x.n for x in got.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    plan = {x.source: (x.target, x.most) for x in Q.op4_mixing(spark, SF).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    assert all(abs(taken[s] - t) <= most for s, (t, most) in plan.items())
    again = Counter(x.doc_id for x in stage("mixing")(spark, docs.repartition(7), SF).select("doc_id").collect())
    assert again == times
    odd_rows = stage("mixing")(spark, odd(spark), SF)
    assert odd_rows.columns == odd(spark).columns and odd_rows.count() >= 1


def test_packing_deals_repeated_rows_evenly(spark):
    from lakemill.llm.packing import pack

    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = pack(rows, 16, group=500)
    by_task = [x["count"] for x in got.groupBy((F.col("sequence_id").bitwiseAND(F.lit(-(1 << 40)))).alias("t")).count().collect()]
    assert len(by_task) == 8 and max(by_task) <= 520 and got.select("sequence_id").distinct().count() <= 4000 / 16 + 8
    odd_rows = stage("packing")(spark, odd(spark), SF).collect()
    assert Counter(x.doc_id for x in odd_rows if x.piece == 0) == Counter(x.doc_id for x in odd(spark).collect())
