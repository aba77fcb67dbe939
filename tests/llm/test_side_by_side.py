"""Queries side by side in one driver, and two runs of the pipeline: each keeps its own scratch tables."""

from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from lakemill.llm import common
from lakemill.llm import queries as Q

SF = "/root/testdata/sf0.001"


def digest(df):
    return sorted(map(str, df.collect()))


def test_queries_in_threads_give_what_each_gives_alone(spark):
    names = ["op10_near_duplicates", "op5_repeats", "op9_licenses", "op7_top_k"]
    alone = {x: digest(Q.QUERIES[x](spark, SF)) for x in names}
    with ThreadPoolExecutor(4) as pool:
        beside = dict(zip(names, pool.map(lambda x: digest(Q.QUERIES[x](spark, SF)), names), strict=True))
    assert beside == alone


def test_a_second_pipeline_run_leaves_the_first_as_it_is(spark):
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    assert digest(first) == digest(second)


def test_scopes_nest_and_keep_what_outlives(spark):
    with common.dropped(spark) as outer:
        with common.dropped(spark) as inner:
            gone = common.staged(spark.range(3), "gone").inputFiles()[0]
            kept = inner(spark.range(4), "kept")
        assert kept.count() == 4
        last = outer(spark.range(5), "last")
    there = lambda file: spark._jvm.java.io.File(file.removeprefix("file://")).exists()
    assert last.count() == 5 and there(last.inputFiles()[0])
    assert not there(gone) and not there(kept.inputFiles()[0])
