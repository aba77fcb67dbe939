"""Ranks of crowded keys, and views that are computed once."""

import shutil
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lakemill.operators import ranks, scoring
from lakemill.plans import proxy
from lakemill.plans.views import VIEWS
from lakemill.sources.shared import Views, source_version

SF = "/root/testdata/sf0.001"


def test_counted_ranks_equal_the_window(spark):
    rows = [(k % 3 if k % 7 else 0, None if k % 11 == 0 else (k * 37) % 23, k) for k in range(900)] + [(None, 5, 1000), (9, 1, 1001), (8, None, 1002), (8, None, 1003)]
    df = spark.createDataFrame(rows, "key long, value long, id long").repartition(7)
    want = df.withColumn("p", ranks.window_rank("key", "value"))
    got = ranks.with_counted_ranks(df, "key", "value", "p")
    assert sorted(map(str, got.select("id", "p").collect())) == sorted(map(str, want.select("id", "p").collect()))


def test_a_crowded_game_is_dealt_over_tasks(spark):
    reviews = proxy.reviews(spark, SF)
    third = reviews.withColumn("game_key", F.when(F.xxhash64("review_key") % 3 == 0, 1).otherwise(F.col("game_key")))
    third = third.withColumn("playtime", F.when(F.xxhash64("review_key") % 7 != 0, F.col("playtime")))
    columns = ["review_key", *(F.round(c, 9).alias(c) for c in ("influence", "playtime_signal", "community_signal", "length_signal"))]
    plain = scoring.influence(third)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = scoring.influence(third, hot=500)
        assert sorted(map(str, dealt.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
        sizes = [x["count"] for x in dealt.filter("game_key = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_views_are_computed_once_until_their_tables_change(spark, tmp_path):
    shutil.copy(f"{SF}/region.parquet", tmp_path / "region.parquet")
    made, views = [], Views()
    views.add("a", ("region",))(lambda s, folder: made.append("a") or s.read.parquet(f"{folder}/region.parquet"))
    views.add("b", views=("a",))(lambda s, folder, v: made.append("b") or v["a"].filter("r_regionkey > 1"))
    views.add("c", views=("b",), kept=False)(lambda s, folder, v: v["b"].select("r_name"))
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda _: views.get(spark, str(tmp_path), "c").count(), range(4)))
    assert len(set(counts)) == 1 and sum("region.parquet" in f for f in views.get(spark, str(tmp_path), "c").inputFiles()) == 0
    before = source_version(spark, [str(tmp_path)])
    spark.read.parquet(f"{SF}/region.parquet").limit(2).coalesce(1).write.parquet(str(tmp_path / "two"))
    shutil.copy(next((tmp_path / "two").glob("part-*")), tmp_path / "region.parquet")
    assert source_version(spark, [str(tmp_path)]) != before
    assert views.get(spark, str(tmp_path), "a").count() == 2
    assert views.create(spark, str(tmp_path), "v_") == ["v_a", "v_b", "v_c"] and spark.table("v_a").count() == 2
    try:
        views.add("d", views=("missing",))
    except KeyError as e:
        assert "missing" in str(e)


def test_no_drilldown_computes_influence_again(spark):
    import __spark_entry__ as entry

    VIEWS.get(spark, SF, "scores")
    for name in ("golden_zone_drilldown", "genre_drilldown", "sentiment_drilldown", "best_reviews_of_top_games"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "percent_rank" not in plan and "l_orderkey" not in plan
