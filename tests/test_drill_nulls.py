"""Games without a score come last in every order of games, as in SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unscored(spark, tmp_path_factory):
    """The smallest tables, where every seventh game has no eligible review and so no alignment."""
    folder = str(tmp_path_factory.mktemp("unscored"))
    for name in ("part", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "lineitem":
            rows = rows.withColumn("l_returnflag", F.when(F.col("l_partkey") % 7 == 0, "N").otherwise(F.col("l_returnflag")))
        rows.write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for f in os.listdir(SF):
        own = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{SF}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{own}'")
    return folder, con


def plain(x):
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def same(spark, unscored, name):
    folder, con = unscored
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert want and sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", ["alignment_negative_listed", "alignment_positive_listed"])
def test_listed_games_have_an_alignment(spark, unscored, name):
    same(spark, unscored, name)


@pytest.mark.parametrize("name", ["misaligned_reviews", "aligned_reviews"])
def test_reviews_are_of_games_with_an_alignment(spark, unscored, name):
    same(spark, unscored, name)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Every review three times under shifted order keys, so influences tie; games without an alignment pass the limit of reviews by their copies alone."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_partkey % 7 <> 0 or l_linenumber <= 3")
    rows = rows.withColumn("l_returnflag", F.when(F.col("l_partkey") % 7 == 0, "N").otherwise(F.col("l_returnflag")))
    rows.crossJoin(spark.range(3)).withColumn("l_orderkey", F.col("l_orderkey") + 150000 * F.col("id")).drop("id").write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    for name in ("events", "customer"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["misaligned_reviews", "aligned_reviews"])
def test_repeated_reviews(spark, repeated, name):
    folder, con = repeated
    most = con.execute("select max(n) from (select count(*) as n from lineitem where l_partkey % 7 = 0 group by l_partkey)").fetchone()[0]
    assert 25 <= most < 3 * 25  # ranked by their copies alone
    same(spark, repeated, name)
