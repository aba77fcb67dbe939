import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lakemill.functions import sentiment, text
from lakemill.functions.keys import row_hash
import __spark_entry__ as entry
from lakemill.plans import catalogue, drilldowns, findings, operations
from lakemill.plans.dag import Run, Stage, execute
from lakemill.sources import control, landing
from lakemill.sources.lake import DuplicateKeys, LakeTable
from lakemill.streaming.refresh import affected, recompute, stream_into

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(x):
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


SQL = {**catalogue.ORACLES, **findings.ORACLES, **drilldowns.ORACLES, **operations.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = oracle.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_upserts_changes_and_time_travel(spark, tmp_path):
    def rows(*data):
        return spark.createDataFrame(data, "k int, v string").withColumn("hash", row_hash("v"))

    t = LakeTable(spark, str(tmp_path / "t"), ("k",))
    assert t.upsert(rows((1, "a"), (2, "b"), (None, "n")), ["k"], "hash") == {"inserted": 3, "updated": 0}
    assert t.upsert(rows((1, "a"), (2, "c"), (3, "d"), (None, "n")), ["k"], "hash", on_update={"run": F.lit("r2")}) == {"inserted": 1, "updated": 1}
    assert t.upsert(rows((3, "d")), ["k"], "hash") == {"inserted": 0, "updated": 0} and t.version() == 1
    assert {(x.k, x.v, x.run) for x in t.read().collect()} == {(1, "a", None), (2, "c", "r2"), (3, "d", None), (None, "n", None)}
    assert t.read(0).count() == 3
    assert sorted(x._change_type for x in t.changes(1).collect()) == ["insert", "update_postimage", "update_preimage"]
    assert {x.k for x in affected(t, "k", 0).collect()} == {2, 3}
    with pytest.raises(DuplicateKeys):
        t.upsert(rows((9, "x"), (9, "y")), ["k"], "hash")
    t.delete(F.col("k") == 1)
    t.update(F.col("k") == 2, {"v": F.lit("z")})
    assert {(x.k, x.v) for x in t.read().collect()} == {(2, "z"), (3, "d"), (None, "n")}
    t.restore(0)
    assert t.read().count() == 3 and t.history().count() == t.version() + 1 and t.detail()["version"] == t.version()


def test_incremental_equals_full(spark, tmp_path):
    source, target = LakeTable(spark, str(tmp_path / "s")), LakeTable(spark, str(tmp_path / "g"))
    sums = lambda df: df.groupBy("g").agg(F.sum("x").alias("x")).withColumn("hash", row_hash("x"))
    source.upsert(spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "id int, g string, x int"), ["id"])
    target.upsert(sums(source.read()), ["g"], "hash")
    source.upsert(spark.createDataFrame([(2, "a", 9), (4, "c", 4)], "id int, g string, x int"), ["id"])
    assert recompute(source, target, "g", 0, sums, ["g"], "hash") == {"inserted": 1, "updated": 1}
    assert sorted(map(tuple, target.read().collect())) == sorted(map(tuple, sums(source.read()).collect()))


def test_stream(spark, tmp_path):
    landed, t = str(tmp_path / "in"), LakeTable(spark, str(tmp_path / "t"))
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string").write.parquet(landed)
    stream_into(spark.readStream.schema("k int, n int, v string").parquet(landed), t, ["k"], [F.desc("n")], str(tmp_path / "c")).awaitTermination()
    assert {(x.k, x.v) for x in t.read().collect()} == {(1, "b"), (2, "c")}


def test_text_and_sentiment(spark):
    cases = {"[b]Good[/b] game": "Good game", "see https://a.b/c #now": "see now", "hi =====there": "hi there", "snake_case": "snake case", "": "", "♥♥": "fuck"}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string").select(text.clean_text(text.demojize(F.col("x"))).alias("got"), "want").collect()
    assert [x.got for x in got] == [x.want for x in got]
    s = lambda x: sentiment.score(x)[1]
    assert s("good") > 0 > s("not good") and s("very good") > s("good") and s("good!!") > s("good") and s("") == 0 and s("good but terrible") < 0


def test_queue_and_landing(spark, tmp_path):
    orchestrator = spark.createDataFrame([(1, "full", "High", "retry"), (2, "full", "Low", "completed"), (3, "full", "Medium", "pending")], "app_id int, load_type string, priority string, load_status string")
    columns = "app_id int, execution_type string, execution_id string, execution_start_time int, execution_status string, first_retrieved_timestamp long, last_retrieved_cursor string"
    executions = spark.createDataFrame([(1, "full", "e1", 1, "success", 100, "abc"), (1, "full", "e2", 2, "failed", 50, "*"), (2, "full", "e3", 1, "success", 7, "x")], columns)
    got = {x.app_id: x for x in control.work_queue(orchestrator, executions).collect()}
    assert [got[i].priority_order for i in (1, 2, 3)] == [-1, 99, 2] and [got[i].last_retrieved_cursor for i in (1, 2, 3)] == ["abc", "*", "*"] and got[1].high_water_mark == 100
    pages = {"*": ("p2", [{"timestamp_created": 9}]), "p2": ("p3", [{"timestamp_created": 5}])}
    assert [c for c, _ in landing.cursor_pages(lambda c: (200, pages[c]), mark=5)] == ["p2"]
    with pytest.raises(landing.Forbidden):
        landing.with_retries(lambda: (403, None))
    folder = tmp_path / "run" / "exec7"
    folder.mkdir(parents=True)
    (folder / "batch_1.json").write_text('[{"recommendationid": "1", "review": "ok", "votes_funny": 4294967295, "votes_up": 3, "author": {"steamid": "s"}}, {"recommendationid": null, "review": "x"}]')
    raw = landing.read_batches(spark, [str(folder)])
    assert raw.first().execution_id == "exec7"
    row = landing.parsed_reviews(raw).collect()
    assert len(row) == 1 and (row[0].votes_funny, row[0].votes_up, row[0].reaction_type_count) == (0, 3, 0)


def test_dag():
    tries = []
    stages = [Stage("a", lambda r: tries.append(1) or (1 / (len(tries) - 1)), retries=1), Stage("b", lambda r: 2, when=lambda r: False), Stage("c", lambda r: r.results["a"])]
    assert execute(stages, Run()).results == {"a": 1.0, "c": 1.0}
