"""Lake tables: atomic commits, rewriting of touched files alone, late rows, the feed as a source and as a stream."""

import pytest
from pyspark.sql import functions as F

from lakemill.functions.keys import row_hash
from lakemill.sources import feed
from lakemill.sources.lake import ConcurrentWrite, LakeTable
from lakemill.streaming import refresh


@pytest.fixture(autouse=True)
def several_files(spark):
    """Small tables, too, are written as several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def data_files(table, version=None):
    return {x[0]: x[1] for x in table._files(table._known(version)).select("file", "rows").collect()}


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string").withColumn("h", row_hash("v"))


def rows(df):
    return sorted(tuple(x) for x in df.select("k", "v").collect())


def test_a_crash_before_the_rename_leaves_no_commit(spark, tmp_path, monkeypatch):
    t = LakeTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(3))
    (tmp_path / "t/log/.1-half").write_text('{"version":')  # a writer died
    (tmp_path / "t/log/1.json.tmp").write_text("")
    assert t.version() == 0 and t.read().count() == 3
    t.append(spark.range(3, 4))
    assert t.version() == 1 and t.read().count() == 4
    with pytest.raises(ConcurrentWrite):
        t._publish(1, '{"name": "late"}')
    assert t._entry(1)["operation"] == "APPEND"


@pytest.mark.parametrize("act", ["append", "overwrite"])
def test_sources_are_evaluated_once(spark, tmp_path, act):
    t = LakeTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(2).withColumn("v", F.lit("old")))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    source = spark.range(5, 10, 1, 1).mapInPandas(count, "id long").withColumn("v", F.uuid())
    getattr(t, act)(source)
    assert seen.value == 5
    new = {(x.id, x.v) for x in t.changes(1).filter("_change_type = 'insert'").collect()}
    assert new == {(x.id, x.v) for x in t.read().filter("id >= 5").collect()}


def test_an_upsert_of_one_key_leaves_other_files_in_place(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"), ("k",))
    t.upsert(keyed(spark, [(k, f"v{k}") for k in range(400)]).repartition(4), ["k"], "h")
    before = data_files(t)
    assert len(before) >= 3
    assert t.upsert(keyed(spark, [(7, "new"), (1000, "x"), (9, "v9")]), ["k"], "h") == {"inserted": 1, "updated": 1}
    after = data_files(t)
    assert len(set(before) - set(after)) == 1 and len(set(before) & set(after)) == len(before) - 1
    assert rows(t.read()) == sorted([(k, "new" if k == 7 else f"v{k}") for k in range(400)] + [(1000, "x")])
    changed = sorted((x._change_type, x.k, x.v) for x in t.changes(1).collect())
    assert changed == [("insert", 1000, "x"), ("update_postimage", 7, "new"), ("update_preimage", 7, "v7")]
    assert t.history().filter("version = 1").first().metrics["files_kept"] == len(before) - 1
    assert t.upsert(keyed(spark, [(7, "new")]), ["k"], "h") == {"inserted": 0, "updated": 0} and t.version() == 1
    # an insert alone, and nulls among the keys, rewrite nothing
    t.upsert(keyed(spark, [(None, "none")]), ["k"], "h")
    assert set(after) < set(data_files(t))
    assert t.upsert(keyed(spark, [(None, "some")]), ["k"], "h") == {"inserted": 0, "updated": 1}
    assert t.read(1).count() == 401 and rows(t.read().filter("k is null")) == [(None, "some")]


def test_deletes_updates_and_restores_touch_their_files_alone(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"), ("k",))
    t.overwrite(keyed(spark, [(k, f"v{k}") for k in range(200)]).repartition(4))
    before = data_files(t)
    t.delete(F.col("k") == 3)
    assert len(set(before) & set(data_files(t))) == len(before) - 1
    t.update(F.col("k") == 5, {"v": F.concat("v", F.lit("!"))})
    assert t.read().filter("k = 5").first().v == "v5!" and t.read().count() == 199
    t.delete_keys(spark.createDataFrame([(8,), (999,)], "k long"), ["k"])
    version = t.version()
    assert t.read().count() == 198 and t.delete_keys(spark.createDataFrame([(999,)], "k long"), ["k"]) == version
    t.restore(0)
    assert data_files(t) == before and t.read().count() == 200
    t.append(spark.createDataFrame([(500, "x", 1.5)], "k int, v string, more double"))
    got = t.read().filter("k >= 199").orderBy("k").collect()
    assert [x.more for x in got] == [None, 1.5] and dict(t.read().dtypes)["k"] == "bigint"
    t.optimize(1)
    assert t.read().count() == 201 and t.detail()["files"] >= 1


def test_late_rows(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "k long, v string, at long").withColumn("h", row_hash("v"))
    for newer, want in ((None, "late"), ("at", "now")):
        t = LakeTable(spark, str(tmp_path / f"t{newer}"))
        t.upsert(made([(1, "now", 10), (2, "none", None)]), ["k"], "h", newer=newer)
        t.upsert(made([(1, "late", 5), (2, "some", 3)]), ["k"], "h", newer=newer)
        got = dict(rows(t.read()))
        assert got == {1: want, 2: "some"}
        t.upsert(made([(1, "last", 11), (2, "void", None)]), ["k"], "h", newer=newer)
        assert dict(rows(t.read())) == {1: "last", 2: "some" if newer else "void"}


def test_the_feed_as_a_source(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"))
    t.upsert(keyed(spark, [(1, "a"), (2, "b")]).withColumn("at", F.timestamp_seconds(F.lit(1))), ["k"], "h")
    t.upsert(keyed(spark, [(2, "c"), (3, "d")]).withColumn("more", F.array(F.lit(1))), ["k"], "h")
    t.delete(F.col("k") == 1)
    feed.register(spark)
    for start in (0, 1, 2):
        got = spark.read.format("lake_changes").option("path", t.path).option("startingVersion", start).load()
        want = t.changes(start)
        names = sorted(want.columns)
        assert sorted(map(str, got.select(*[c for c in got.columns if c in names]).select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    feed.changes_view(spark, "feed_of_t", t.path, 1)
    assert spark.sql("select count(*) from feed_of_t where _change_type = 'delete'").first()[0] == 1
    feed.changes_view(spark, "feed_of_t", t.path, 0, 0)
    assert spark.sql("select count(*) from feed_of_t").first()[0] == 2
    assert spark.read.format("lake_changes").option("path", t.path).option("startingVersion", 9).load().count() == 0


def test_one_scan_however_many_versions(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"))
    size = lambda: t.changes()._jdf.queryExecution().analyzed().toString().count("Relation")
    t.overwrite(spark.range(1))
    first = size()
    for k in range(6):
        t.append(spark.range(k, k + 1))
    assert size() == first and t.changes().count() == 7


def test_a_stream_of_changes_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    source, target = LakeTable(spark, str(tmp_path / "s")), LakeTable(spark, str(tmp_path / "g"))
    run = lambda: refresh.follow(source, target, ["k"], str(tmp_path / "checkpoint"))
    source.upsert(keyed(spark, [(1, "a"), (2, "b"), (3, "c")]), ["k"], "h")
    run().awaitTermination()
    assert rows(target.read()) == rows(source.read())
    source.upsert(keyed(spark, [(2, "x"), (4, "d")]), ["k"], "h")
    source.delete(F.col("k") == 1)
    # killed between the upsert and the delete of its batch
    monkeypatch.setattr(LakeTable, "delete_keys", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    monkeypatch.undo()
    version = target.version()
    run().awaitTermination()
    assert rows(target.read()) == rows(source.read()) == [(2, "x"), (3, "c"), (4, "d")]
    assert target.history().filter(f"version > {version}").filter("operation = 'MERGE'").count() == 0  # the upsert wasn't repeated
    run().awaitTermination()
    source.overwrite(keyed(spark, [(9, "z")]))
    run().awaitTermination()
    assert rows(target.read()) == [(9, "z")]
