"""Sources and sinks beside the lake table, two writers, load types."""

import threading

import pytest
from pyspark.sql import functions as F

from lakemill.functions.keys import row_hash
from lakemill.sources import tables as T
from lakemill.sources.lake import ConcurrentWrite, LakeTable


def test_two_writers(spark, tmp_path):
    """Two tables of one path commit the same version: one fails and harms nothing."""
    t = LakeTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(3))
    a, b = LakeTable(spark, t.path), LakeTable(spark, t.path)
    version = b._next()
    a.append(spark.range(3, 5))
    with pytest.raises(ConcurrentWrite):
        b._commit(spark.range(100), "WRITE", {}, *version)
    assert sorted(x[0] for x in t.read().collect()) == [0, 1, 2, 3, 4] and t.version() == 1
    assert t._fs().listStatus(t._path("data")).__len__() == 2
    results = []

    def write(n):
        try:
            results.append(LakeTable(spark, t.path).overwrite(spark.range(n)))
        except ConcurrentWrite:
            results.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (7, 8)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert t.read().count() in (7, 8) and any(x is not None for x in results)


def test_changes_of_all_operations(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(3))
    t.truncate()
    t.restore(0)
    got = {(x["_commit_version"], x["_change_type"]): x["rows"] for x in T.change_summary(t.changes()).collect()}
    assert got == {(0, "insert"): 3, (1, "delete"): 3, (2, "insert"): 3}
    # a source that differs at each evaluation: the feed and the snapshot agree
    u = LakeTable(spark, str(tmp_path / "u"), ())
    u.upsert(spark.range(5).withColumn("v", F.uuid()).withColumn("hash", row_hash("v")), ["id"], "hash")
    u.upsert(spark.range(5).withColumn("v", F.uuid()).withColumn("hash", row_hash("v")), ["id"], "hash")
    after = {(x.id, x.v) for x in u.changes(1).filter("_change_type = 'update_postimage'").collect()}
    assert after == {(x.id, x.v) for x in u.read().collect()}


def test_progress(spark, tmp_path):
    p = T.Progress(spark, str(tmp_path / "p"))
    assert p.seen("gold") == -1
    p.mark("gold", 3, "r1")
    p.mark("silver", 1, "r1")
    p.mark("gold", 4, "r2")
    assert (p.seen("gold"), p.seen("silver"), p.seen("other")) == (4, 1, -1)


def test_files_and_views(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    rows = T.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(x) for x in rows.orderBy("id").collect()] == [(1, 'two\nlines, "quoted"'), (2, None)]
    T.as_view(rows, "csv_rows")
    assert T.scan(spark, "csv_rows").count() == 2
    assert ("csv_rows", True) in {(x["name"], x["temporary"]) for x in T.catalog_tables(spark).collect()}
    assert {(x.a, x.b) for x in T.from_rows(spark, [{"a": 1}, {"a": 2, "b": "x"}]).collect()} == {(1, None), (2, "x")}
    T.land_json(spark.range(100), str(tmp_path / "json"))
    assert T.read_sampled(spark, [str(tmp_path / "json")], 0.5).agg(F.sum("id")).first()[0] == 4950
    t = LakeTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(4))
    assert T.copy_tables({"t": t}, str(tmp_path / "copy"), spark) == {"t": 0} and LakeTable(spark, str(tmp_path / "copy/t")).read().count() == 4


def test_reports_links_and_definitions(spark, tmp_path):
    import pandas as pd

    path = T.export_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string").orderBy("n"), str(tmp_path / "report.csv"))
    assert open(path).read() == 'n,t\n1,"a,b"\n2,\n' and not (tmp_path / "report.csv.parts").exists()
    assert T.from_pandas(spark, pd.DataFrame({"n": [1, 2]})).agg(F.sum("n")).first()[0] == 3
    spark.range(4).write.parquet(str(tmp_path / "kept"))
    assert T.linked_table(spark, "linked_rows", str(tmp_path / "kept")).count() == 4
    spark.sql("create or replace view defined_rows as select id from linked_rows where id > 1")
    found = {x["name"]: x for x in T.catalog_tables(spark).collect()}
    assert "id > 1" in found["defined_rows"]["definition"] and found["linked_rows"]["definition"] is None
    spark.sql("drop view defined_rows")
    spark.sql("drop table linked_rows")
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 4


def test_paged_sources(spark):
    def fetch(start, size):
        return 200, [{"id": i, "name": f"n{i}"} for i in range(start, min(start + size, 23))]

    def page(cursor):
        n = 0 if cursor == "*" else int(cursor)
        return 200, (str(n + 1), [{"id": 100 - 10 * n - k, "timestamp_created": 100 - 10 * n - k} for k in range(10)])

    def paged(cursor):
        status, (following, rows) = page(cursor)
        return status, (following, rows)

    T.paged_source(spark, "offset_pages", "id long, name string", ["id", "name"], lambda o: T.PagedReader(fetch, int(o["total"]), int(o["size"]), ["id", "name"]))
    got = spark.read.format("offset_pages").option("total", 23).option("size", 5).load()
    assert got.rdd.getNumPartitions() == 5 and sorted(x.id for x in got.collect()) == list(range(23))
    T.paged_source(spark, "cursor_pages", "id long", ["id"], lambda o: T.CursorReader(paged, int(o["mark"]), ["id"]))
    assert min(x.id for x in spark.read.format("cursor_pages").option("mark", 75).load().collect()) == 71
