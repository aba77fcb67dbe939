"""Load types, control rows, run statistics and landed files of differing fields."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lakemill.functions.keys import row_hash
from lakemill.plans import loads
from lakemill.sources import control, tables
from lakemill.sources.lake import LakeTable


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string").withColumn("h", row_hash("v"))


@pytest.fixture
def place(spark, tmp_path):
    source = LakeTable(spark, str(tmp_path / "source"), ("k",))
    source.upsert(keyed(spark, [(k, f"v{k}") for k in range(20)]), ["k"], "h")
    return source, LakeTable(spark, str(tmp_path / "target")), tables.Progress(spark, str(tmp_path / "progress")), tables.VersionControl(spark, str(tmp_path / "control"))


def run(place, kind, **options):
    source, target, progress, versions = place
    return loads.run_load(kind, source, target, ["k"], "h", lambda rows: rows, progress, versions, "run", **options)


def rows(table):
    return sorted(tuple(x) for x in table.read().select("k", "v").collect())


def test_incremental_loads_give_what_a_full_load_gives(spark, place, tmp_path):
    source, target, progress, versions = place
    assert run(place, "incremental") == {"inserted": 20, "updated": 0}  # nothing was seen: the whole table
    source.upsert(keyed(spark, [(3, "x"), (30, "new")]), ["k"], "h")
    source.upsert(keyed(spark, [(3, "y")]), ["k"], "h")
    assert run(place, "incremental") == {"inserted": 1, "updated": 1}
    full = LakeTable(spark, str(tmp_path / "full"))
    assert run((source, full, progress, versions), "full")["inserted"] == 21
    assert rows(target) == rows(full) == rows(source)
    with pytest.raises(loads.NothingNew):
        run(place, "incremental")
    got = [(x.change_type, x.commit_version, x.rows_inserted, x.rows_updated, x.latest_source_version) for x in versions.rows().filter(F.col("table_name") == target.path).orderBy("commit_version").collect()]
    assert got == [("MERGE", 0, 20, 0, 0), ("MERGE", 1, 1, 1, 2)]
    note = json.loads(versions.rows().filter("commit_version = 1").first().audit_notes)
    assert note["load_type"] == "incremental" and note["operationMetrics"]["updated"] == 1
    assert versions.latest_source_version(target.path) == 2 and versions.latest_source_version("none") == -1


def test_full_begins_anew_and_reload_does_not(spark, place):
    source, target, _, versions = place
    run(place, "full")
    target.upsert(keyed(spark, [(99, "own")]), ["k"], "h")
    n = versions.rows().count()
    assert run(place, "reload") == {"inserted": 0, "updated": 0} and (99, "own") in rows(target)
    assert versions.rows().count() == n  # nothing changed, so no control row
    run(place, "full")
    assert rows(target) == rows(source)


def test_targeted_loads_read_their_keys_and_mark_nothing(spark, place):
    source, target, progress, _ = place
    assert run(place, "targeted", targets=spark.createDataFrame([(4,), (5,), (5,), (77,)], "k long")) == {"inserted": 2, "updated": 0}
    assert progress.seen(target.path) == -1
    plan = loads.plan_load("targeted", source, 0, ["k"], spark.createDataFrame([(4,)], "k long"))
    assert not plan.whole and "listed keys" in loads.describe(plan) and plan.rows.count() == 1


def test_unknown_loads_stop(spark, place):
    for kind, targets in (("sometimes", None), ("targeted", None), ("targeted", spark.createDataFrame([], "k long"))):
        with pytest.raises(loads.UnknownLoad):
            run(place, kind, targets=targets)
    assert place[1].version() == -1


def test_run_statistics(spark):
    at = lambda minute, second=0: dt.datetime(2024, 1, 1, 10, minute, second)
    data = [("r", 1, at(0, 50), at(1, 10), 5, "success"), ("r", 2, at(1), at(4), 7, "empty"), ("r", 2, at(2), at(2, 59), 0, "failed"), ("r", 3, at(3), None, None, "in-progress"), ("s", 1, at(0), None, 1, "weird")]
    got = {x.run_id: x for x in control.load_run_statistics(spark.createDataFrame(data, "run_id string, app_id int, execution_start_time timestamp, execution_end_time timestamp, retrieved long, execution_status string")).collect()}
    r, s = got["r"], got["s"]
    assert (r.min_duration, r.p25_duration, float(r.avg_duration), r.p75_duration, r.max_duration, r.run_duration) == (0, 0.5, 1.33, 2.0, 3, 4)
    assert (r.retrieved, r.processed_apps, r.empty_loads, r.failed_executions) == (12, 3, 1, 1)
    assert s.min_duration is None and s.run_duration is None and s.failed_executions == 1


def test_landed_files_take_the_largest_folders_schema(spark, tmp_path):
    for name, records in (("small", [{"a": 1, "extra": {"x": [1]}}, {"a": "text", "b": None}]), ("large", [{"a": k, "b": f"b{k}"} for k in range(50)]), ("one", {"a": 7, "c": True})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "batch.json").write_text(json.dumps(records))
    (tmp_path / "one" / "broken.json").write_text("{")
    folders = [str(tmp_path / x) for x in ("small", "large", "one")]
    assert tables.largest_folder(spark, folders) == folders[1]
    got = tables.read_landed(spark, folders)
    assert got.columns == ["a", "b", "_rescued", "_file"] and got.count() == 53
    odd = {(x.a, x._rescued and tuple(sorted(json.loads(x._rescued).items()))) for x in got.filter("_rescued is not null").collect()}
    assert odd == {(1, (("extra", '{"x":[1]}'),)), (None, (("a", "text"),)), (7, (("c", "true"),))}
