"""Incremental refreshes: upserts of micro-batches, streams of a table's changes, and recomputing whole keys that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakemill.operators.cleaning import dedup_latest
from lakemill.sources import feed
from lakemill.sources.lake import DELETE, INSERT, UPDATE, LakeTable


def stream_into(source: DataFrame, target: LakeTable, keys: list[str], newest: list[Column], checkpoint: str, hash_column: str | None = None, newer: str | None = None) -> StreamingQuery:
    """Upserts each micro-batch's latest row a key. A batch run again after a failure changes nothing, as hashes are equal.

    Without ``newer`` the last batch wins; with it, a column that orders rows, a row that comes late changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        target.upsert(dedup_latest(batch, keys, newest), keys, hash_column, newer=newer)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """The changes of a lake table as a stream, from version ``start`` on; offsets are versions."""
    feed.register(spark)
    return spark.readStream.format("lake_changes").option("path", path).option("startingVersion", start).load()


def follow(source: LakeTable, target: LakeTable, keys: list[str], checkpoint: str, start: int = 0) -> StreamingQuery:
    """Keeps ``target`` equal to ``source`` by its change feed: upserts and deletes, each commit's effect exactly once.

    A key's last change wins. A batch that failed halfway is run again with the same versions: rows that are equal already
    are left alone, and keys that are gone already aren't found. Columns of the source need to be comparable.
    """

    def apply(batch: DataFrame, _: int) -> None:
        ends = batch.filter(F.col("_change_type").isin(INSERT, UPDATE, DELETE))
        # within a version a delete comes before an insert of the same key, as in an overwrite
        last = dedup_latest(ends, keys, [F.desc("_commit_version"), (F.col("_change_type") == DELETE).asc()])
        rows = last.filter(F.col("_change_type") != DELETE).drop("_change_type", "_commit_version", "_commit_timestamp")
        rows = rows.withColumn("row_hash", F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256))
        target.upsert(rows, keys, "row_hash")
        gone = last.filter(F.col("_change_type") == DELETE).select(*keys)
        if target.version() >= 0:
            target.delete_keys(gone, keys)

    return change_stream(source.spark, source.path, start).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def affected(source: LakeTable, key: str, since: int) -> DataFrame:
    """Keys of rows inserted or updated in the versions after ``since``."""
    return source.changes(since + 1).filter(f"_change_type in ('{INSERT}', '{UPDATE}')").select(key).distinct()


def recompute(source: LakeTable, target: LakeTable, key: str, since: int, rows: Callable[[DataFrame], DataFrame], keys: list[str], hash_column: str) -> dict[str, int]:
    """Applies ``rows`` to all source rows of affected keys (windows need whole keys) and upserts the result."""
    whole = source.read().join(affected(source, key, since), key, "left_semi")
    return target.upsert(rows(whole), keys, hash_column)
