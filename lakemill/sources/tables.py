"""Further sources and sinks: named tables and views, CSV and JSON with inferred or sampled schemas, paged readers as data sources, progress marks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakemill.sources.lake import LakeTable
from lakemill.sources.landing import StopMark


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A table or temporary view by name."""
    return spark.table(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header line; quoted fields may hold line breaks. Without a schema it is inferred."""
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def largest_folder(spark: SparkSession, folders: list[str]) -> str:
    """The landing folder of the most bytes, the first by name among equals."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def size(folder: str) -> int:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(conf).getContentSummary(path).getLength()

    return min(folders, key=lambda x: (-size(x), x))


def read_landed(spark: SparkSession, folders: list[str], rescued: str = "_rescued") -> DataFrame:
    """Multi-line JSON of many folders by the schema of the largest one, which alone is read to infer it.

    Fields that this schema lacks are kept: ``rescued`` is a JSON object of them, NULL where there are none. Values that
    don't fit their type are NULL and kept there too, as they were. Top-level fields only; no folders: an error.
    """
    reader = spark.read.option("multiLine", True)
    schema = reader.json(largest_folder(spark, folders)).schema
    texts = spark.read.text(folders, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    one = F.filter(F.array(F.try_parse_json("value")), lambda v: v.isNotNull())  # a file of one object
    records = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<variant>")).otherwise(one)
    rows = texts.select("_file", F.explode(records).alias("v")).select("_file", F.to_json("v").alias("j"))
    known = F.from_json("j", schema)
    fields = F.from_json("j", "map<string,string>")
    types = {f.name: f.dataType for f in schema}
    lost = lambda k, v: ~F.array_contains(F.array(*(F.lit(x) for x in types)), k) | F.exists(F.array(*(F.struct(F.lit(x).alias("k"), known[x].isNull().alias("null")) for x in types)), lambda t: (t["k"] == k) & t["null"] & v.isNotNull())
    kept = F.map_filter(fields, lost)
    return rows.select(known.alias("r"), F.when(F.size(kept) > 0, F.to_json(kept)).alias(rescued), "_file").select("r.*", rescued, "_file")


def read_sampled(spark: SparkSession, paths: list[str], ratio: float = 0.1) -> DataFrame:
    """JSON whose schema is inferred from a share of the rows; fields that only others have are left out."""
    return spark.read.option("samplingRatio", ratio).json(paths)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """JSON rows in memory, with an inferred schema; for small control data."""
    return spark.read.json(spark.createDataFrame([(json.dumps(x),) for x in rows], "value string").select("value").rdd.map(lambda x: x[0])) if rows else spark.createDataFrame([], "value string")


def land_json(df: DataFrame, folder: str) -> str:
    """Writes rows as JSON lines to a new landing folder."""
    df.write.mode("errorifexists").json(folder)
    return folder


def copy_tables(tables: dict[str, LakeTable], folder: str, spark: SparkSession) -> dict[str, int]:
    """Copies the latest versions of tables to another place; the versions that were made there."""
    return {name: LakeTable(spark, f"{folder}/{name}", table.cluster_by).overwrite(table.read()) for name, table in tables.items()}


def catalog_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    """name, type, temporariness and, of kept views, the definition of a database's tables and views."""

    def definition(x) -> str | None:
        return None if x.isTemporary or x.tableType != "VIEW" else spark.sql(f"show create table `{database}`.`{x.name}`").first()[0]

    rows = [(x.name, x.tableType, x.isTemporary, definition(x)) for x in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean, definition string")


def export_csv(df: DataFrame, path: str) -> str:
    """Writes a report as one CSV file with a header, for results that one task may hold; the file's path."""
    spark = df.sparkSession
    aside = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(aside)
    folder, place = spark._jvm.org.apache.hadoop.fs.Path(aside), spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    fs.delete(place, False)
    fs.rename(part, place)
    fs.delete(folder, True)
    return path


def from_pandas(spark: SparkSession, frame, schema: str | None = None) -> DataFrame:
    """Small control data from pandas."""
    return spark.createDataFrame(frame, schema)


def linked_table(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """A table whose files stay where another place keeps them: dropping it leaves them alone."""
    spark.sql(f"create table if not exists {name} using {kind} location '{path}'")
    return spark.table(name)


def change_summary(changes: DataFrame) -> DataFrame:
    """Rows of each version and kind of change."""
    return changes.groupBy("_commit_version", "_change_type").agg(F.count("*").alias("rows"))


class Progress:
    """The version of a source that each consumer has seen, as a table of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, LakeTable(spark, path, ("consumer",))

    def seen(self, consumer: str) -> int:
        if self.table.version() < 0:
            return -1
        found = self.table.read().filter(F.col("consumer") == consumer).agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def mark(self, consumer: str, version: int, run_id: str) -> None:
        row = self.spark.createDataFrame([(consumer, version, run_id)], "consumer string, version long, run_id string")
        self.table.upsert(row.withColumn("hash", F.sha2(F.concat_ws("|", "consumer", "version", "run_id"), 256)), ["consumer"], "hash")


class VersionControl:
    """Control rows of a load's commits: what changed, how many rows, up to which source version, and the commit in full as notes."""

    SCHEMA = "table_name string, run_id string, change_type string, commit_version long, commit_timestamp timestamp, rows_inserted long, rows_updated long, latest_source_version long, audit_notes string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, LakeTable(spark, path)

    def insert(self, table: LakeTable, run_id: str, source_version: int, notes: dict | None = None) -> None:
        """A row for the latest commit of ``table``."""
        entry = table._known()
        metrics = entry["metrics"]
        told = json.dumps({"operation": entry["operation"], "version": entry["version"], "timestamp": entry["timestamp"], "operationMetrics": metrics, **(notes or {})}, sort_keys=True)
        row = (table.path, run_id, entry["operation"], entry["version"], datetime.fromtimestamp(entry["timestamp"], timezone.utc), metrics.get("inserted", 0), metrics.get("updated", 0), source_version, told)
        self.table.append(self.spark.createDataFrame([row], self.SCHEMA))

    def rows(self) -> DataFrame:
        return self.table.read() if self.table.version() >= 0 else self.spark.createDataFrame([], self.SCHEMA)

    def latest_source_version(self, table: str) -> int:
        """The greatest source version that a commit of ``table`` has read; -1 if there is none."""
        found = self.rows().filter(F.col("table_name") == table).agg(F.max("latest_source_version")).first()[0]
        return -1 if found is None else found


class _Page(InputPartition):
    def __init__(self, start: int, size: int):
        super().__init__((start, size))
        self.start, self.size = start, size


class PagedReader(DataSourceReader):
    """Pages by offset, a partition each, so executors fetch them; ``fetch(start, size)`` gives (status, rows of JSON values).

    With a ``stop`` mark one refusal stops the readers of all partitions, and of tasks that are tried again.
    """

    def __init__(self, fetch: Callable, total: int, size: int, columns: list[str], stop: StopMark | None = None):
        self.fetch, self.total, self.size, self.columns, self.stop = fetch, total, size, columns, stop

    def partitions(self) -> list[InputPartition]:
        return [_Page(start, self.size) for start in range(0, self.total, self.size)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from lakemill.sources.landing import with_retries

        for row in with_retries(self.fetch, partition.start, partition.size, stop=self.stop):
            yield tuple(row.get(c) for c in self.columns)


class CursorReader(DataSourceReader):
    """Pages by cursor, in order, down to rows seen before; each page depends on the one before, so one task reads them."""

    def __init__(self, fetch: Callable, mark: int | None, columns: list[str], stop: StopMark | None = None):
        self.fetch, self.mark, self.columns, self.stop = fetch, mark, columns, stop

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from lakemill.sources.landing import cursor_pages

        for _, rows in cursor_pages(self.fetch, mark=self.mark, stop=self.stop):
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)


def paged_source(spark: SparkSession, name: str, schema: str, columns: list[str], reader: Callable[[dict], DataSourceReader]) -> None:
    """Registers a reader as ``spark.read.format(name)``; ``reader`` gets the options."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return reader(dict(self.options))

    spark.dataSource.register(Source)
