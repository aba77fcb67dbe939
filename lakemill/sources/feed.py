"""The change feed of a ``LakeTable`` as a data source, for batches, SQL and streams.

``register(spark)``, then ``spark.read.format("lake_changes").option("path", p).option("startingVersion", 3)``, or
``spark.readStream`` with commit versions as offsets; ``changes_view`` names the feed for SQL. Each commit is cut into partitions of whole change files, which executors read by the file system that the path's scheme names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lakemill.sources.lake import merged_schema


def _open(path: str):
    """The file system of ``path`` and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Commits:
    """The log of a table, as a data source reads it."""

    def __init__(self, path: str):
        from pyarrow.fs import FileSelector

        self.fs, self.path = _open(path.rstrip("/"))
        names = {int(m[1]): x.path for x in self.fs.get_file_info(FileSelector(f"{self.path}/log")) if (m := re.fullmatch(r"(\d+)\.json", x.base_name))}
        self.latest, self._logs = max(names, default=-1), names

    def entries(self, start: int, end: int) -> list[dict]:
        """The commits of the versions from ``start`` to ``end`` that changed rows."""
        found = []
        for version in sorted(v for v in self._logs if start <= v <= end):
            with self.fs.open_input_stream(self._logs[version]) as f:
                found.append(json.loads(f.read()))
        return [x for x in found if x["changed"]]

    def schema(self, entries: list[dict]) -> StructType:
        own = merged_schema(StructType.fromJson(x["schema"]) for x in entries)
        return own.add("_change_type", "string").add("_commit_version", "long").add("_commit_timestamp", "double")

    def partitions(self, start: int, end: int) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        out = []
        for entry in self.entries(start, end):
            folder = f"{self.path}/changes/{entry['name']}"
            files = [x.path for x in self.fs.get_file_info(FileSelector(folder)) if x.base_name.startswith("part-")]
            out += [ChangeFile(entry["version"], entry["timestamp"], f) for f in files]
        return out


class ChangeFile(InputPartition):
    def __init__(self, version: int, timestamp: float, file: str):
        super().__init__((version, file))
        self.version, self.timestamp, self.file = version, timestamp, file


class _Reads:
    """Reading of a partition, for both kinds of readers."""

    def __init__(self, path: str, schema: StructType, start: int, end: int | None):
        self.path, self.schema, self.start, self.end = path, schema, start, end

    def read(self, partition: ChangeFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = _open(self.path)
        want = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                n = len(batch)
                known = dict(zip(batch.schema.names, batch.columns, strict=True))
                known |= {"_commit_version": pa.array([partition.version] * n, pa.int64()), "_commit_timestamp": pa.array([partition.timestamp] * n, pa.float64())}
                columns = [known[x.name].cast(x.type) if x.name in known else pa.nulls(n, x.type) for x in want]
                yield pa.RecordBatch.from_arrays(columns, schema=want)


class ChangeReader(_Reads, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        commits = Commits(self.path)
        return commits.partitions(self.start, commits.latest if self.end is None else self.end) or [ChangeFile(-1, 0.0, "")]

    def read(self, partition: ChangeFile) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.file else iter(())


class ChangeStream(_Reads, DataSourceStreamReader):
    """Offsets are the last version read. Versions never change, so a micro-batch that is run again reads the same rows."""

    def initialOffset(self) -> dict:
        return {"version": self.start - 1}

    def latestOffset(self) -> dict:
        return {"version": max(Commits(self.path).latest, self.start - 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return Commits(self.path).partitions(start["version"] + 1, end["version"])

    def commit(self, end: dict) -> None:
        """Nothing to free: the feed stays."""


class LakeChanges(DataSource):
    """Options: path, startingVersion (0), endingVersion (the latest). A stream keeps the schema that it began with."""

    @classmethod
    def name(cls) -> str:
        return "lake_changes"

    @property
    def _path(self) -> str:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        return options["path"]

    def _range(self) -> tuple[int, int | None]:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        end = options.get("endingversion")
        return int(options.get("startingversion", 0)), None if end is None else int(end)

    def schema(self) -> StructType:
        commits = Commits(self._path)
        return commits.schema(commits.entries(0, commits.latest))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChangeReader(self._path, schema, *self._range())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeStream(self._path, schema, *self._range())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LakeChanges)


def changes_view(spark: SparkSession, name: str, path: str, start: int = 0, end: int | None = None) -> None:
    """A temporary view of a table's changes, for SQL: it reads what is there when a query begins."""
    register(spark)
    reader = spark.read.format("lake_changes").option("path", path).option("startingVersion", start)
    (reader if end is None else reader.option("endingVersion", end)).load().createOrReplaceTempView(name)
