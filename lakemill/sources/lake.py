"""Versioned Parquet tables: snapshots, commit log, hash-gated upserts, change feed, time travel.

Layout: ``log/N.json`` is commit N. Its name X (which tells the writer, so nobody writes over another's files) leads to
``files/X``, the list of the snapshot's data files with rows and the range of the first key, and ``changes/X``, its row
changes. Data files lie in ``data/X`` of the commit that wrote them; later snapshots go on naming them, so an operation
writes only the files whose rows it changes. A commit is written aside and renamed to its place, which fails if another
writer was first; then the late one takes its own folders back.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INSERT, UPDATE, BEFORE, DELETE = "insert", "update_postimage", "update_preimage", "delete"
FOLDERS = ("data", "changes", "files", "source")


class DuplicateKeys(ValueError):
    """A source of an upsert has a key twice."""


class ConcurrentWrite(RuntimeError):
    """Another writer made the version first; the operation may be tried again on what is there now."""


def merged_schema(schemas: Iterable[StructType]) -> StructType:
    """All fields of some schemas, in order of appearance; the latest type of each."""
    fields = {}
    for schema in schemas:
        fields.update({f.name: f for f in schema})
    return StructType(list(fields.values()))


class LakeTable:
    def __init__(self, spark: SparkSession, path: str, cluster_by: tuple[str, ...] = ()):
        self.spark, self.path, self.cluster_by = spark, path.rstrip("/"), cluster_by

    # the log

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs().exists(self._path("log")):
            return []
        names = [x.getPath().getName() for x in self._fs().listStatus(self._path("log"))]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def version(self) -> int:
        """The latest version; -1 if the table doesn't exist."""
        return max(self.versions(), default=-1)

    def _entry(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"log/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _known(self, version: int | None = None) -> dict:
        found = self.version() if version is None else version
        if found not in self.versions():
            raise LookupError(f"no version {found} of {self.path}")
        return self._entry(found)

    def history(self) -> DataFrame:
        """version, operation, timestamp and metrics of every commit."""
        return self.spark.read.schema("version long, operation string, timestamp double, metrics map<string,long>").json(f"{self.path}/log/*.json")

    def detail(self) -> dict:
        entry = self._known()
        sizes = self._files(entry).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        return {"format": "parquet", "version": entry["version"], "files": sizes[0], "bytes": sizes[1], "cluster_by": list(self.cluster_by)}

    # snapshots

    def read(self, version: int | None = None) -> DataFrame:
        entry = self._known(version)
        return self._rows(entry, self._files(entry))

    def _files(self, entry: dict) -> DataFrame:
        """file, rows, bytes, and low, high and nulls of the snapshot's first key (null where another key led)."""
        return self.spark.read.parquet(f"{self.path}/files/{entry['name']}")

    def _rows(self, entry: dict, files: DataFrame) -> DataFrame:
        """The rows of some of a snapshot's files; columns that a file lacks are NULL. Spark lists files on the driver, and so does this."""
        schema = StructType.fromJson(entry["schema"])
        names = [f"{self.path}/{x[0]}" for x in files.select("file").collect()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    @staticmethod
    def _with_file(rows: DataFrame) -> DataFrame:
        """``rows`` of data files with the name of each one's file, as snapshots list it."""
        here = F.col("_metadata.file_path") if rows.inputFiles() else F.lit("")
        return rows.withColumn("__file", F.regexp_extract(here, "(data/[^/]+/[^/]+)$", 1))

    def _listed(self, rows: DataFrame, name: str, lead: str | None) -> DataFrame:
        """The list of the data files that ``name`` wrote."""
        sized = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}")
        key = F.col(f"`{lead}`") if lead in rows.columns else F.lit(None).cast("string")
        found = self._with_file(sized.withColumns({"__key": key, "__bytes": F.col("_metadata.file_size")}))
        return found.groupBy(F.col("__file").alias("file")).agg(
            F.count("*").alias("rows"), F.max("__bytes").alias("bytes"), F.min("__key").alias("low"), F.max("__key").alias("high"), F.coalesce(F.bool_or(F.col("__key").isNull()), F.lit(False)).alias("nulls")
        )

    def _commit(self, rows: DataFrame | None, operation: str, metrics: Mapping[str, int], version: int, name: str, kept: DataFrame | None = None, lead: str | None = None, schema: StructType | None = None) -> int:
        """Makes a version of new ``rows`` and the ``kept`` files of the one before."""
        lead = self.cluster_by[0] if self.cluster_by else lead
        schema = schema or rows.schema
        files = kept
        if rows is not None:
            if self.cluster_by:
                rows = rows.repartitionByRange(*self.cluster_by).sortWithinPartitions(*self.cluster_by)
            rows.write.parquet(f"{self.path}/data/{name}")
            files = self._listed(rows, name, lead)
            if kept is not None:
                same = dict(kept.dtypes)["low"] == dict(files.dtypes)["low"]
                kept = kept if same else kept.withColumns({"low": F.lit(None).cast(files.schema["low"].dataType), "high": F.lit(None).cast(files.schema["high"].dataType), "nulls": F.lit(True)})
                files = files.unionByName(kept)
        files.coalesce(8).write.parquet(f"{self.path}/files/{name}")
        entry = {"version": version, "operation": operation, "timestamp": time.time(), "metrics": dict(metrics), "name": name, "lead": lead, "schema": json.loads(schema.json()), "changed": self._fs().exists(self._path(f"changes/{name}"))}
        self._publish(version, json.dumps(entry))
        self._fs().delete(self._path(f"source/{name}"), True)
        return version

    def _publish(self, version: int, entry: str) -> None:
        """Writes the commit aside and renames it to its place, which fails if one is there. A crash before leaves no commit."""
        jvm, aside, place = self.spark._jvm, self._path(f"log/.{version}-{uuid.uuid4().hex}"), self._path(f"log/{version}.json")
        out = self._fs().create(aside, False)
        out.write(bytearray(entry.encode()))
        out.close()
        rename = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = self._fs().makeQualified
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified(aside).toUri(), self.spark._jsc.hadoopConfiguration()).rename(qualified(aside), qualified(place), rename)
        except Exception as e:
            self._fs().delete(aside, False)
            self._discard(json.loads(entry)["name"])
            if self._fs().exists(place):
                raise ConcurrentWrite(f"{self.path}: version {version} is there") from e
            raise

    def _discard(self, name: str) -> None:
        for folder in FOLDERS:
            self._fs().delete(self._path(f"{folder}/{name}"), True)

    def _next(self) -> tuple[int, str]:
        version = self.version() + 1
        return version, f"{version}-{uuid.uuid4().hex}"

    def _staged(self, rows: DataFrame, name: str, what: str) -> DataFrame:
        """``rows`` written down, so that the feed and the snapshot see the same ones."""
        path = f"{self.path}/source/{name}/{what}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # changes

    def changes(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Row changes of the versions from ``start`` to ``end``, with _change_type, _commit_version and _commit_timestamp: one scan, however many versions."""
        log = self.spark.read.schema("version long, name string, changed boolean, schema string").json(f"{self.path}/log/*.json")
        entries = sorted(log.filter(F.col("version").between(start, self.version() if end is None else end) & F.col("changed")).collect())
        if not entries:
            return self.read().limit(0).select("*", F.lit("").alias("_change_type"), F.lit(0).cast("long").alias("_commit_version"), F.lit(0.0).alias("_commit_timestamp"))
        schema = merged_schema(StructType.fromJson(json.loads(x.schema)) for x in entries).add("_change_type", "string")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/changes/{x.name}" for x in entries))
        rows = rows.withColumn("_commit_version", F.regexp_extract("_metadata.file_path", r"/changes/(\d+)-", 1).cast("long"))
        times = self.history().select(F.col("version").alias("_commit_version"), F.col("timestamp").alias("_commit_timestamp"))
        return rows.join(F.broadcast(times), "_commit_version", "left")  # a row a version

    def _log_changes(self, changed: DataFrame, name: str) -> dict[str, int]:
        changed.write.parquet(f"{self.path}/changes/{name}")
        written = self.spark.read.schema(changed.schema).parquet(f"{self.path}/changes/{name}")
        return {x[0]: x[1] for x in written.groupBy("_change_type").count().collect()}

    # operations

    def overwrite(self, rows: DataFrame, operation: str = "WRITE") -> int:
        """All rows go and ``rows`` come, in the change feed too."""
        version, name = self._next()
        rows = self._staged(rows, name, "rows")
        changed = rows.withColumn("_change_type", F.lit(INSERT))
        if version:
            changed = changed.unionByName(self.read().withColumn("_change_type", F.lit(DELETE)), allowMissingColumns=True)
        self._log_changes(changed, name)
        return self._commit(rows, operation, {}, version, name)

    def append(self, rows: DataFrame) -> int:
        """Adds rows as new files; columns that either side lacks become NULL there. Columns of both take the table's type."""
        version, name = self._next()
        rows = self._staged(rows, name, "rows")
        before = self._known() if version else None
        if before:
            own = StructType.fromJson(before["schema"])
            rows = rows.withColumns({f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in own if f.name in rows.columns})
        n = self._log_changes(rows.withColumn("_change_type", F.lit(INSERT)), name).get(INSERT, 0)
        if not before:
            return self._commit(rows, "APPEND", {"inserted": n}, version, name)
        return self._commit(rows, "APPEND", {"inserted": n}, version, name, self._files(before), before["lead"], merged_schema([own, rows.schema]))

    def upsert(
        self, source: DataFrame, keys: list[str], hash_column: str | None = None, on_insert: Mapping[str, Column] | None = None, on_update: Mapping[str, Column] | None = None, newer: str | None = None
    ) -> dict[str, int]:
        """Inserts new keys and updates those whose hash differs (null-safe); {"inserted", "updated"}, no commit if both are 0.

        Keys must be unique in ``source`` and match null-safe. ``on_insert`` and ``on_update`` set further columns; the
        source's are ``s.x`` there, the table's (of an update) ``t.x``. With ``newer``, a column that orders rows, a row
        is updated only by a greater value, so one that comes late changes nothing; NULL is older than all.
        Columns that only the table has keep their values; new columns are NULL in rows left alone. Only files with a
        row to update are written anew: files are ruled out by the range of the first key, the rest by a join of keys.
        """
        version, name = self._next()
        try:
            return self._merge(self._staged(source, name, "rows"), keys, hash_column, dict(on_insert or {}), dict(on_update or {}), newer, version, name)
        finally:
            self._fs().delete(self._path(f"source/{name}"), True)

    def _merge(self, source: DataFrame, keys: list[str], hash_column: str | None, on_insert: dict, on_update: dict, newer: str | None, version: int, name: str) -> dict[str, int]:
        if not source.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise DuplicateKeys(f"{self.path}: source repeats a key of {keys}")
        if not version:
            rows = self._staged(source.alias("s").withColumns(on_insert) if on_insert else source, name, "after")
            n = self._log_changes(rows.withColumn("_change_type", F.lit(INSERT)), name).get(INSERT, 0)
            self._commit(rows, "MERGE", {"inserted": n, "updated": 0}, 0, name, lead=keys[0])
            return {"inserted": n, "updated": 0}
        entry, match = self._known(), F.lit(True)
        for k in keys:
            match = match & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        target = self._with_file(self._rows(entry, self._candidates(entry, source, keys[0])))
        differs = F.lit(True) if hash_column is None or hash_column not in target.columns else ~F.col(f"t.{hash_column}").eqNullSafe(F.col(f"s.{hash_column}"))
        if newer and newer in target.columns:
            differs = differs & F.coalesce(F.col(f"s.{newer}") > F.col(f"t.{newer}"), F.col(f"s.{newer}").isNotNull() & F.col(f"t.{newer}").isNull())
        hits = target.alias("t").join(source.alias("s"), match).select(*(F.col(f"s.{k}").alias(k) for k in keys), "__file", differs.alias("__differs"))
        hits = self._staged(hits, name, "hits")
        touched = hits.filter("__differs").select(F.col("__file").alias("file")).distinct()

        columns = list(dict.fromkeys([*target.drop("__file").columns, *source.columns, *on_insert, *on_update]))
        old, none = [c for c in target.columns if c != "__file"], F.lit(None)
        by = lambda a, b: a.alias("s").join(b.alias("h"), self._equal("s", "h", keys), "left_anti")
        new = by(source, hits).select(*(on_insert.get(c, F.col(f"s.{c}") if c in source.columns else none).alias(c) for c in columns), F.lit(INSERT).alias("_change_type"))
        due = source.alias("s").join(hits.filter("__differs").select(*keys).distinct().alias("h"), self._equal("s", "h", keys), "left_semi").withColumn("__due", F.lit(True))
        rows = self._rows(entry, self._files(entry).join(touched, "file", "left_semi")).alias("t").join(due.alias("s"), match, "left")
        hit = F.col("__due").isNotNull()

        def value(c: str) -> Column:
            before = F.col(f"t.{c}") if c in old else none
            return F.when(hit, on_update.get(c, F.col(f"s.{c}") if c in source.columns else before)).otherwise(before).alias(c)

        was = F.when(hit, F.struct(*(F.col(f"t.{c}").alias(c) for c in old))).alias("__was")
        after = rows.select(*map(value, columns), F.when(hit, UPDATE).alias("_change_type"), was).unionByName(new, allowMissingColumns=True)
        after = self._staged(after, name, "after")
        post = after.filter("_change_type is not null").drop("__was")
        before = after.filter(f"_change_type = '{UPDATE}'").select("__was.*", F.lit(BEFORE).alias("_change_type"))
        counts = self._log_changes(post.unionByName(before, allowMissingColumns=True), name)
        done = {"inserted": counts.get(INSERT, 0), "updated": counts.get(UPDATE, 0)}
        if not any(done.values()):
            self._discard(name)
            return done
        files = self._files(entry)
        kept = files.join(touched, "file", "left_anti")
        metrics = {**done, "files_kept": kept.count(), "files_rewritten": touched.count()}
        rows = after.drop("_change_type", "__was")
        self._commit(rows, "MERGE", metrics, version, name, kept, entry["lead"] or keys[0], merged_schema([StructType.fromJson(entry["schema"]), rows.schema]))
        return done

    @staticmethod
    def _equal(a: str, b: str, keys: list[str]) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    def _candidates(self, entry: dict, source: DataFrame, key: str) -> DataFrame:
        """The snapshot's files that may hold a key of ``source``, by the range of the first key."""
        files = self._files(entry)
        if entry["lead"] != key:
            return files
        low, high, nulls = source.agg(F.min(key), F.max(key), F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False))).first()
        within = (F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)) if low is not None else F.lit(False)
        return files.filter(F.coalesce(within, F.lit(low is not None) & F.col("nulls") & F.col("low").isNull()) | (F.col("nulls") & F.lit(nulls)))

    def _rewrite(self, hit: Column | DataFrame, operation: str, metric: str, values: Mapping[str, Column] | None, keys: list[str] | None = None) -> int:
        """Deletes (without ``values``) or updates rows in their files alone: those that ``hit``, or whose ``keys`` are among the rows of ``hit``. No rows: no commit where keys are given."""
        (version, name), entry = self._next(), self._known()
        files, found = self._files(entry), self.read()
        if keys:
            listed = self._staged(hit.select(*keys).distinct(), name, "keys")
            found = self._rows(entry, self._candidates(entry, listed, keys[0]))
        mark = lambda rows: rows.alias("t").join(listed.withColumn("__hit", F.lit(True)).alias("s"), self._equal("t", "s", keys), "left").select("t.*", F.col("__hit").isNotNull().alias("__hit")) if keys else rows.withColumn("__hit", hit)
        touched = self._staged(mark(self._with_file(found)).filter("__hit").select(F.col("__file").alias("file")).distinct(), name, "touched")
        if keys and touched.isEmpty():
            self._discard(name)
            return entry["version"]
        old = mark(self._rows(entry, files.join(touched, "file", "left_semi")))
        old = old.withColumn("__was", F.struct(*(F.col(f"`{f}`") for f in StructType.fromJson(entry["schema"]).names)))
        if values:
            old = old.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in values.items()})
        old = self._staged(old, name, "after")
        kind = lambda df, what: df.withColumn("_change_type", F.lit(what))
        gone = old.filter("__hit").select("__was.*")
        if values:
            changed = kind(old.filter("__hit").drop("__hit", "__was"), UPDATE).unionByName(kind(gone, BEFORE))
        else:
            changed = kind(gone, DELETE)
        n = self._log_changes(changed, name).get(UPDATE if values else DELETE, 0)
        left = (old if values else old.filter("not __hit")).drop("__hit", "__was")
        schema = merged_schema([StructType.fromJson(entry["schema"]), left.schema])
        return self._commit(left, operation, {metric: n}, version, name, files.join(touched, "file", "left_anti"), entry["lead"], schema)

    def delete(self, condition: Column) -> int:
        return self._rewrite(F.coalesce(condition, F.lit(False)), "DELETE", "deleted", None)

    def delete_keys(self, gone: DataFrame, keys: list[str]) -> int:
        """Deletes the rows whose keys are among those of ``gone`` (null-safe); no commit if there are none."""
        return self._rewrite(gone, "DELETE", "deleted", None, keys)

    def update(self, condition: Column, values: Mapping[str, Column]) -> int:
        return self._rewrite(F.coalesce(condition, F.lit(False)), "UPDATE", "updated", values)

    def truncate(self) -> int:
        return self.overwrite(self.read().limit(0), "TRUNCATE")

    def restore(self, version: int) -> int:
        """The rows of ``version`` again, by its files; the feed tells the rows of the files that differ."""
        (now, name), old, entry = self._next(), self._known(version), self._known()
        there, here = self._files(old), self._files(entry)
        came = self._rows(old, there.join(here, "file", "left_anti")).withColumn("_change_type", F.lit(INSERT))
        went = self._rows(entry, here.join(there, "file", "left_anti")).withColumn("_change_type", F.lit(DELETE))
        self._log_changes(came.unionByName(went, allowMissingColumns=True), name)
        return self._commit(None, "RESTORE", {"restored": version}, now, name, there, old["lead"], StructType.fromJson(old["schema"]))

    def optimize(self, files: int) -> int:
        entry = self._known()
        return self._commit(self.read().coalesce(files), "OPTIMIZE", {}, *self._next(), lead=entry["lead"])
