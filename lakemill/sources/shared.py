"""The folder that driver and executors share, and views that are computed once and kept there."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a folder of its own, which goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lakemill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, survives lost executors. A path that is written already is read."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of all files below some paths: names, lengths and times. It differs when any of them was written anew."""
    found, conf = [], spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            x = files.next()
            found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()[:16]


class Views:
    """Views by name over a folder of tables, each with the views and tables it reads.

    ``spark`` and the folder give a view's rows: it is computed at most once for each version of its tables, written to
    the shared folder and read from there by all that need it. Views that are not ``kept`` are computed anew each time.
    """

    def __init__(self) -> None:
        self._views: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...], bool]] = {}
        self._locks: dict[str, threading.Lock] = {}

    def add(self, name: str, tables: tuple[str, ...] = (), views: tuple[str, ...] = (), kept: bool = True) -> Callable:
        """Registers a function of (spark, folder), or of (spark, folder, its views by name)."""
        if missing := [v for v in views if v not in self._views]:
            raise KeyError(f"{name} needs {missing}: register in order of dependency")

        def register(make: Callable) -> Callable:
            self._views[name] = (make, tables, views, kept)
            return make

        return register

    def names(self) -> list[str]:
        """All views, each behind those it reads."""
        return list(self._views)

    def tables(self, name: str) -> set[str]:
        """The tables that a view reads, by itself or through other views."""
        _, own, views, _ = self._views[name]
        return {*own, *(t for v in views for t in self.tables(v))}

    def get(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        make, _, views, kept = self._views[name]
        if not kept:
            return self._made(spark, folder, make, views)
        version = source_version(spark, [f"{folder}/{t}.parquet" for t in sorted(self.tables(name))])
        path = f"{shared_dir(spark)}/views-{spark.sparkContext.applicationId}/{name}-{version}"
        with self._locks.setdefault(path, threading.Lock()):  # queries side by side compute it once
            return staged(self._made(spark, folder, make, views), path)

    def _made(self, spark: SparkSession, folder: str, make: Callable, views: tuple[str, ...]) -> DataFrame:
        return make(spark, folder, {v: self.get(spark, folder, v) for v in views}) if views else make(spark, folder)

    def create(self, spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
        """Makes temporary views of all, in order of dependency; their names."""
        for name in self._views:
            self.get(spark, folder, name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self._views]
