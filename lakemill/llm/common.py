"""What the corpus operators share: the shared folder, staged tables, text constants."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts define it: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``. Only a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lakemill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


#: Open scopes of this thread or context, innermost last: the paths made in each. Queries side by side don't share them.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scratch scopes", default=())


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. Outside of all scopes it stays until the folder is cleaned, as lazy results read it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if open_ := _scopes.get():
        open_[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def dropped(spark: SparkSession):
    """A scope whose scratch tables are deleted at its end; what the given function stages outlives it."""
    outer, made = _scopes.get(), []
    inside = _scopes.set((*outer, made))

    def outlive(df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if outer:
            outer[-1].append(path)
        return _written(df, path)

    try:
        yield outlive
    finally:
        _scopes.reset(inside)
        for path in made:
            delete(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    return _written(df, scratch(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, most: int) -> DataFrame:
    """A staged table marked for broadcast if it has ``most`` rows at most; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Returns freed memory to the system, as Python workers live on beside the next stage's heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run`` for ``mapInArrow`` or ``mapInPandas``; what it took is given back at its end."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
