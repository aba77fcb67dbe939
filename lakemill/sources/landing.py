"""Landing files: paged fetching with retries, JSON batches, exports."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The raw record's fields.
REVIEW_SCHEMA = """recommendationid string, author struct<steamid:string,playtime_forever:long,playtime_at_review:long>, language string, review string, voted_up boolean,
votes_up long, votes_funny long, comment_count long, reactions array<struct<count:int,reaction_type:string>>, weighted_vote_score string, timestamp_created long,
timestamp_updated long, refunded boolean, written_during_early_access boolean"""
UINT32 = 2_147_483_647


class Forbidden(RuntimeError):
    """The service refused; all fetching must stop."""


class StopMark:
    """A file in a shared folder that tells all readers of a source, on any machine, to fetch no more."""

    def __init__(self, uri: str):
        self.uri = uri if "://" in uri else "file://" + uri.removeprefix("file:")

    def _place(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.uri)

    def set(self, reason: str) -> None:
        fs, path = self._place()
        with fs.open_output_stream(path) as out:
            out.write(reason.encode())

    def reason(self) -> str | None:
        """Why to stop; None to go on."""
        fs, path = self._place()
        if not fs.get_file_info(path).is_file:
            return None
        with fs.open_input_stream(path) as f:
            return f.read().decode()

    def clear(self) -> None:
        fs, path = self._place()
        if fs.get_file_info(path).is_file:
            fs.delete_file(path)


def with_retries(fetch: Callable, *args, attempts: int = 5, pause: float = 10.0, ceiling: float = 600.0, sleep: Callable = time.sleep, stop: StopMark | None = None):
    """``fetch(*args)`` gives (status, rows). 429 and 500 up are tried again, 403 stops everything: by ``stop``, all who share the mark."""
    for n in range(attempts):
        if stop is not None and (reason := stop.reason()) is not None:
            raise Forbidden(f"stopped: {reason}")
        status, rows = fetch(*args)
        if status == 403:
            if stop is not None:
                stop.set(str(args))
            raise Forbidden(str(args))
        if status != 429 and status < 500:
            return rows
        if n + 1 < attempts:
            sleep(min(ceiling, pause + random.uniform(0, 2**n)))
    raise TimeoutError(f"{attempts} attempts: {args}")


def offset_pages(fetch: Callable, total: int, size: int = 500, **options) -> Iterator[list[dict]]:
    for start in range(0, total, size):
        yield with_retries(fetch, start, size, **options)


def cursor_pages(fetch: Callable, start: str = "*", mark: int | None = None, newest: str = "timestamp_created", **options) -> Iterator[tuple[str, list[dict]]]:
    """(cursor, rows) of pages until one is empty, a cursor repeats or a page's first row isn't above ``mark``."""
    cursor, seen = start, set()
    while cursor not in seen:
        seen.add(cursor)
        following, rows = with_retries(fetch, cursor, **options)
        if not rows or (mark is not None and rows[0][newest] <= mark):
            return
        yield following, rows
        cursor = following


def read_batches(spark: SparkSession, paths: list[str], schema: str = REVIEW_SCHEMA) -> DataFrame:
    """Rows of landed JSON arrays with their execution id: the folder that a file lies in."""
    rows = spark.read.schema(schema).json(paths, multiLine=True)
    return rows.withColumn("execution_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def parsed_reviews(raw: DataFrame) -> DataFrame:
    """Flat, typed columns of raw records. Counts above 31 bits are a service's -1 and become 0."""
    guard = lambda c: F.when(F.col(c) > UINT32, 0).otherwise(F.coalesce(c, F.lit(0))).cast("int")
    reactions = F.coalesce("reactions", F.array().cast("array<struct<count:int,reaction_type:string>>"))
    rows = raw.filter("recommendationid is not null and trim(review) <> ''")
    return rows.select(
        F.col("recommendationid").alias("recommendation_id"), F.col("author.steamid").alias("author_id"), "language", "review", "voted_up", guard("votes_up").alias("votes_up"),
        guard("votes_funny").alias("votes_funny"), guard("comment_count").alias("comment_count"), F.size(reactions).alias("reaction_type_count"),
        F.aggregate(reactions, F.lit(0), lambda a, x: a + F.coalesce(x["count"], F.lit(0))).alias("reaction_count"), F.col("weighted_vote_score").try_cast("double").alias("weighted_vote_score"),
        F.coalesce("author.playtime_forever", F.lit(0)).alias("playtime_forever"), F.coalesce("author.playtime_at_review", F.lit(0)).alias("playtime_at_review"),
        F.timestamp_seconds("timestamp_created").alias("created_at"), F.timestamp_seconds("timestamp_updated").alias("updated_at"), "refunded", "written_during_early_access",
    )


def export_tables(tables: dict[str, DataFrame], folder: str, skip: tuple[str, ...] = (), kind: str = "parquet") -> dict[str, str]:
    """Writes each table; the name of each that failed with its error. One failure doesn't stop the others."""
    failed = {}
    for name, df in tables.items():
        if name in skip:
            continue
        try:
            df.write.mode("overwrite").options(header=True).format(kind).save(f"{folder}/{name}")
        except Exception as e:  # reported to the caller by name
            failed[name] = str(e)
    return failed
