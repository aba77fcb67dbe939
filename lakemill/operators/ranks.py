"""Percent ranks of keys of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.sources.shared import shared_dir, staged

#: Rows of a key from which its ranks are counted over ranges instead of sorted in one task.
HOT = 5_000_000


def hot_keys(rows: DataFrame, key: str, most: int = HOT) -> DataFrame:
    """Keys of more than ``most`` rows: rows / ``most`` of them at most."""
    return rows.groupBy(key).count().filter(F.col("count") > most).select(key)


def counted_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and percent_rank of all distinct values of each key, as the window function ranks rows (NULLs first).

    Rows are counted by key and value before they are shuffled. Counts are dealt by ranges of both, summed up within a range
    and key, and what a key has in lower ranges is added, so a key's values never meet in one task.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    order = [F.asc_nulls_first(key), F.asc_nulls_first(value)]
    ranged = counts.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, f"{shared_dir(rows.sparkSession)}/ranks-{uuid.uuid4().hex}")  # ranges are fixed from here on
    within = W.partitionBy(key, "range")
    sums = ranged.groupBy(key, "range").agg(F.sum("n").alias("own"))
    lower = sums.select(F.col(key).alias("k"), F.col("range").alias("r"), (F.sum("own").over(W.partitionBy(key).orderBy("range")) - F.col("own")).alias("lower"), F.sum("own").over(W.partitionBy(key)).alias("every"))
    inside = ranged.withColumn("inside", F.sum("n").over(within.orderBy(F.asc_nulls_first(value))) - F.col("n"))
    found = inside.join(lower, F.col(key).eqNullSafe(F.col("k")) & (F.col("range") == F.col("r")))
    ahead = (F.col("lower") + F.col("inside")).cast("double")
    return found.select(key, value, F.when(F.col("every") > 1, ahead / (F.col("every") - 1)).otherwise(0.0).alias("percent_rank"))


def with_counted_ranks(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the percent rank of their value; a value that many rows share is left to the skew join."""
    ranks = counted_ranks(rows, key, value).select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.col("percent_rank").alias(name))
    return rows.join(ranks, F.col(key).eqNullSafe(F.col("__k")) & F.col(value).eqNullSafe(F.col("__v")), "left").drop("__k", "__v")


def window_rank(key: str, value: str) -> Column:
    return F.percent_rank().over(W.partitionBy(key).orderBy(F.asc_nulls_first(value)))
