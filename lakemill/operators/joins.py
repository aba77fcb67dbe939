"""Joins and aggregates of skewed keys, lookups, ranks over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes up to which a dimension is broadcast; above, the optimizer decides.
SMALL = 64 << 20


def size_bound(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a plan at most: of files their size, of joins the product of their sides. Nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """A join to a dimension that is broadcast if its plan is bounded by ``most`` bytes; it is evaluated once, by the join."""
    return facts.join(F.broadcast(dimension) if size_bound(dimension) <= most else dimension, on, how)


def key_salts(df: DataFrame, key: str, rows_per_salt: int, most: int = 256) -> DataFrame:
    """key, n and salts of the keys of more than ``rows_per_salt`` rows: as many salts as its rows fill, ``most`` at most."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_salt)
    return counts.withColumn("salts", F.least(F.ceil(F.col("n") / rows_per_salt), F.lit(most)).cast("int"))


def salted_join(big: DataFrame, other: DataFrame, key: str, spread: Column, salts: DataFrame) -> DataFrame:
    """An inner equi-join in which rows of a hot key are dealt over its salts by a hash of ``spread``; the other side's rows are repeated for these keys alone.

    ``salts``: key and salts of hot keys, a row for each ``rows_per_salt`` rows of ``key_salts`` at most; they are left to
    the optimizer, which sees their size at run time. Null keys join nothing. The salted sides are merged, not broadcast.
    """
    hot = salts.select(F.col(key).alias("__hot"), "salts")
    left = big.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("salts"))).cast("int")).drop("__hot", "salts")
    right = other.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("__hot", "salts")
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def resolve_external(ids: DataFrame, games: DataFrame, source: str) -> DataFrame:
    """External ids of one source with the game they stand for: single numeric ids only, the least game of an id."""
    known = ids.filter((F.col("source") == source) & ~F.col("external_id").contains(",") & F.col("external_id").try_cast("bigint").isNotNull())
    return known.join(games, "game_key").groupBy("external_id").agg(F.min("game_key").alias("game_key"), F.min_by("game_name", "game_key").alias("game_name"))


def ranked_aggregate(df: DataFrame, keys: list[str], measure: Column, order_within: list[str], rank: str = "rank") -> DataFrame:
    """A sum by keys and its dense rank among the keys that share ``order_within``."""
    sums = df.groupBy(*keys).agg(measure.alias("measure"))
    return sums.withColumn(rank, F.dense_rank().over(W.partitionBy(*order_within).orderBy(F.desc("measure"))).cast("long"))
