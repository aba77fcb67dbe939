"""Sentinels, deduplication and id guards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Strings that mean NULL, exact and case-sensitive.
SENTINELS = ("", "na", "n/a", "not available", "unknown", "null")


def null_sentinels(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*SENTINELS), F.col(c)) for c in columns})


def valid_id(column: Column) -> Column:
    return column.cast("string").try_cast("int").isNotNull()


def dedup_latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row a key: the first by ``newest``, which should order rows totally."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("__rn", first).filter("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= n)
