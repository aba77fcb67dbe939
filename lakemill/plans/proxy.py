"""Reviews, games and their dimensions, from order lines and parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REVIEW = {
    "review_key": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "game_key": "l_partkey",
    "voted_up": "l_returnflag <> 'R'",
    "votes_up": "cast(l_quantity as bigint)",
    "votes_funny": "cast(l_linenumber as bigint)",
    "comment_count": "cast(round(l_tax * 100) as bigint)",
    "reaction_count": "cast(l_suppkey % 5 as bigint)",
    "review_length": "cast(l_quantity * 10 as bigint)",
    "has_credible_text": "l_linestatus = 'O'",
    "unique_word_ratio": "1 - l_tax",
    "emotional_intensity": "l_discount * 5",
    "is_eligible": "l_linestatus = 'O' and l_returnflag <> 'N'",
    "compound": "(l_quantity - 25) / 25",
    "playtime": "l_extendedprice",
    "early_access": "l_linenumber = 7",
    "bug_report": "l_suppkey % 11 = 0",
    "refunded": "l_linenumber = 6",
    "word_count": "cast(l_quantity * 2 as bigint)",
    "review_text": "concat('Order ', l_orderkey, ' of part ', l_partkey, ' from supplier ', l_suppkey, ' came back as ', l_returnflag)",
}


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{sql} as {name}" for name, sql in REVIEW.items()))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as game_key", "p_name as game_name", "cast(p_size * 2 as double) as rating", "cast(p_partkey % 40 as bigint) as rating_count")


def members(spark: SparkSession, sf_dir: str, dimension: str) -> DataFrame:
    """(game_key, member) of one of genre, theme and platform."""
    part = table(spark, sf_dir, "part")
    value = {"genre": F.col("p_type"), "theme": F.explode(F.split("p_name", " ")), "platform": F.col("p_brand")}[dimension]
    return part.select(F.col("p_partkey").alias("game_key"), value.alias(dimension)).distinct()
