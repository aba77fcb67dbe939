"""Drilling from keys to details: which keys come first, what belongs to them, and their best details.

Keys are few by construction (``n`` or ``n`` a group), so they are broadcast: facts are filtered by them before they are
ranked, and only the rows of these keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.operators.cleaning import top_per_group

UNKNOWN = "Unknown"


def first_keys(rows: DataFrame, order: list[Column], n: int, rank: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` first rows, or those of each group, with their rank. ``order`` should be total."""
    if within:
        return top_per_group(rows, list(within), order, n, rank)
    return rows.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)).cast("long"))


def best_details(details: DataFrame, keys: DataFrame, on: str, order: list[Column], n: int, rank: str = "detail_rank", keep: Column | None = None) -> DataFrame:
    """The ``n`` best details of each of a few keys."""
    mine = details.join(F.broadcast(keys.select(on).distinct()), on, "left_semi")
    return top_per_group(mine if keep is None else mine.filter(keep), [on], order, n, rank)


def with_best(keys: DataFrame, details: DataFrame, on: str, order: list[Column], columns: list[str], keep: Column | None = None) -> DataFrame:
    """A few keys, each with the ``columns`` of its best detail, NULL where it has none."""
    best = best_details(details, keys, on, order, 1, "__rank", keep)
    return keys.join(best.select(on, *columns), on, "left")


def member_names(bridge: DataFrame, keys: DataFrame, on: str, member: str, name: str) -> DataFrame:
    """The distinct known members of each of a few keys in order, as one string; NULL without any."""
    mine = bridge.join(F.broadcast(keys.select(on).distinct()), on, "left_semi")
    known = F.nullif(F.col(member), F.lit(UNKNOWN))
    return mine.groupBy(on).agg(F.nullif(F.array_join(F.array_sort(F.collect_set(known)), ", "), F.lit("")).alias(name))


def weighted_members(scores: DataFrame, bridges: dict[str, DataFrame], on: str, measure: str, weight: str, least: int = 0, fan_out: DataFrame | None = None) -> DataFrame:
    """Weighted mean of a measure for each combination of known members, with its number of keys, ``least`` or more.

    ``fan_out``, a bridge of another dimension, repeats a key's rows by its members there: means are weighted by them,
    keys are still counted once.
    """
    rows = scores
    for member, bridge in bridges.items():
        rows = rows.join(bridge.filter(F.col(member) != UNKNOWN), on)
    if fan_out is not None:
        rows = rows.join(fan_out, on)
    mean = F.sum(F.col(measure) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))
    found = rows.groupBy(*bridges).agg(F.count_distinct(on).alias("n_keys"), F.round(mean, 6).alias("mean"))
    return found.filter(F.col("n_keys") >= least)


def members_of_keys(bridges: dict[str, DataFrame], picked: DataFrame, on: str) -> DataFrame:
    """The keys of some picked combinations of members: the bridges, joined on the key, that match all of a combination's members."""
    rows = None
    for member, bridge in bridges.items():
        mine = bridge.join(F.broadcast(picked.select(member).distinct()), member, "left_semi")
        rows = mine if rows is None else rows.join(mine, on)
    return rows.join(F.broadcast(picked), list(bridges)).distinct()
