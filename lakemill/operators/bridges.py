"""Bridges from lists of ids, as rows carry them, to the members of a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ids_of(value: Column) -> Column:
    """Ids of a list kept as text, ``[12, 5]``; none for NULL, an empty text or what is no list. Ids that aren't whole numbers are left out."""
    listed = F.from_json(value, "array<string>")
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def list_text(ids: Column) -> Column:
    """The text of an array of ids, as ``ids_of`` reads it: ``[12, 5]``."""
    return ids.cast("string")


def bridge(rows: DataFrame, key: str, ids: Column, dimension: DataFrame, id_col: str, member: str) -> DataFrame:
    """key and member of each id that the dimension knows, each pair once. An id without a member gives no row."""
    pairs = rows.select(F.col(key), F.explode(ids).alias("__id")).distinct()
    known = dimension.select(F.col(id_col).cast("bigint").alias("__id"), F.col(member)).filter(F.col(member).isNotNull())
    return pairs.join(known, "__id").select(key, member).distinct()
