"""Surrogate keys and row hashes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for NULL, so that rows that differ in which column is NULL differ in hash.
NULL_MARK = "\x00"


def _joined(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns))


def surrogate_key(*columns: str) -> Column:
    return F.md5(_joined(columns).cast("binary"))


def row_hash(*columns: str) -> Column:
    return F.sha2(_joined(columns).cast("binary"), 256)


def name_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (a UUID), by built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("string").cast("binary")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
