"""A corpus from raw documents to packed sequences, in five stages. Each one's result is a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import mixing, neardup, packing, quality, queries, suffixes
from lakemill.llm.common import dropped, staged

#: Rows up to which the list of removed near copies (24 bytes each) is broadcast, so no text is shuffled; else it is joined.
GONE = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are: rows are carried along, so none is looked up again.

    A null text has no words and goes; null ids and sources stay if the text is kept; repeated rows are judged alike;
    very long texts are judged whole; an empty table gives no rows. Further columns stay, whatever their names.
    """
    return quality.quality_rules(docs, whole=True).filter("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the least id.

    Texts without words are in no group and stay. Null ids stay where no other id is in the group; of rows repeated in
    id and text the first by its other columns stays. Very long texts are compared whole; an empty table gives no rows. Further columns stay.
    """
    found = neardup.near_duplicates(docs)
    group = F.coalesce(F.col("component_id").cast("string"), F.hex("node"), F.lit(""))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    firsts = found.filter("node is not null").groupBy(group.alias("g")).agg(F.min(place).alias("first"))
    gone = found.filter("node is not null").withColumn("g", group).join(staged(firsts, "pipeline-firsts"), "g").filter(place != F.col("first"))
    gone = staged(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "pipeline-gone")
    keyed = docs.withColumn("__text_hash", neardup.text_digest(F.col("text").cast("string")))
    fits = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text_hash").eqNullSafe(F.col("__hash"))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= GONE else gone, fits, "left_anti")
    twice = found.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    if not twice.isEmpty():
        kept = _first_of_repeats(kept, staged(twice, "pipeline-repeated"), docs.columns)
    return kept.select(*docs.columns)


def _first_of_repeats(keyed: DataFrame, twice: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each repeated id and text: the first by its other columns as JSON, so reruns agree. Other rows stay; only repeats are shuffled, one a task at most."""
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text_hash").eqNullSafe(F.col("__hash"))
    once = keyed.join(twice, same, "left_anti").select(*columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    order = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")), F.lit("").alias("__end")))
    firsts = keyed.join(twice, same, "left_semi").groupBy("doc_id", "__text_hash").agg(F.min_by(whole, order).alias("__row"))
    return once.unionByName(firsts.select(*(F.col("__row").getField(c).alias(c) for c in columns)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes and more that also start elsewhere.

    A null text becomes an empty one; ids, nulls too, and further columns stay; rows repeated in text lose it if it is
    long enough. Very long texts are searched whole; an empty table gives no rows.
    """
    extra = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffixes.without_repeats(docs, keep=extra, with_text=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own, a null or empty text has no words and comes as often as its source's whole copies;
    rows repeated in id and text are taken together; ties of rank go by id; an empty table gives no rows. Further columns stay.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: null texts are empty, ids may be null or repeat, very long texts are cut, an empty table gives no rows."""
    return packing.packed(docs, queries.tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixing_weights),
    ("packing", sequences),
]

#: No SQL: near duplicates, byte-wise removal and token ids can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other. Each one's scratch tables go when its result is written; the last one's stay, as its result reads them."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with dropped(spark) as outlive:
            docs = outlive(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
