"""Quality rules with cross-document line frequency (operator 3). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import WORD, let, staged, words

#: A line is frequent on its host above both: so many distinct documents, and this share of the host's.
MIN_DOCUMENTS, SHARE = 25, 0.05
#: A document is depleted if less than this share of its words is left without its frequent lines.
LEFT = 0.3
SYMBOLS = "#*$%&|<>"


def normalised(line: Column) -> Column:
    """Lower-cased, digits as 0, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the words' hashes, in n log n."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(h) - 2, F.lit(1)))
        own = F.transform(at, lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i), F.get(h, i + 1)))
        return F.when(F.size(h) < 3, F.lit(0)).otherwise(let(own, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: let(F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(
            x["i"].alias("i"),
            ((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])).alias("twice"),
        )), lambda x: F.coalesce(x["twice"], F.lit(False))), lambda x: x["i"])), lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)))

    return let(hashes, windows).cast("long")


def line_signals(docs: DataFrame, id_col: str, text_col: str, host_col: str, whole: bool = False) -> DataFrame:
    """A row for each document: the counts, a digest of its text, hash and words of each line that has a word; narrow, or with the ``whole`` row as a struct."""
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), *carried)
    carried = ["row"] if whole else []
    dense = F.translate("text", " \t\n\v\f\r", "")
    lines = let(F.split("text", "\n"), lambda x: F.filter(x, lambda y: y.rlike(WORD)))
    hashes = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        repeated_words(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
    ))
    own = let(lines, lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(x, lambda y: F.xxhash64(normalised(y))).alias("lines"),
        F.transform(x, lambda y: F.regexp_count(y, F.lit(WORD))).alias("line_words"),
    ))
    rows = rows.select("doc_id", "host", "digest", F.length(dense).cast("long").alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), hashes.alias("w"), own.alias("l"), *carried)
    return rows.select("doc_id", "host", "digest", "word_chars", "n_symbols", "w.*", "l.*", *carried)


def frequent_lines(signals: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """host and the array of its frequent lines' hashes.

    Exact copies of a document count as one: a document stands in the counts by a digest of its whole text, both for the
    line and for the host. Distinct (host, line, digest) are counted in two steps, so a line of a third of all documents
    meets in no single task. A host has at most (lines a document) / ``share`` frequent lines.
    """
    seen = signals.select("host", "digest", F.explode(F.array_distinct("lines")).alias("line"))
    seen = seen.groupBy("host", "line", "digest").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("documents"))
    hosts = signals.groupBy("host", "digest").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all"))
    often = seen.filter(F.col("documents") > min_documents).join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return often.filter(F.col("documents") > share * F.col("all")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("frequent"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeats: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", signals: DataFrame | None = None, frequent: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Counts, base_failed, n_removed_words and kept of every document, and its ``whole`` row as a struct if asked for.

    A document fails the base rules with fewer than ``min_words`` words or more than ``max_repeats`` percent of them
    in repeated 3-word windows. Else it is kept unless its host's frequent lines leave it depleted. Nulls: a null
    text has no words, a null host is one of its own, a null id stays. Repeated rows are judged alike, very long texts
    whole, further columns don't matter, an empty table gives no rows. Word windows and lines are compared by 64-bit hashes.
    """
    signals = staged(line_signals(docs, id_col, text_col, host_col, whole), "quality-signals") if signals is None else signals
    frequent = staged(frequent_lines(signals), "quality-lines") if frequent is None else frequent
    rows = signals.join(frequent.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")
    hits = F.coalesce(F.array_intersect("lines", "frequent"), F.array().cast("array<bigint>"))
    lost = let(hits, lambda h: F.when(F.size(h) == 0, F.lit(0)).otherwise(F.aggregate(F.arrays_zip("lines", "line_words"), F.lit(0), lambda a, x: a + F.when(F.array_contains(h, x["lines"]), x["line_words"]).otherwise(0)))).cast("long")
    rows = rows.withColumn("n_removed_words", lost)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < LEFT * F.col("n_words")
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *(["row"] if whole else []))


def without_frequent_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` whose texts lack their host's frequent lines; all columns stay, rows without one are unchanged."""
    lines = F.split(F.col(text_col), "\n")
    joined = docs.join(frequent.select(F.col("host").alias("__host"), F.col("frequent").alias("__frequent")), F.col(host_col).eqNullSafe(F.col("__host")), "left")
    key = lambda y: F.when(y.rlike(WORD), F.xxhash64(normalised(y)))
    left = let(lines, lambda x: let(F.array_intersect(F.transform(x, key), F.col("__frequent")), lambda h: F.when(F.size(h) == 0, F.col(text_col)).otherwise(F.array_join(F.filter(x, lambda y: ~F.coalesce(F.array_contains(h, key(y)), F.lit(False))), "\n"))))
    return joined.withColumn(text_col, F.when(F.col("__frequent").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
