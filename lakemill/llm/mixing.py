"""Mixing sources to target weights by Pareto order sampling (operator 4). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.common import WORD, staged

#: Each of two passes narrows a source's cut to one of so many ranges of the random rank.
RANGES = 512
#: Levels of emphasis above and below 1, in eighths of an octave.
LEVELS = 512


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, take the weights in turn. ``share`` of all words is dealt by weight; a target
    stops at ``ceiling`` times its source's size and the excess is dealt again, until none is above: that is a common
    level of target by weight, found over sources sorted by the level at which they stop.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn % len(weights) + 1).cast("int"))
    known = sums.withColumn("weight", cases).withColumn("stop", ceiling * F.col("source_size"))
    ordered = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0.0)
    left = share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("stop").over(before), zero)
    level = left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), zero))
    known = known.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.col("level"))
    target = F.least("stop", F.coalesce(F.max(fits).over(everywhere) * F.col("weight"), F.col("stop")))
    return known.withColumn("target", target).select("source", "source_size", "target")


def uniform(id_: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1): a hash of seed, id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), id_.cast("string"), text).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """The odds of ``u`` over those of ``inclusion``, as a number x / (1 + x): 0 where inclusion is certain, 1 where it is out."""
    return u * (1 - inclusion) / (u * (1 - inclusion) + (1 - u) * inclusion)


def sized_rows(docs: DataFrame, seed: str, emphasis: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (the document), doc_id, source, size, u and level: its emphasis in eighths of an octave, null if it has none."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), uniform(F.col(id_col), text, seed).alias("u"), (F.lit(None).cast("double") if emphasis is None else emphasis.cast("double")).alias("e"))
    own = F.log2(2.0 + F.col("size")) if emphasis is None else F.col("e")
    level = F.when(own > 0, F.least(F.greatest(F.round(8 * F.log2(own)), F.lit(-LEVELS)), F.lit(LEVELS)).cast("int"))
    return rows.withColumn("level", level).drop("e")


def inclusion_scales(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source and scale: documents are included with probability min(1, scale * emphasis), whose words add up to the source's quota."""
    sums = sized.filter("level is not null").groupBy("source", "level").agg(F.sum("size").alias("words"))
    sums = _by_source(sums, targets.select("source", "quota")).withColumn("e", F.pow(F.lit(2.0), F.col("level") / 8))
    below = W.partitionBy("source").orderBy(F.desc("level"))
    before = below.rowsBetween(W.unboundedPreceding, -1)
    rest = below.rowsBetween(W.currentRow, W.unboundedFollowing)
    scale = (F.col("quota") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("e") * F.col("words")).over(rest)
    sums = sums.withColumn("scale", F.when(F.sum(F.col("e") * F.col("words")).over(rest) > 0, scale))
    return sums.filter(F.col("scale") * F.col("e") <= 1).groupBy("source").agg(F.max("scale").alias("scale"))


def _place() -> Column:
    """A document's place in its source: by rank, then id (null first) and size."""
    return F.struct("rank", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")


def _by_source(rows: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(known.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def ranked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the columns of ``known`` (by source), the rank and its fine range."""
    rows = _by_source(rows, known)
    inclusion = F.when(F.col("level").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("scale", F.lit(1.0)) * F.pow(F.lit(2.0), F.col("level") / 8)))
    rows = rows.withColumn("rank", pareto_rank(F.col("u"), inclusion))
    return rows.withColumn("fine", F.least(F.floor(F.col("rank") * RANGES * RANGES), F.lit(RANGES * RANGES - 1)).cast("long"))


def source_plan(sized: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """For each source its size, target, certain copies, quota, scale, and the place in the rank at which the quota is full."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(sized, weights, share, ceiling).withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = staged(targets, "mix-targets")
    targets = staged(_by_source(targets, inclusion_scales(sized, targets), "left"), "mix-scales")

    def crossing(sums: DataFrame, key: str) -> DataFrame:
        """The range of each source in which its words pass the quota, and the words before it."""
        reached = F.sum("words").over(W.partitionBy("source").orderBy(key))
        cum = sums.withColumn("before", F.col("before") + reached - F.col("words"))
        return cum.filter((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("words") > F.col("quota")))

    rows = ranked(sized, targets.select("source", "quota", "scale"))
    coarse = F.floor(F.col("fine") / RANGES).cast("long")
    sums = rows.groupBy("source", "quota", coarse.alias("coarse")).agg(F.sum("size").alias("words"))
    first = staged(crossing(sums.withColumn("before", F.lit(0).cast("long")), "coarse").select("source", "before", "coarse"), "mix-cut")
    near = _by_source(rows.withColumn("at", coarse), first).filter(F.col("at") == F.col("coarse"))
    sums = near.groupBy("source", "quota", "before", "fine").agg(F.sum("size").alias("words"))
    second = staged(crossing(sums, "fine").select("source", "before", F.col("fine").alias("cut")), "mix-cut")
    peers = _by_source(rows, second).filter(F.col("fine") == F.col("cut")).groupBy("source", "quota", "before", "rank", "doc_id", "size").agg(F.sum("size").alias("words"))
    reached = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size"))
    peers = peers.withColumn("reached", reached)
    nearer = F.abs(F.col("reached") - F.col("quota")) < F.abs(F.col("quota") - (F.col("reached") - F.col("words")))
    taken = (F.col("reached") <= F.col("quota")) | ((F.col("reached") - F.col("words") <= F.col("quota")) & nearer)
    last = peers.filter(taken).groupBy("source").agg(F.max(_place()).alias("last"))
    return staged(_by_source(_by_source(targets, second.select("source", "cut"), "left"), last, "left"), "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the columns of the plan, rank and copies."""
    rows = ranked(rows, plan)
    extra = (F.col("quota") > 0) & (F.col("cut").isNull() | (F.col("fine") < F.col("cut")) | ((F.col("fine") == F.col("cut")) & F.coalesce(_place() <= F.col("last"), F.lit(False))))
    return rows.withColumn("copies", F.col("whole") + F.when(extra, 1).otherwise(0))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix",
    emphasis: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, rank, size, source_size, target, copies and taken of every document.

    A document of a source with r = target / source_size gets floor(r) certain copies. The rest of the target is a
    Pareto order sample: a document's inclusion probability is in proportion to its ``emphasis`` (log2 of 2 + size if not
    given: longer texts are preferred, mildly), one at most, such that the words expected are the rest; documents are ranked by
    their random odds over their inclusion odds and taken in that order until the source's words are full; the one at
    the border is taken if that comes nearer. The cut is found from sums over ranges of the rank, so no source meets in
    one task. Random numbers are a hash of seed, id and text: reruns agree, rows repeated in full share one rank and are
    taken together, ties of rank go by id and size. A null text has size 0, a null source is one of its own, a null or
    non-positive emphasis is included last, ids may be null and of any type that can be ordered. Very long texts are
    counted whole, further columns don't matter, an empty table gives no rows.
    """
    sized = staged(sized_rows(docs, seed, emphasis, id_col, text_col, source_col).drop("row"), "mix-sizes")
    out = with_copies(sized, source_plan(sized, weights, share, ceiling))
    return out.select("doc_id", "source", "rank", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix",
    emphasis: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it: what only depends on the row is computed again, so no text is shuffled."""
    rows = sized_rows(docs, seed, emphasis, id_col, text_col, source_col)
    plan = source_plan(staged(rows.drop("row"), "mix-sizes"), weights, share, ceiling)
    taken = with_copies(rows, plan).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
