"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it reaches) of every node that has an edge to another; ``edges`` has a and b.

    Each round hangs all nodes on smaller neighbours, so long chains shrink in about log n rounds. Minima are
    pre-aggregated and a hot node's edges are only joined, which can be split; no neighbourhood is collected. Each
    round is a written table. Null ends and loops are ignored.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    last = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("of")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # now a < b in every edge: b's smaller neighbours hang on the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("of"), "m")
        hung = large.join(least, F.col("b") == F.col("of")).select("a", "b", "m")
        small = hung.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = staged(small, "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        last = state
