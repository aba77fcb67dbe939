"""Trees fitted on labelled URLs judge held-out ones of other hosts, whatever their suffix."""

from pyspark.sql import functions as F

from lakemill.llm import queries as Q
from lakemill.llm.urls import labelled_urls, url_filter

OTHERS = "harbour painting orchard novel theatre valley recipe railway choir meadow".split()


def verdicts(asked, known):
    return {x.page_id: x.verdict for x in url_filter(asked, (), labelled=known).collect()}


def test_held_out_hosts_and_suffixes(spark):
    known = labelled_urls(spark)
    held = labelled_urls(spark, 1000, seed=77, words=OTHERS).withColumn("page_id", F.monotonically_increasing_id()).cache()
    truth = {x.page_id: ("allow", "block")[x.label] for x in held.collect()}
    got = verdicts(held, known)
    assert sum(got[i] == t for i, t in truth.items()) >= 0.95 * len(truth)
    com = verdicts(held.withColumn("url", F.regexp_replace("url", r"\.[a-z]+/", ".com/")), known)
    assert sum(com[i] == t for i, t in truth.items()) >= 0.95 * len(truth)
    held.unpersist()


def test_the_suffix_alone_blocks_nothing(spark):
    """Ordinary pages of a domain of which the rules block a part stay."""
    got = Q.QUERIES["op8_url_filter"](spark, "/root/testdata/sf0.01").filter("rule is null and host like '%.com'")
    counts = {x.verdict: x["count"] for x in got.groupBy("verdict").count().collect()}
    assert counts and counts.get("allow", 0) > counts.get("block", 0)


def test_labels_don_t_depend_on_runs(spark):
    a, b = (sorted(map(tuple, labelled_urls(spark, 50).collect())) for _ in range(2))
    assert a == b and sum(x[1] for x in a) == 25
