"""Time limits of stages, a stop that all readers share, and sentiment on the JVM against its plain form."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lakemill.functions import sentiment
from lakemill.plans.dag import Run, Stage, StageTimeout, execute
from lakemill.sources import landing, tables


def test_a_hanging_stage_ends_and_is_tried_again(spark):
    tries = []

    def work(run):
        tries.append(1)
        if len(tries) == 1:
            spark.range(4, numPartitions=4).mapInPandas(lambda batches: (time.sleep(120) or b for b in batches), "id long").count()
        return len(tries)

    begin = time.time()
    run = execute([Stage("slow", work, retries=1, limit=15), Stage("next", lambda r: r.results["slow"] + 1)], Run(), spark)
    assert run.results == {"slow": 2, "next": 3} and time.time() - begin < 100
    deadline = time.time() + 30
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()  # the jobs of the first attempt were cancelled
    with pytest.raises(StageTimeout):
        execute([Stage("hangs", lambda r: time.sleep(60), limit=0.2)], Run(), spark)


def test_refusals_are_not_tried_again():
    tries = []

    def refused(run):
        tries.append(1)
        raise landing.Forbidden("403")

    with pytest.raises(landing.Forbidden):
        execute([Stage("fetch", refused, retries=3)], Run())
    assert len(tries) == 1


def test_one_refusal_stops_all_partitions(spark, tmp_path):
    mark, asked = landing.StopMark(str(tmp_path / "stop")), str(tmp_path / "asked")
    (tmp_path / "asked").mkdir()

    def fetch(start, size):
        with open(f"{asked}/{start}", "a") as f:
            f.write("x")
        return (403, None) if start == 0 else (200, [{"id": start}])

    tables.paged_source(spark, "refusing_pages", "id long", ["id"], lambda o: tables.PagedReader(fetch, 200, 5, ["id"], mark))
    with pytest.raises(Exception, match="Forbidden|stopped"):
        spark.read.format("refusing_pages").load().coalesce(1).collect()  # in order: the first page is refused
    assert [p.name for p in (tmp_path / "asked").iterdir()] == ["0"] and mark.reason() == "(0, 5)"
    with pytest.raises(landing.Forbidden):
        landing.with_retries(lambda: (200, []), stop=mark)
    mark.clear()
    assert mark.reason() is None and landing.with_retries(lambda: (200, [1]), stop=mark) == [1]


def test_sentiment_equals_its_plain_form(spark):
    rng = random.Random(5)
    words = [*rng.sample(sorted(sentiment.LEXICON), 60), *sentiment.BOOSTERS, *sorted(sentiment.NEGATIONS)[:8], "but", "the", "game", "don't", "ISN'T", "é", "42"]
    texts = [" ".join(rng.choice([str, str.upper, str.title])(rng.choice(words)) + rng.choice(["", "", "!", "?", "!!", ","]) for _ in range(rng.randrange(12))) for _ in range(600)]
    texts += ["", "?", "!!!", "GOOD", "Good", "not good", "GOOD game", "good but terrible", "very VERY good!!!!!", "Ärger good", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = sentiment.with_sentiment(rows, F.col("t"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for x in got.collect():
        want = (None,) if x.t is None else sentiment.score(x.t)
        assert (x.sentiment is None) == (x.t is None) and (x.t is None or tuple(x.sentiment) == pytest.approx(want, abs=1e-9)), x.t


def test_lexicons_are_tables_of_checked_size(spark):
    forms = sentiment.LEXICON
    assert all(w in forms for w in ("enjoyed", "enjoying", "loves", "hated", "wasting", "disappointing", "happier", "saddest", "funniest", "problems", "worries", "worried", "recommended", "crashes", "sadly", "happily"))
    assert forms["happiest"] > forms["happier"] > forms["happy"] and forms["worst"] < forms["worse"] < 0
    own = spark.createDataFrame([("blue", 2.0), ("blue", -1.0), (None, 1.0), ("red", None)], "word string, valence double")
    row = sentiment.with_sentiment(spark.createDataFrame([("a blue day, good",)], "t string"), F.col("t"), own).first()
    assert tuple(row.sentiment) == pytest.approx(sentiment.score("a blue day, good", {"blue": -1.0}))
    with pytest.raises(sentiment.LexiconTooLarge):
        sentiment.with_sentiment(spark.range(1).withColumn("t", F.lit("x")), F.col("t"), own, most=0)
