"""Sentiment of long texts: time grows with their words, not with the square."""

import time

import pytest
from pyspark.sql import functions as F

from lakemill.functions import sentiment
from lakemill.functions.text import CLEANING, clean_text


def test_a_long_text_is_scored_in_time(spark):
    words = ("the game is VERY good, but they don't like it and some parts were terrible! " * 3000).split()
    texts = [" ".join(words), " ".join(words[:9]), "", " ".join(["plain"] * 50_000), "NOT GOOD", "'' ' good"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    sentiment.with_sentiment(rows.filter("n = 1"), F.col("t")).collect()
    began = time.time()
    got = sentiment.with_sentiment(rows, F.col("t")).orderBy("n").collect()
    assert time.time() - began < 20
    for x in got:
        assert tuple(x.sentiment) == pytest.approx(sentiment.score(x.t), abs=1e-9), x.n


def test_a_word_whose_booster_takes_all_its_valence_is_neutral(spark):
    own = spark.createDataFrame([("so", 3.0), ("blue", 0.293), ("grey", 0.0), ("good", 2.0)], "word string, valence double")
    text = "so grey, slightly blue but good blue"
    row = sentiment.with_sentiment(spark.createDataFrame([(text,)], "t string"), F.col("t"), own).first()
    assert tuple(row.sentiment) == pytest.approx(sentiment.score(text, {"so": 3.0, "blue": 0.293, "grey": 0.0, "good": 2.0}))


def test_cleaning_takes_out_the_same_characters(spark):
    """Ranges say the same of ASCII as what is none of some."""
    negated = list(CLEANING)
    negated[1] = (r"(?:[^A-Za-z0-9\s!?]\s*+){3,}+|#|https?://\S+", "")
    texts = [f"{chr(a)}{chr(b)}x{chr(a)} {chr(a)}{chr(b)}" for a in range(1, 128) for b in (*range(9, 14), *range(28, 48), 58, 63, 64, 95, 96, 127)]
    want = F.col("t")
    for pattern, new in negated:
        want = F.regexp_replace(want, pattern, new)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_text(F.col("t")).alias("got"), F.trim(want).alias("want"))
    assert rows.filter("got <> want").isEmpty()
