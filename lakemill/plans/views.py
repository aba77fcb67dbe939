"""The serving views over the test tables, in order of dependency, and the same as CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.functions.measures import playtime_bucket, sentiment_label
from lakemill.operators.scoring import game_scores, game_sums, influence
from lakemill.plans import proxy
from lakemill.sources.shared import Views

VIEWS = Views()
FACTS = ("review_key", "game_key", "voted_up", "votes_up", "votes_funny", "comment_count", "reaction_count", "review_length", "word_count", "is_eligible", "has_credible_text", "bug_report", "refunded", "early_access", "review_text", "vote_direction")


def fact_reviews(scored: DataFrame, games: DataFrame) -> DataFrame:
    """The presentation of reviews: rounded, with the game's name, a playtime bucket and a sentiment label."""
    rows = scored.join(games.select("game_key", "game_name"), "game_key")
    return rows.select(
        *FACTS, "game_name", F.round("influence", 6).alias("influence"), F.round("compound", 4).alias("compound"), F.round(F.col("playtime") / 60, 4).alias("playtime_hours"),
        sentiment_label(F.col("compound")).alias("sentiment_label"), playtime_bucket(F.col("playtime_signal")).alias("playtime_bucket"),
    )


def _bridge(dimension: str):
    """Games with their members of a dimension, ``Unknown`` where there is none."""
    return lambda spark, folder: proxy.games(spark, folder).select("game_key").join(proxy.members(spark, folder, dimension), "game_key", "left").fillna("Unknown", [dimension])


VIEWS.add("games", ("part",), kept=False)(proxy.games)
VIEWS.add("reviews", ("lineitem",), kept=False)(proxy.reviews)
VIEWS.add("loads", ("events",), kept=False)(lambda spark, folder: proxy.table(spark, folder, "events"))
VIEWS.add("customers", ("customer",), kept=False)(lambda spark, folder: proxy.table(spark, folder, "customer"))
for _one in ("genre", "theme", "platform"):
    VIEWS.add(f"{_one}s", ("part",))(_bridge(_one))
# influence is computed once; scores come from a row a game
VIEWS.add("scored", views=("reviews",))(lambda spark, folder, v: influence(v["reviews"]))
VIEWS.add("sums", views=("scored",))(lambda spark, folder, v: game_sums(v["scored"]))
VIEWS.add("scores", views=("sums", "games"))(lambda spark, folder, v: game_scores(v["sums"], v["games"]))
VIEWS.add("facts", views=("scored", "games"), kept=False)(lambda spark, folder, v: fact_reviews(v["scored"], v["games"]))
