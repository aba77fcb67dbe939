"""Influence of reviews inside their game and the scores of games."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions.measures import log_ratio, share, shrink, tier, volume_label, weighted_mean
from lakemill.operators.ranks import HOT, hot_keys, window_rank, with_counted_ranks
from lakemill.sources.shared import shared_dir, staged

# Weights of the signals.
COMMUNITY = {"votes_up": 0.45, "votes_funny": 0.20, "comment_count": 0.25, "reaction_count": 0.10}
W_COMMUNITY, W_LENGTH, W_EMOTIONAL, W_PLAYTIME, W_SENTIMENT = 1.5, 0.5, 0.3, 1.0, 1.0

#: Parts that the maxima of a crowded game are first taken over.
SALTS = 64
#: Measures of games that a rollup weighs by sentiment reviews, and by reviews.
BY_SENTIMENT = ("pct_positive", "pct_neutral", "pct_negative", "alignment", "sentiment_rating")
BY_REVIEWS = ("pct_early_access", "pct_bug_reports", "pct_refunded", "weighted_vote_rating", "vote_rating")


def group_stats(reviews: DataFrame, salt: int = 1, key: str = "game_key") -> DataFrame:
    """Maxima and mean playtime of each game; with ``salt`` above 1 in two phases, for keys of very many rows."""
    maxima = [F.max(c).alias(f"max_{c}") for c in COMMUNITY]
    parts = [*maxima, F.max(F.when(F.col("has_credible_text"), F.col("review_length"))).alias("max_review_length"), F.sum("playtime").alias("__sum"), F.count("*").alias("__n")]
    grouped = reviews.groupBy(key) if salt == 1 else reviews.groupBy(key, F.pmod(F.xxhash64("review_key"), F.lit(salt)).alias("__salt"))
    out = grouped.agg(*parts)
    if salt > 1:
        out = out.groupBy(key).agg(*(F.max(c).alias(c) for c in out.columns if c.startswith("max_")), F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    return out.withColumn("avg_playtime", F.col("__sum") / F.col("__n")).drop("__sum", "__n")


def influence(reviews: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds signals, directions and the influence score.

    Group maxima share the window of the percent rank: one shuffle by game. Games of more than ``hot`` reviews are left out
    of it: their maxima are summed up in two phases and their ranks are counted over ranges, so no task gets such a game.
    """
    stats = [*(f"max_{c}" for c in COMMUNITY), "max_review_length", "avg_playtime"]
    # written down, so the optimizer sees how small it is
    crowded = staged(hot_keys(reviews, "game_key", hot), f"{shared_dir(reviews.sparkSession)}/hot-games-{uuid.uuid4().hex}")
    if crowded.isEmpty():
        return _influence(_windowed(reviews)).drop(*stats)
    few, many = (reviews.join(crowded, "game_key", how) for how in ("left_anti", "left_semi"))
    many = with_counted_ranks(many.join(group_stats(many, SALTS), "game_key"), "game_key", "playtime", "playtime_signal")
    rows = _windowed(few)
    return _influence(rows.unionByName(many.select(*rows.columns))).drop(*stats)


def _windowed(reviews: DataFrame) -> DataFrame:
    game = W.partitionBy("game_key")
    tops = {f"max_{c}": F.max(c).over(game) for c in COMMUNITY}
    tops["max_review_length"] = F.max(F.when(F.col("has_credible_text"), F.col("review_length"))).over(game)
    return reviews.withColumns({**tops, "avg_playtime": F.avg("playtime").over(game), "playtime_signal": window_rank("game_key", "playtime")})


def _influence(rows: DataFrame) -> DataFrame:
    credible, eligible, vote = F.col("has_credible_text"), F.col("is_eligible"), F.when(F.col("voted_up"), 1).otherwise(-1)
    community = sum((w * log_ratio(F.col(c), F.col(f"max_{c}")) for c, w in COMMUNITY.items()), F.lit(0.0))
    rows = rows.withColumns({
        "community_signal": community,
        "length_signal": F.when(credible, log_ratio(F.col("review_length"), F.col("max_review_length")) * F.col("unique_word_ratio")),
        "emotional_signal": F.when(credible, F.least(F.col("emotional_intensity"), F.lit(W_EMOTIONAL)) / W_EMOTIONAL),
        "sentiment_signal": F.when(eligible, F.abs("compound")),
        "vote_direction": vote,
        "sentiment_direction": F.when(eligible & (F.col("compound") != 0), F.sign("compound").cast("int")).when(eligible & (F.col("compound") == 0), vote),
    })

    def gated(condition: Column, weight: float) -> Column:
        return F.when(condition, weight).otherwise(0.0)

    terms = [
        (F.lit(W_COMMUNITY), F.col("community_signal")), (gated(credible, W_LENGTH), F.col("length_signal")), (gated(credible, W_EMOTIONAL), F.col("emotional_signal")),
        (gated(F.col("avg_playtime") > 0, W_PLAYTIME), F.col("playtime_signal")), (gated(eligible, W_SENTIMENT), F.col("sentiment_signal")),
    ]
    top = sum((w * F.coalesce(s, F.lit(0.0)) for w, s in terms), F.lit(0.0))
    return rows.withColumn("influence", top / sum((w for w, _ in terms), F.lit(0.0)))


def game_sums(scored: DataFrame) -> DataFrame:
    """Counts, shares, means and sums of influence of each game: all that scores and priors need of reviews, a row a game."""
    w, c = F.col("influence"), F.col("compound")
    return scored.groupBy("game_key").agg(
        F.count("*").alias("total_reviews"), F.count("sentiment_direction").alias("sentiment_reviews"),
        share(c >= 0.05).alias("pct_positive"), share(c <= -0.05).alias("pct_negative"), share((c > -0.05) & (c < 0.05)).alias("pct_neutral"),
        F.sum(w).alias("sum_influence"), F.sum(F.col("sentiment_direction") * w).alias("sum_sentiment"), F.sum(F.col("vote_direction") * w).alias("sum_vote"),
        share(F.col("voted_up")).alias("pct_voted_up"), F.avg("playtime").alias("avg_playtime"), F.avg("emotional_intensity").alias("avg_emotional_intensity"),
        share(F.col("early_access")).alias("pct_early_access"), share(F.col("bug_report")).alias("pct_bug_reports"), share(F.col("refunded")).alias("pct_refunded"), F.avg("word_count").alias("avg_word_count"),
    )


def priors(sums: DataFrame, games: DataFrame) -> DataFrame:
    """One row: priors of sentiment and vote over all reviews, from the sums of their games, and of the external rating."""
    mean = lambda c: (F.sum(c) / F.nullif(F.sum("sum_influence"), F.lit(0)) + 1) / 2
    ours = sums.agg(mean("sum_sentiment").alias("sentiment_prior"), mean("sum_vote").alias("vote_prior"))
    theirs = games.filter("rating > 0").agg((F.avg("rating") / 100).alias("rating_prior"))
    return ours.crossJoin(theirs)  # one row each


def game_scores(sums: DataFrame, games: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Scores of rated games from ``game_sums``: shares, influence-weighted means, shrunk ratings in percent, tiers and a label.

    ``games``: game_key, rating (0 to 100), rating_count. ``known`` overrides the priors.
    """
    prior = F.broadcast(known if known is not None else priors(sums, games))
    whole = F.nullif(F.col("sum_influence"), F.lit(0))
    stats = sums.withColumns({"weighted_sentiment": F.col("sum_sentiment") / whole, "weighted_vote": F.col("sum_vote") / whole}).drop("sum_influence", "sum_sentiment", "sum_vote")
    rated = games.filter("coalesce(rating, 0) > 0 and coalesce(rating_count, 0) > 0")
    rows = rated.join(stats, "game_key", "left").crossJoin(prior)
    half = lambda x: (F.col(x) + 1) / 2
    rows = rows.withColumns({
        "external_rating": 100 * shrink(F.col("rating") / 100, F.col("rating_prior"), F.col("rating_count")),
        "sentiment_rating": 100 * shrink(half("weighted_sentiment"), F.col("sentiment_prior"), F.col("sentiment_reviews")),
        "weighted_vote_rating": 100 * shrink(half("weighted_vote"), F.col("vote_prior"), F.col("total_reviews")),
        "vote_rating": 100 * shrink(F.col("pct_voted_up"), F.lit(0.5), F.col("total_reviews")),
    })
    rows = rows.withColumns({
        "alignment": F.col("sentiment_rating") - F.col("weighted_vote_rating"),
        "external_tier": tier(F.round("external_rating", 2), F.col("rating_count")),
        "sentiment_tier": tier(F.round("sentiment_rating", 2), F.col("sentiment_reviews")),
        "vote_tier": tier(F.round("weighted_vote_rating", 2), F.col("total_reviews")),
        "label": volume_label(F.round("vote_rating", 2), F.col("total_reviews")),
    })
    return rows.drop("sentiment_prior", "vote_prior", "rating_prior")


def member_rollup(scores: DataFrame, members: DataFrame, member: str, reviewed: bool = True) -> DataFrame:
    """Count-weighted means of game scores for each member of a dimension, ``Unknown`` left out. ``members``: game_key, member.

    External ratings weigh by rating counts, sentiment measures by sentiment reviews, others by reviews; playtime is a
    mean of means. Without ``reviewed`` only the external rating is summed up.
    """
    joined = scores.join(members, "game_key").filter(F.col(member) != "Unknown")
    n, s, r = F.col("total_reviews"), F.col("sentiment_reviews"), F.col("rating_count")
    ours = [F.count("external_rating").alias("rated_games"), weighted_mean(F.col("external_rating"), r).alias("external_rating"), F.sum("rating_count").alias("rating_count")]
    if reviewed:
        ours += [F.count("total_reviews").alias("reviewed_games"), F.sum("total_reviews").alias("total_reviews"), F.sum("sentiment_reviews").alias("sentiment_reviews"), F.avg("avg_playtime").alias("avg_playtime")]
        ours += [weighted_mean(F.col(c), s).alias(c) for c in BY_SENTIMENT] + [weighted_mean(F.col(c), n).alias(c) for c in BY_REVIEWS]
    return joined.groupBy(member).agg(*ours)
