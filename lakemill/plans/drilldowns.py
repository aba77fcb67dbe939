"""Drilldowns from games and members to reviews, as operators over the serving views; the SQL is the oracle's own formulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.measures import TIERS
from lakemill.operators.cleaning import top_per_group
from lakemill.operators.drill import UNKNOWN, best_details, first_keys, member_names, members_of_keys, weighted_members, with_best
from lakemill.operators.scoring import member_rollup
from lakemill.plans import catalogue
from lakemill.plans.findings import CTES, ENOUGH, RATINGS, REVIEW
from lakemill.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REVIEW_COLUMNS = REVIEW.split(", ")
_RATED = ("external_rating", "sentiment_rating", "weighted_vote_rating", "vote_rating", "alignment")


def drilldown(sql: str, name: str | None = None):
    """Registers a function of a view getter; ``sql`` is said over the same views."""

    def register(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(lambda view: VIEWS.get(spark, sf_dir, view))
        ORACLES[name or f.__name__] = CTES + sql
        return f

    return register


def ratings() -> list[Column]:
    return [F.round(c, 4).alias(c) for c in _RATED]


def best_first() -> list[Column]:
    return [F.desc("influence"), F.asc("review_key")]


def by(measure: str, falling: bool = True) -> list[Column]:
    """The order of games by a measure, ties by key; six digits, so no sum's last bit decides. Games without it come last either way, as in the SQL."""
    value = F.round(measure, 6)
    return [value.desc_nulls_last() if falling else value.asc_nulls_last(), F.asc("game_key")]


def _sql_by(measure: str, falling: bool = True) -> str:
    return f"round({measure}, 6){' desc' if falling else ''}, game_key"


# the best reviews of the first games
def _reviews_of_games(name: str, measure: str, falling: bool, keep: str | None) -> None:
    where = f"where {keep}" if keep else ""

    @drilldown(f"""select game_rank, row_number() over (partition by game_key order by influence desc, review_key) as review_rank, {REVIEW} from facts
      join (select game_key, row_number() over (order by {_sql_by(measure, falling)}) as game_rank from scores where total_reviews >= {ENOUGH} qualify game_rank <= 5) using (game_key) {where} qualify review_rank <= 5""", name)  # fmt: skip
    def run(view):
        games = first_keys(view("scores").filter(F.col("total_reviews") >= ENOUGH).select("game_key", measure), by(measure, falling), 5, "game_rank")
        best = best_details(view("facts"), games, "game_key", best_first(), 5, "review_rank", F.expr(keep) if keep else None)
        return best.join(F.broadcast(games), "game_key").select("game_rank", "review_rank", *REVIEW_COLUMNS)


_reviews_of_games("best_reviews_of_top_games", "sentiment_rating", True, None)
_reviews_of_games("misaligned_reviews", "alignment", False, "sign(compound) <> vote_direction")
_reviews_of_games("aligned_reviews", "alignment", True, "sign(compound) = vote_direction")


@drilldown(f"""select game_rank, row_number() over (partition by game_key order by votes_funny desc, review_key) as review_rank, game_name, review_text, voted_up, votes_funny, sentiment_label from facts
  join (select game_key, row_number() over (order by round(avg(votes_funny), 6) desc, game_key) as game_rank from facts group by game_key having count(distinct review_key) >= {ENOUGH} qualify game_rank <= 5) using (game_key) qualify review_rank <= 5""")
def funny_reviews_of_funniest_games(view):
    funny = view("facts").groupBy("game_key").agg(F.avg("votes_funny").alias("mean"), F.count_distinct("review_key").alias("n")).filter(F.col("n") >= ENOUGH)
    games = first_keys(funny, by("mean"), 5, "game_rank").select("game_key", "game_rank")
    best = best_details(view("facts"), games, "game_key", [F.desc("votes_funny"), F.asc("review_key")], 5, "review_rank")
    return best.join(F.broadcast(games), "game_key").select("game_rank", "review_rank", "game_name", "review_text", "voted_up", "votes_funny", "sentiment_label")


# games of members of a dimension
_WEIGHTED = "round(sum(sentiment_rating * sentiment_reviews) / nullif(sum(sentiment_reviews), 0), 6)"


def _of_dimension(one: str, many: str) -> None:
    @drilldown(f"""select {one}, member_rank, row_number() over (partition by {one} order by {_sql_by('sentiment_rating')}) as game_rank, game_name, rating_count, total_reviews, {RATINGS}, round(pct_bug_reports, 6) as pct_bug_reports
      from scores join {many} using (game_key) join (select {one}, row_number() over (order by {_WEIGHTED} desc, {one}) as member_rank from scores join {many} using (game_key) where {one} <> 'Unknown' group by {one} qualify member_rank <= 5) using ({one}) qualify game_rank <= 5""", f"top_games_of_top_{many}")  # fmt: skip
    def leaders(view):
        scores, bridge = view("scores"), view(many)
        members = first_keys(weighted_members(scores, {one: bridge}, "game_key", "sentiment_rating", "sentiment_reviews"), [F.desc("mean"), F.asc(one)], 5, "member_rank").select(one, "member_rank")
        games = scores.join(members_of_keys({one: bridge}, members, "game_key"), "game_key")
        return first_keys(games, by("sentiment_rating"), 5, "game_rank", (one,)).select(one, "member_rank", "game_rank", "game_name", "rating_count", "total_reviews", *ratings(), F.round("pct_bug_reports", 6).alias("pct_bug_reports"))

    told = ["influence", "votes_up", "votes_funny", "comment_count", "reaction_count", "playtime_hours", "word_count", "review_text"]

    @drilldown(f"""select picked, game_rank, t.game_name, round(sentiment_rating, 4) as sentiment_rating, total_reviews,
        (select string_agg(distinct nullif({one}, 'Unknown'), ', ' order by nullif({one}, 'Unknown')) from {many} m where m.game_key = t.game_key) as members, {', '.join('r.' + c for c in told)}
      from (select {one} as picked, game_key, game_name, sentiment_rating, total_reviews, row_number() over (partition by {one} order by {_sql_by('sentiment_rating')}) as game_rank
        from scores join {many} using (game_key) where {one} in (select distinct {one} from {many} where {one} <> 'Unknown' order by {one} limit 3) qualify game_rank <= 3) t
      left join (select * from facts where is_eligible qualify row_number() over (partition by game_key order by influence desc, review_key) = 1) r using (game_key)""", f"{one}_drilldown")  # fmt: skip
    def best_game_reviews(view):
        bridge = view(many)
        members = bridge.filter(F.col(one) != UNKNOWN).select(one).distinct().orderBy(one).limit(3)
        games = view("scores").select("game_key", "game_name", "sentiment_rating", "total_reviews").join(members_of_keys({one: bridge}, members, "game_key"), "game_key")
        games = first_keys(games, by("sentiment_rating"), 3, "game_rank", (one,))
        found = with_best(games, view("facts"), "game_key", best_first(), told, F.col("is_eligible")).join(member_names(bridge, games, "game_key", one, "members"), "game_key", "left")
        return found.select(F.col(one).alias("picked"), "game_rank", "game_name", F.round("sentiment_rating", 4).alias("sentiment_rating"), "total_reviews", "members", *told)


_of_dimension("genre", "genres")
_of_dimension("theme", "themes")


@drilldown(f"""select dimension, member, rated_games, reviewed_games, total_reviews, sentiment_rating, pct_bug_reports, row_number() over (partition by dimension order by sentiment_rating desc, member) as place from (
    select dimension, member, count(external_rating) as rated_games, count(total_reviews) as reviewed_games, cast(sum(total_reviews) as bigint) as total_reviews, {_WEIGHTED} as sentiment_rating,
      round(100 * sum(pct_bug_reports * total_reviews) / nullif(sum(total_reviews), 0), 6) as pct_bug_reports
    from scores join (select 'genre' as dimension, game_key, genre as member from genres union all select 'theme', game_key, theme from themes) using (game_key) where member <> 'Unknown' group by all having count(total_reviews) >= 5)
  qualify place <= 10""")
def dimension_leaders(view):
    parts = []
    for one, many in (("genre", "genres"), ("theme", "themes")):
        rolled = member_rollup(view("scores"), view(many), one).filter("reviewed_games >= 5")
        rolled = rolled.withColumns({"sentiment_rating": F.round("sentiment_rating", 6), "pct_bug_reports": F.round(100 * F.col("pct_bug_reports"), 6)})
        parts.append(rolled.select(F.lit(one).alias("dimension"), F.col(one).alias("member"), "rated_games", "reviewed_games", "total_reviews", "sentiment_rating", "pct_bug_reports"))
    return top_per_group(parts[0].unionByName(parts[1]), ["dimension"], [F.desc("sentiment_rating"), F.asc("member")], 10, "place")


@drilldown("""select theme, game_name, votes_funny, sentiment_label, substring(review_text, 1, 30) as snippet, row_number() over (partition by theme order by votes_funny desc, votes_up desc, review_key) as rn
  from facts join themes using (game_key) where theme <> 'Unknown' qualify rn <= 3""")
def funny_by_theme(view):
    order = [F.desc("votes_funny"), F.desc("votes_up"), F.asc("review_key")]
    facts = view("facts").select("game_key", "review_key", "game_name", "votes_funny", "votes_up", "sentiment_label", F.substring("review_text", 1, 30).alias("snippet"))
    # three of a game are enough for its themes, so no review is repeated for each of them
    few = top_per_group(facts, ["game_key"], order, 3, "__rank").drop("__rank").join(view("themes").filter(F.col("theme") != UNKNOWN), "game_key")
    return top_per_group(few, ["theme"], order, 3, "rn").select("theme", "game_name", "votes_funny", "sentiment_label", "snippet", "rn")


# games with the names of their members
_NAMES = ", ".join(f"(select string_agg(distinct nullif({x}, 'Unknown'), ', ' order by nullif({x}, 'Unknown')) from {x}s m where m.game_key = t.game_key) as {x}s" for x in ("genre", "theme"))


def with_names(games: DataFrame, view, dimensions: tuple[str, ...]) -> DataFrame:
    for one in dimensions:
        games = games.join(member_names(view(f"{one}s"), games, "game_key", one, f"{one}s"), "game_key", "left")
    return games


def _listed(name: str, measure: str, falling: bool) -> None:
    @drilldown(f"""select game_name, total_reviews, {RATINGS}, label, {_NAMES} from (select * from scores where total_reviews >= {ENOUGH}
      and game_key in (select game_key from themes where theme ilike '%e%' or theme ilike '%st%') order by {_sql_by(measure, falling)} limit 10) t""", name)  # fmt: skip
    def run(view):
        patterns = view("themes").sparkSession.createDataFrame([("%e%",), ("%st%",)], "pattern string")
        liked = view("themes").join(F.broadcast(patterns), F.expr("theme ilike pattern"), "left_semi").select("game_key").distinct()
        games = first_keys(view("scores").filter(F.col("total_reviews") >= ENOUGH).join(liked, "game_key", "left_semi"), by(measure, falling), 10, "place")
        return with_names(games, view, ("genre", "theme")).select("game_name", "total_reviews", *ratings(), "label", "genres", "themes")


_listed("alignment_negative_listed", "alignment", False)
_listed("alignment_positive_listed", "alignment", True)
_listed("top_sentiment_listed", "sentiment_rating", True)

_SENTIMENT = ["influence", "votes_up", "votes_funny", "playtime_hours", "word_count", "review_text"]


@drilldown(f"""select t.game_name, round(sentiment_rating, 4) as sentiment_rating, total_reviews, {_NAMES}, {', '.join('r.' + c for c in _SENTIMENT)}
  from (select game_key, game_name, sentiment_rating, total_reviews from scores where total_reviews >= {ENOUGH} order by {_sql_by('sentiment_rating')} limit 10) t
  left join (select * from facts where is_eligible qualify row_number() over (partition by game_key order by influence desc, review_key) = 1) r using (game_key)""")
def sentiment_drilldown(view):
    games = first_keys(view("scores").filter(F.col("total_reviews") >= ENOUGH).select("game_key", "game_name", "sentiment_rating", "total_reviews"), by("sentiment_rating"), 10, "place")
    found = with_names(with_best(games, view("facts"), "game_key", best_first(), _SENTIMENT, F.col("is_eligible")), view, ("genre", "theme"))
    return found.select("game_name", F.round("sentiment_rating", 4).alias("sentiment_rating"), "total_reviews", "genres", "themes", *_SENTIMENT)


_GOLDEN = ["influence", "votes_up", "playtime_hours", "review_text"]


@drilldown(f"""select genre, theme, combo_rating, game_rank, t.game_name, round(sentiment_rating, 4) as sentiment_rating, total_reviews,
    (select string_agg(distinct nullif(platform, 'Unknown'), ', ' order by nullif(platform, 'Unknown')) from platforms p where p.game_key = t.game_key) as platforms, {', '.join('r.' + c for c in _GOLDEN)}
  from (select genre, theme, combo_rating, game_key, game_name, sentiment_rating, total_reviews, row_number() over (partition by genre, theme order by {_sql_by('sentiment_rating')}) as game_rank
    from (select genre, theme, {_WEIGHTED} as combo_rating from scores join genres using (game_key) join themes using (game_key) join platforms using (game_key)
        where genre <> 'Unknown' and theme <> 'Unknown' group by all having count(distinct game_key) >= 5 order by combo_rating desc, genre, theme limit 3)
      join genres using (genre) join themes using (theme, game_key) join scores using (game_key) qualify game_rank <= 3) t
  left join (select * from facts where is_eligible qualify row_number() over (partition by game_key order by influence desc, review_key) = 1) r using (game_key)""")
def golden_zone_drilldown(view):
    """The best pairs of genre and theme, whose means count a game once a platform as the catalogue lists it; their games and the best review of each."""
    bridges = {"genre": view("genres"), "theme": view("themes")}
    pairs = weighted_members(view("scores"), bridges, "game_key", "sentiment_rating", "sentiment_reviews", 5, view("platforms"))
    pairs = pairs.orderBy(F.desc("mean"), "genre", "theme").limit(3).select("genre", "theme", F.col("mean").alias("combo_rating"))
    games = view("scores").select("game_key", "game_name", "sentiment_rating", "total_reviews").join(members_of_keys(bridges, pairs, "game_key"), "game_key")
    games = first_keys(games, by("sentiment_rating"), 3, "game_rank", ("genre", "theme"))
    found = with_names(with_best(games, view("facts"), "game_key", best_first(), _GOLDEN, F.col("is_eligible")), view, ("platform",))
    return found.select("genre", "theme", "combo_rating", "game_rank", "game_name", F.round("sentiment_rating", 4).alias("sentiment_rating"), "total_reviews", "platforms", *_GOLDEN)


# picked games
PICKS = (3, 7, 11, 19, 23)
_ALIGNED = ["influence", "votes_up", "votes_funny", "comment_count", "voted_up", "playtime_hours", "compound", "review_text"]


@drilldown(f"""select s.game_name, round(alignment, 4) as alignment, {', '.join('r.' + c for c in _ALIGNED)} from scores s
  left join (select * from facts where is_eligible qualify row_number() over (partition by game_key order by influence desc, review_key) = 1) r using (game_key) where game_key in {PICKS}""")
def alignment_drilldown(view):
    games = view("scores").filter(F.col("game_key").isin(*PICKS)).select("game_key", "game_name", "alignment")
    return with_best(games, view("facts"), "game_key", best_first(), _ALIGNED, F.col("is_eligible")).select("game_name", F.round("alignment", 4).alias("alignment"), *_ALIGNED)


@drilldown(f"""select game_name, votes_funny, votes_up, voted_up, sentiment_label, substring(review_text, 1, 28) as snippet, row_number() over (partition by game_key order by votes_funny desc, review_key) as rn
  from facts where game_key in {PICKS} and votes_funny > 0 qualify rn <= 3""")
def disaster_snippets(view):
    games = view("games").filter(F.col("game_key").isin(*PICKS)).select("game_key")
    best = best_details(view("facts"), games, "game_key", [F.desc("votes_funny"), F.asc("review_key")], 3, "rn", F.col("votes_funny") > 0)
    return best.select("game_name", "votes_funny", "votes_up", "voted_up", "sentiment_label", F.substring("review_text", 1, 28).alias("snippet"), "rn")


def ordinal(tier: str) -> Column:
    """S is the highest; games without enough data have none."""
    letters = [letter for _, letter in TIERS] + ["F"]
    return F.try_element_at(F.create_map(*(F.lit(x) for k, letter in enumerate(reversed(letters), 1) for x in (letter, k))), F.col(tier))


@drilldown(f"""select volume_bucket, row_number() over (partition by volume_bucket order by abs(s - v) desc, total_reviews desc, game_key) as place, game_name, total_reviews, sentiment_tier, vote_tier, {RATINGS}, label
  from (select *, {catalogue._BUCKET} as volume_bucket, {catalogue._ORDINAL('sentiment_tier')} as s, {catalogue._ORDINAL('vote_tier')} as v from scores) where s <> v qualify place <= 5""")
def tier_mismatch_drilldown(view):
    gap = F.abs(ordinal("sentiment_tier") - ordinal("vote_tier"))
    rows = view("scores").withColumns({"volume_bucket": F.expr(catalogue._BUCKET), "gap": gap}).filter("gap > 0")
    return top_per_group(rows, ["volume_bucket"], [F.desc("gap"), F.desc("total_reviews"), F.asc("game_key")], 5, "place").select("volume_bucket", "place", "game_name", "total_reviews", "sentiment_tier", "vote_tier", *ratings(), "label")
