"""Analytical queries of one step over the serving views, each said in SQL: Spark runs it over DataFrames of the views, the oracle over the same views as CTEs. Drilldowns are in ``drilldowns``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.plans import catalogue
from lakemill.plans.views import FACTS, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LABELLED = """case when compound is null then null when compound >= 0.05 then 'Positive' when compound <= -0.05 then 'Negative' else 'Neutral' end as sentiment_label,
    case when playtime_signal >= 0.67 then 'Hardcore' when playtime_signal >= 0.34 then 'Regular' else 'Casual' end as playtime_bucket"""
CTES = f"""with {catalogue._SCORES},
  genres as (select g.game_key, coalesce(m.genre, 'Unknown') as genre from games g left join ({catalogue._MEMBERS['genre']}) m using (game_key)),
  themes as (select g.game_key, coalesce(m.theme, 'Unknown') as theme from games g left join ({catalogue._MEMBERS['theme']}) m using (game_key)),
  platforms as (select g.game_key, coalesce(m.platform, 'Unknown') as platform from games g left join ({catalogue._MEMBERS['platform']}) m using (game_key)),
  facts as (select {', '.join(FACTS)}, game_name, round(influence, 6) as influence, round(compound, 4) as compound, round(playtime / 60, 4) as playtime_hours, {_LABELLED}
    from scored join (select game_key, game_name from games) using (game_key)),
  loads as (select * from events), customers as (select * from customer) """


def _strings(sql: str, spark: bool) -> str:
    """``[[x]]``: the distinct known values of x in order, as one string."""
    known = r"nullif(\1, 'Unknown')"
    return re.sub(r"\[\[(\w+)\]\]", f"nullif(array_join(array_sort(collect_set({known})), ', '), '')" if spark else f"string_agg(distinct {known}, ', ' order by {known})", sql)


def finding(name: str, sql: str) -> None:
    used = set(re.findall(r"\{(\w+)\}", sql))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_strings(sql, True), **{x: VIEWS.get(spark, sf_dir, x) for x in used})

    QUERIES[name] = run
    body = _strings(sql, False).format(**{x: x for x in used})
    ORACLES[name] = (CTES.rstrip() + ", " + body.removeprefix("with ")) if body.startswith("with ") else CTES + body


#: Reviews that a game needs to be ranked, at the volume of the test tables.
ENOUGH = 25
REVIEW = "game_name, review_text, voted_up, votes_up, votes_funny, comment_count, reaction_count, playtime_hours, playtime_bucket, compound, sentiment_label, bug_report, refunded"
RATINGS = "round(external_rating, 4) as external_rating, round(sentiment_rating, 4) as sentiment_rating, round(weighted_vote_rating, 4) as weighted_vote_rating, round(vote_rating, 4) as vote_rating, round(alignment, 4) as alignment"

# serving views; hours are means of cents over 60, whose ties at the last digit go up in any engine by the small term
finding("dim_games", "select game_key, game_name, rating, rating_count from {games}")
for _one, _many in (("genre", "genres"), ("theme", "themes"), ("platform", "platforms")):
    finding(f"dim_{_many}", f"select md5({_one}) as {_one}_key, {_one} from (select distinct {_one} from {{{_many}}}) x where {_one} <> 'Unknown'")
    finding(f"game_{_many}", f"select distinct game_key, {_one} from {{{_many}}}")
finding("fact_reviews", f"select review_key, game_key, influence, word_count, review_length, is_eligible, {REVIEW} from {{facts}}")
finding("fact_game_scores", f"""select game_key, game_name, rating_count, total_reviews, sentiment_reviews, {RATINGS}, round(avg_playtime / 60 + 1e-9, 4) as avg_playtime_hours, cast(round(round(avg_word_count, 6), 0) as bigint) as avg_word_count,
  round(100 * avg_emotional_intensity, 4) as avg_emotional_intensity, round(100 * pct_positive, 4) as pct_positive, round(100 * pct_neutral, 4) as pct_neutral, round(100 * pct_negative, 4) as pct_negative,
  round(100 * pct_early_access, 4) as pct_early_access, round(100 * pct_bug_reports, 4) as pct_bug_reports, round(100 * pct_refunded, 4) as pct_refunded, external_tier, sentiment_tier, vote_tier, label from {{scores}}""")

# exports
finding("top_games_export", f"select game_key, game_name, rating_count, total_reviews, sentiment_reviews, {RATINGS}, label, vote_tier, sentiment_tier from {{scores}} where total_reviews >= {ENOUGH} order by round(sentiment_rating, 6) desc, game_key limit 20")


for _one, _many in (("genre", "genres"), ("theme", "themes")):
    _mean = "sum(sentiment_rating * sentiment_reviews) / nullif(sum(sentiment_reviews), 0)"
    finding(f"{_one}_alignment", f"""select {_one}, count(external_rating) as rated_games, count(total_reviews) as reviewed_games, cast(sum(total_reviews) as bigint) as total_reviews, round(sum(alignment * sentiment_reviews) / nullif(sum(sentiment_reviews), 0), 6) as alignment,
      round({_mean}, 6) as sentiment_rating, round(sum(weighted_vote_rating * total_reviews) / nullif(sum(total_reviews), 0), 6) as weighted_vote_rating from {{scores}} s join {{{_many}}} m on s.game_key = m.game_key where {_one} <> 'Unknown' group by {_one} having count(external_rating) >= 5""")
finding("review_sufficiency", "select case when total_reviews < 10 then 'Insufficient' else 'Sufficient' end as bucket, count(*) as games, min(total_reviews) as min_reviews, max(total_reviews) as max_reviews from {scores} group by 1")
_VOLUME = "case when total_reviews < 100 then '0-99' when total_reviews < 1000 then '100-999' when total_reviews < 10000 then '1k-10k' when total_reviews < 100000 then '10k-100k' else '100k+' end"
finding("volume_versus_quality", f"select {_VOLUME} as volume_bucket, count(*) as games, round(avg(sentiment_rating), 6) as avg_sentiment, round(avg(weighted_vote_rating), 6) as avg_vote from {{scores}} where total_reviews >= 10 group by 1")
finding("volume_bucket_spread", f"""select {_VOLUME} as volume_bucket, count(*) as games, round(avg(sentiment_rating), 6) as avg_sentiment, round(avg(vote_rating), 6) as avg_vote, round(avg(alignment), 6) as avg_alignment,
  round(stddev_pop(sentiment_rating), 6) as sd_sentiment, round(stddev_pop(vote_rating), 6) as sd_vote, round(stddev_pop(alignment), 6) as sd_alignment from {{scores}} where total_reviews is not null group by 1""")
finding("games_detail", f"select game_key, game_name, total_reviews, {RATINGS}, label from {{scores}} where game_name in (select min(game_name) from {{games}} union all select max(game_name) from {{games}})")

# audits of the load tables
finding("audit_versions", "select event_id, ts, user_id, event_type from {loads} where value > 50")
finding("audit_recent_loads", "select event_id, ts, user_id, event_type, value from {loads} where value > 0 order by ts desc, event_id limit 20")
finding("audit_load_summary", "select event_type, case when event_type like 'c%' then 'failed' else event_type end as status, count(*) as executions, round(sum(value), 4) as total, round(avg(value), 6) as avg_duration from {loads} group by 1, 2")
finding("audit_top_apps", """with apps as (select c_custkey, c_name from {customers} where c_mktsegment <> 'MACHINERY' and c_name not like '%,%')
  select l.user_id as app_id, l.event_type as load_type, c_name as app_name, count(distinct event_id) as executions, round(sum(value), 4) as total, min(ts) as first_on, max(ts) as last_on
  from {loads} l left join apps a on l.user_id = a.c_custkey group by l.user_id, l.event_type, c_name""")

finding("gate_percentages", """select count(*) as total_reviews, count(case when is_eligible then 1 end) as pass_all, count(case when not is_eligible then 1 end) as fail_any, round(1e2 * count(case when not is_eligible then 1 end) / count(*), 4) as pct_fail,
  round(1e2 * count(case when not has_credible_text then 1 end) / count(*), 4) as pct_fail_credible, round(1e2 * count(case when review_length <= 100 then 1 end) / count(*), 4) as pct_fail_length,
  round(1e2 * count(case when word_count < 20 then 1 end) / count(*), 4) as pct_fail_words, count(case when review_length <= 10 then 1 end) as empty_shape, count(case when word_count <= 2 and review_length > 5 then 1 end) as degenerate_shape,
  count(case when not is_eligible and review_length > 10 and word_count > 2 then 1 end) as other_ineligible from {facts}""")
finding("degenerate_texts", """with top_rows as (select review_key, game_key, review_length, word_count, has_credible_text, is_eligible, review_text from {facts} where word_count <= 10 and review_length > 20 order by review_length desc, review_key limit 10)
  select game_name, review_length, word_count, has_credible_text, is_eligible, substring(review_text, 1, 20) as snippet, review_key from top_rows t left join {games} g on t.game_key = g.game_key""")
finding("degenerate_texts_of_game", """with picked as (select game_key, game_name from {games} where game_name ilike '%a%' and game_name not like '%zzz%' order by game_key limit 1)
  select p.game_name as game_name, review_key, review_length, word_count, substring(review_text, 1, 40) as snippet from {facts} f join picked p on f.game_key = p.game_key order by review_length desc, review_key limit 10""")
# the first reviews by one measure
for _name, _order, _n, _columns in (
    ("top_influence", "influence desc", 20, "influence, review_length, word_count"),
    ("bottom_influence", "influence", 20, "influence, review_length, word_count"),
    ("most_helpful_reviews", "votes_up desc, votes_funny desc", 10, "review_key, word_count, review_length, substring(review_text, 1, 30) as snippet"),
    ("longest_playtime", "playtime_hours desc", 10, "review_key, word_count, review_length, substring(review_text, 1, 30) as snippet"),
    ("playtime_tail", "playtime_hours desc, votes_up desc", 50, "review_key, word_count, review_length, substring(review_text, 1, 30) as snippet"),
):
    finding(_name, f"select {_columns}, {REVIEW} from {{facts}} order by {_order}, review_key limit {_n}")
finding("helpful_votes_of_games", """with votes as (select game_key, cast(sum(votes_up) as bigint) as votes_up, count(*) as reviews, max(votes_up) as max_votes_up from {facts} group by game_key order by votes_up desc, game_key limit 10)
  select game_name, votes_up, reviews, max_votes_up, round(alignment, 4) as alignment, label from votes v join {scores} s on v.game_key = s.game_key""")
finding("refund_rates", f"select game_name, round(100 * pct_refunded, 4) as pct_refunded, total_reviews, {RATINGS}, label, round(100 * pct_bug_reports, 4) as pct_bug_reports, round(100 * pct_early_access, 4) as pct_early_access from {{scores}} where total_reviews >= {ENOUGH} order by round(pct_refunded, 9) desc, game_key limit 10")
# games picked by name and key in VALUES, joined on both
_PICKS = "from {scores} s join {games} g on s.game_key = g.game_key and s.game_name = g.game_name join (values (3), (7), (11), (19), (23), (100000000)) as p(pick) on p.pick = s.game_key"
_OF_S = re.sub(r"round\((\w+), 4\)", r"round(s.\1, 4)", RATINGS)
finding("alignment_picks", f"select s.game_name as game_name, total_reviews, {_OF_S}, round(100 * pct_positive, 4) as pct_positive, round(100 * pct_negative, 4) as pct_negative {_PICKS}")
finding("tier_mismatch_picks", f"select s.game_name as game_name, total_reviews, sentiment_tier, vote_tier, {_OF_S}, label {_PICKS}")
