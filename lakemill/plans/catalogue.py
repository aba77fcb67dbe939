"""All registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.keys import row_hash, surrogate_key
from lakemill.functions.measures import playtime_bucket, sentiment_label
from lakemill.functions.sentiment import with_sentiment
from lakemill.functions.text import clean_text, demojize, quality_features
from lakemill.operators.cleaning import dedup_latest, null_sentinels, top_per_group
from lakemill.operators.scoring import BY_REVIEWS, BY_SENTIMENT, group_stats, member_rollup
from lakemill.plans import proxy
from lakemill.plans.proxy import table
from lakemill.plans.views import VIEWS
from lakemill.sources import control

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *, digits: int = 6) -> DataFrame:
    # means of cents over up to 127 rows are exact at 8 digits, where no tie depends on the order of the sum
    return df.select(*(F.round(c, 8 if c == "avg_playtime" else digits).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes))


_REVIEWS = "reviews as (select " + ", ".join(f"{sql} as {name}" for name, sql in proxy.REVIEW.items()) + " from lineitem)"
_RATIO = lambda c: f"coalesce(ln({c} + 1) / nullif(ln(max({c}) over g + 1), 0), 0)"
_INFLUENCE = f"""{_REVIEWS}, signals as (
  select *, percent_rank() over (partition by game_key order by playtime) as playtime_signal,
    0.45 * {_RATIO('votes_up')} + 0.20 * {_RATIO('votes_funny')} + 0.25 * {_RATIO('comment_count')} + 0.10 * {_RATIO('reaction_count')} as community_signal,
    case when has_credible_text then coalesce(ln(review_length + 1) / nullif(ln(max(case when has_credible_text then review_length end) over g + 1), 0), 0) * unique_word_ratio end as length_signal,
    case when has_credible_text then least(emotional_intensity, 0.3) / 0.3 end as emotional_signal,
    case when is_eligible then abs(compound) end as sentiment_signal,
    case when voted_up then 1 else -1 end as vote_direction,
    case when is_eligible then case when compound <> 0 then cast(sign(compound) as int) when voted_up then 1 else -1 end end as sentiment_direction,
    avg(playtime) over g as avg_playtime
  from reviews window g as (partition by game_key)
), scored as (
  select *, (1.5 * community_signal + case when has_credible_text then 0.5 else 0 end * coalesce(length_signal, 0) + case when has_credible_text then 0.3 else 0 end * coalesce(emotional_signal, 0)
      + case when avg_playtime > 0 then 1.0 else 0 end * playtime_signal + case when is_eligible then 1.0 else 0 end * coalesce(sentiment_signal, 0))
    / (1.5 + case when has_credible_text then 0.8 else 0 end + case when avg_playtime > 0 then 1 else 0 end + case when is_eligible then 1 else 0 end) as influence
  from signals
)"""
_SHRINK = lambda x, prior, n: f"100 * ({x} - ({x} - {prior}) * pow(2, -log10({n} + 1)))"
_TIER = lambda r, n: f"case when {r} is null then null when {n} < 10 then 'Insufficient Data' when round({r}, 2) >= 95 then 'S' when round({r}, 2) >= 87 then 'A' when round({r}, 2) >= 78 then 'B' when round({r}, 2) >= 68 then 'C' when round({r}, 2) >= 55 then 'D' else 'F' end"
def _ladder(best: str, good: str, worst: str) -> str:
    return f"case when r >= 95 then '{best}' when r >= 80 then '{good}' when r >= 70 then 'Mostly Positive' when r >= 40 then 'Mixed' when r >= 20 then 'Mostly Negative' else '{worst}' end"


_LABEL = f"""case when total_reviews is null then null
    when total_reviews >= 500 then {_ladder('Overwhelmingly Positive', 'Very Positive', 'Overwhelmingly Negative')}
    when total_reviews >= 50 then {_ladder('Very Positive', 'Very Positive', 'Very Negative')}
    when total_reviews >= 10 then {_ladder('Positive', 'Positive', 'Negative')} else 'Insufficient Data' end"""
_SCORES = f"""{_INFLUENCE}, games as (
  select p_partkey as game_key, p_name as game_name, cast(p_size * 2 as double) as rating, cast(p_partkey % 40 as bigint) as rating_count from part
), prior as (
  select (sum(coalesce(sentiment_direction, 0) * influence) / sum(influence) + 1) / 2 as sp, (sum(vote_direction * influence) / sum(influence) + 1) / 2 as vp,
    (select avg(rating) / 100 from games where rating > 0) as rp from scored
), stats as (
  select game_key, count(*) as total_reviews, count(sentiment_direction) as sentiment_reviews,
    sum(case when compound >= 0.05 then 1.0 else 0.0 end) / count(*) as pct_positive, sum(case when compound <= -0.05 then 1.0 else 0.0 end) / count(*) as pct_negative,
    sum(case when compound > -0.05 and compound < 0.05 then 1.0 else 0.0 end) / count(*) as pct_neutral,
    sum(sentiment_direction * influence) / nullif(sum(influence), 0) as weighted_sentiment, sum(vote_direction * influence) / nullif(sum(influence), 0) as weighted_vote,
    sum(case when voted_up then 1.0 else 0.0 end) / count(*) as pct_voted_up, avg(playtime) as avg_playtime, avg(emotional_intensity) as avg_emotional_intensity,
    sum(case when early_access then 1.0 else 0.0 end) / count(*) as pct_early_access, sum(case when bug_report then 1.0 else 0.0 end) / count(*) as pct_bug_reports,
    sum(case when refunded then 1.0 else 0.0 end) / count(*) as pct_refunded, avg(word_count) as avg_word_count
  from scored group by game_key
), rated as (
  select g.*, s.* exclude (game_key), {_SHRINK('rating / 100', 'rp', 'rating_count')} as external_rating, {_SHRINK('(weighted_sentiment + 1) / 2', 'sp', 'sentiment_reviews')} as sentiment_rating,
    {_SHRINK('(weighted_vote + 1) / 2', 'vp', 'total_reviews')} as weighted_vote_rating, {_SHRINK('pct_voted_up', '0.5', 'total_reviews')} as vote_rating
  from games g left join stats s using (game_key) cross join prior where rating > 0 and rating_count > 0
), scores as (
  select *, sentiment_rating - weighted_vote_rating as alignment, {_TIER('external_rating', 'rating_count')} as external_tier, {_TIER('sentiment_rating', 'sentiment_reviews')} as sentiment_tier,
    {_TIER('weighted_vote_rating', 'total_reviews')} as vote_tier, {_LABEL} as label from (select *, round(vote_rating, 2) as r from rated)
)"""
_MEMBERS = {
    "genre": "select distinct p_partkey as game_key, p_type as genre from part",
    "theme": "select distinct p_partkey as game_key, unnest(string_split(p_name, ' ')) as theme from part",
    "platform": "select distinct p_partkey as game_key, p_brand as platform from part",
}
_DOUBLES = ("rating", "pct_positive", "pct_negative", "pct_neutral", "weighted_sentiment", "weighted_vote", "pct_voted_up", "avg_playtime", "avg_emotional_intensity", "external_rating", "sentiment_rating", "weighted_vote_rating", "vote_rating", "alignment", "pct_early_access", "pct_bug_reports", "pct_refunded", "avg_word_count")
_R = lambda *names: ", ".join(f"round({x}, {8 if x == 'avg_playtime' else 6}) as {x}" for x in names)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VIEWS.get(spark, sf_dir, "scored")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VIEWS.get(spark, sf_dir, "scores")


@query(f"with {_SCORES} select game_key, game_name, rating_count, total_reviews, sentiment_reviews, {_R(*_DOUBLES)}, external_tier, sentiment_tier, vote_tier, label from scores")
def game_scores_(spark, sf_dir):
    return rounded(_scores(spark, sf_dir))


QUERIES["game_scores"], ORACLES["game_scores"] = QUERIES.pop("game_scores_"), ORACLES.pop("game_scores_")


@query(f"""with {_INFLUENCE} select review_key, game_key, {_R('community_signal', 'length_signal', 'emotional_signal', 'playtime_signal', 'sentiment_signal', 'influence')},
  cast(vote_direction as bigint) as vote_direction, cast(sentiment_direction as bigint) as sentiment_direction from scored""")
def review_influence(spark, sf_dir):
    names = ("review_key", "game_key", "community_signal", "length_signal", "emotional_signal", "playtime_signal", "sentiment_signal", "influence", "vote_direction", "sentiment_direction")
    return rounded(_scored(spark, sf_dir).select(*names))


@query(f"""with {_REVIEWS} select game_key, max(votes_up) as max_votes_up, max(votes_funny) as max_votes_funny, max(comment_count) as max_comment_count, max(reaction_count) as max_reaction_count,
  max(case when has_credible_text then review_length end) as max_review_length, round(avg(playtime), 8) as avg_playtime from reviews group by game_key""")
def salted_group_stats(spark, sf_dir):
    return rounded(group_stats(proxy.reviews(spark, sf_dir), salt=8))


def _rollup(dimension: str):
    weigh = lambda c, n: f"round(sum({c} * {n}) / nullif(sum({n}), 0), 6) as {c}"
    measures = [f"count(external_rating) as rated_games, {weigh('external_rating', 'rating_count')}, cast(sum(rating_count) as bigint) as rating_count"]
    if dimension != "platform":
        measures.append("count(total_reviews) as reviewed_games, cast(sum(total_reviews) as bigint) as total_reviews, cast(sum(sentiment_reviews) as bigint) as sentiment_reviews, round(avg(avg_playtime), 4) as avg_playtime")
        measures += [weigh(c, "sentiment_reviews") for c in BY_SENTIMENT] + [weigh(c, "total_reviews") for c in BY_REVIEWS]
    sql = f"with {_SCORES}, members as ({_MEMBERS[dimension]}) select {dimension}, {', '.join(measures)} from scores join members using (game_key) group by {dimension}"

    def run(spark, sf_dir):
        rows = member_rollup(_scores(spark, sf_dir), proxy.members(spark, sf_dir, dimension), dimension, reviewed=dimension != "platform")
        # a mean of means over any number of games: digits that no order of the sum changes
        return rounded(rows.withColumn("avg_playtime", F.round("avg_playtime", 4)) if "avg_playtime" in rows.columns else rows)

    QUERIES[f"agg_{dimension}s"], ORACLES[f"agg_{dimension}s"] = run, sql


for _dimension in _MEMBERS:
    _rollup(_dimension)


@query(f"select distinct game_key, coalesce(genre, 'Unknown') as genre, coalesce(theme, 'Unknown') as theme, coalesce(platform, 'Unknown') as platform from ({_MEMBERS['genre']}) left join ({_MEMBERS['theme']}) using (game_key) left join ({_MEMBERS['platform']}) using (game_key)")
def game_catalogue(spark, sf_dir):
    out = proxy.games(spark, sf_dir).select("game_key")
    for d in ("genre", "theme", "platform"):
        out = out.join(proxy.members(spark, sf_dir, d), "game_key", "left").fillna("Unknown", [d])
    return out.distinct()


_BUCKET = "case when total_reviews < 20 then 'under 20' when total_reviews < 30 then '20-29' when total_reviews < 40 then '30-39' else '40 and more' end"
_ORDINAL = lambda c: f"case {c} when 'S' then 6 when 'A' then 5 when 'B' then 4 when 'C' then 3 when 'D' then 2 when 'F' then 1 end"


@query(f"""with {_SCORES} select {_BUCKET} as volume_bucket, count(*) as games, round(avg(sentiment_rating), 6) as avg_sentiment, round(avg(vote_rating), 6) as avg_vote, round(avg(alignment), 6) as avg_alignment,
  round(stddev_pop(sentiment_rating), 6) as sd_sentiment, round(stddev_pop(vote_rating), 6) as sd_vote, round(stddev_pop(alignment), 6) as sd_alignment from scores where total_reviews is not null group by 1""")
def volume_buckets(spark, sf_dir):
    rows = _scores(spark, sf_dir).filter("total_reviews is not null").groupBy(F.expr(_BUCKET).alias("volume_bucket"))
    means = [f("%s" % c).alias(f"{p}_{n}") for p, f in (("avg", F.avg), ("sd", F.stddev_pop)) for c, n in (("sentiment_rating", "sentiment"), ("vote_rating", "vote"), ("alignment", "alignment"))]
    return rounded(rows.agg(F.count("*").alias("games"), *means))


@query(f"""with {_SCORES}, o as (select {_BUCKET} as volume_bucket, {_ORDINAL('sentiment_tier')} as s, {_ORDINAL('vote_tier')} as v from scores)
  select volume_bucket, count(*) as games, round(100.0 * sum(case when s = v then 1 else 0 end) / count(*), 2) as pct_same, round(100.0 * sum(case when v > s then 1 else 0 end) / count(*), 2) as pct_vote_higher,
  round(100.0 * sum(case when s > v then 1 else 0 end) / count(*), 2) as pct_sentiment_higher from o where s is not null and v is not null group by 1""")
def tier_mismatch(spark, sf_dir):
    rows = _scores(spark, sf_dir).select(F.expr(_BUCKET).alias("volume_bucket"), F.expr(_ORDINAL("sentiment_tier")).alias("s"), F.expr(_ORDINAL("vote_tier")).alias("v")).filter("s is not null and v is not null")
    pct = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 2)
    return rows.groupBy("volume_bucket").agg(F.count("*").alias("games"), pct(F.col("s") == F.col("v")).alias("pct_same"), pct(F.col("v") > F.col("s")).alias("pct_vote_higher"), pct(F.col("s") > F.col("v")).alias("pct_sentiment_higher"))


@query(f"with {_SCORES} select sentiment_tier, vote_tier, count(*) as games, cast(sum(total_reviews) as bigint) as reviews from scores group by 1, 2")
def tier_distribution(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("sentiment_tier", "vote_tier").agg(F.count("*").alias("games"), F.sum("total_reviews").alias("reviews"))


def _leaderboard(name: str, order: str, measure: str):
    sql = f"with {_SCORES} select game_key, game_name, total_reviews, round({measure}, 6) as measure, label from scores where total_reviews is not null order by round({order}, 6) desc, game_key limit 10"

    def run(spark, sf_dir):
        rows = _scores(spark, sf_dir).filter("total_reviews is not null").orderBy(F.expr(f"round({order}, 6)").desc(), "game_key").limit(10)
        return rows.select("game_key", "game_name", "total_reviews", F.expr(f"round({measure}, 6)").alias("measure"), "label")

    QUERIES[name], ORACLES[name] = run, sql


for _name, _order, _measure in (("alignment_negative", "-alignment", "alignment"), ("alignment_positive", "alignment", "alignment"), ("most_popular", "total_reviews * 1.0", "vote_rating"), ("most_divisive", "abs(alignment)", "alignment"), ("top_sentiment", "sentiment_rating", "sentiment_rating")):
    _leaderboard(_name, _order, _measure)


@query(f"""with {_SCORES}, top as (select review_key, game_key, votes_funny, votes_up, comment_count, compound, playtime_signal from scored order by votes_funny desc, votes_up desc, review_key limit 25)
  select review_key, game_name, votes_funny, votes_up, comment_count, case when compound >= 0.05 then 'Positive' when compound <= -0.05 then 'Negative' else 'Neutral' end as sentiment,
  case when playtime_signal >= 0.67 then 'Hardcore' when playtime_signal >= 0.34 then 'Regular' else 'Casual' end as player from top join games using (game_key)""")
def funniest_reviews(spark, sf_dir):
    # the top rows are found on narrow rows first, then enriched
    top = _scored(spark, sf_dir).orderBy(F.desc("votes_funny"), F.desc("votes_up"), "review_key").limit(25)
    rows = top.join(proxy.games(spark, sf_dir), "game_key")
    return rows.select("review_key", "game_name", "votes_funny", "votes_up", "comment_count", sentiment_label(F.col("compound")).alias("sentiment"), playtime_bucket(F.col("playtime_signal")).alias("player"))


@query(f"with {_INFLUENCE} select game_key, review_key, round(influence, 6) as influence, rank from (select *, row_number() over (partition by game_key order by round(influence, 6) desc, review_key) as rank from scored) where rank <= 3")
def best_reviews_per_game(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("game_key", "review_key", F.round("influence", 6).alias("influence"))
    return top_per_group(rows, ["game_key"], [F.desc("influence"), F.col("review_key")], 3)


@query(f"""with {_REVIEWS}, n as (select game_key, count(*) as reviews, max(votes_up) as max_votes_up, round(avg(votes_up), 6) as avg_votes_up from reviews group by game_key)
  (select 'high' as bucket, * from n order by reviews desc, game_key limit 5) union all (select 'low' as bucket, * from n order by reviews, game_key limit 5)""")
def volume_extremes(spark, sf_dir):
    n = proxy.reviews(spark, sf_dir).groupBy("game_key").agg(F.count("*").alias("reviews"), F.max("votes_up").alias("max_votes_up"), F.round(F.avg("votes_up"), 6).alias("avg_votes_up"))
    high, low = n.orderBy(F.desc("reviews"), "game_key").limit(5), n.orderBy("reviews", "game_key").limit(5)
    return high.select(F.lit("high").alias("bucket"), "*").unionByName(low.select(F.lit("low").alias("bucket"), "*"))


@query(f"""with {_REVIEWS} select game_key, cast(sum(votes_funny) as bigint) as funny, count(*) as reviews, round(sum(votes_funny) / count(*), 6) as density from reviews
  group by game_key having count(*) >= 25 and sum(votes_funny) / count(*) > 4""")
def funny_density(spark, sf_dir):
    rows = proxy.reviews(spark, sf_dir).groupBy("game_key").agg(F.sum("votes_funny").alias("funny"), F.count("*").alias("reviews"))
    return rows.withColumn("density", F.col("funny") / F.col("reviews")).filter("reviews >= 25 and density > 4").withColumn("density", F.round("density", 6))


@query(f"""with {_SCORES} select genre, theme, count(distinct game_key) as combo_games, round(sum(sentiment_rating * sentiment_reviews) / nullif(sum(sentiment_reviews), 0), 6) as combo_rating
  from scores join ({_MEMBERS['genre']}) using (game_key) join ({_MEMBERS['theme']}) using (game_key) group by 1, 2 having count(distinct game_key) >= 5""")
def genre_theme_combos(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    for d in ("genre", "theme"):
        rows = rows.join(proxy.members(spark, sf_dir, d), "game_key")
    total = F.sum(F.col("sentiment_rating") * F.col("sentiment_reviews")) / F.nullif(F.sum("sentiment_reviews"), F.lit(0))
    return rows.groupBy("genre", "theme").agg(F.count_distinct("game_key").alias("combo_games"), F.round(total, 6).alias("combo_rating")).filter("combo_games >= 5")


@query()
def text_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(quality_features(docs.withColumn("cleaned", clean_text(demojize(F.col("text")))), "text", "cleaned").drop("text", "cleaned"))


_FEATURES = """f as (select doc_id, text, length(text) as n, string_split(text, ' ') as w from documents), g as (select doc_id, n as review_length, len(w) as word_count, len(list_distinct(w)) as unique_word_count,
  case when n = 0 then 0 else length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / n end as ascii_ratio, case when n = 0 then 0 else (n - length(regexp_replace(text, '!{2,}|[A-Z]', '', 'g'))) / n end as emotional_intensity,
  regexp_matches(text, '(?i)\\b(bug|bugs|crash|error|lag|stuck|glitch)') as contains_bug_report from f), h as (select *, review_length / word_count as word_length_ratio, unique_word_count / word_count as unique_word_ratio from g),
  k as (select *, review_length > 0 and word_length_ratio between 2 and 15 as has_credible_text from h), e as (select *, review_length > 1 and (ascii_ratio >= 0.15 or unique_word_ratio = 1) and unique_word_ratio >= 0.1 and has_credible_text as is_eligible from k)"""


@query(f"with {_FEATURES} select doc_id, review_length, word_count, unique_word_count, {_R('ascii_ratio', 'emotional_intensity', 'word_length_ratio', 'unique_word_ratio')}, contains_bug_report, has_credible_text, is_eligible from e")
def raw_text_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("cleaned", F.col("text"))
    return rounded(quality_features(docs, "text", "cleaned").drop("text", "cleaned"))


@query(f"""with {_FEATURES} select count(*) as total_reviews, count(*) filter (where is_eligible) as pass_all, round(100.0 * count(*) filter (where not is_eligible) / count(*), 2) as pct_fail,
  round(100.0 * count(*) filter (where not has_credible_text) / count(*), 2) as pct_fail_credible, round(100.0 * count(*) filter (where unique_word_ratio < 0.1) / count(*), 2) as pct_fail_unique from e""")
def eligibility_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("cleaned", F.col("text"))
    pct = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 2)
    return quality_features(docs, "text", "cleaned").agg(F.count("*").alias("total_reviews"), F.count_if("is_eligible").alias("pass_all"), pct(~F.col("is_eligible")).alias("pct_fail"), pct(~F.col("has_credible_text")).alias("pct_fail_credible"), pct(F.col("unique_word_ratio") < 0.1).alias("pct_fail_unique"))


@query()
def document_sentiment(spark, sf_dir):
    """Sentiment of all documents' cleaned texts."""
    # a file of one large row group is read by one task, so texts are dealt to all cores first
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(tasks, "doc_id", "text").select("doc_id", clean_text(F.col("text")).alias("t"))
    return with_sentiment(docs, F.col("t"), name="s").select("doc_id", "s.*")


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc, role, text) as rn from conversations) where rn = 1")
def latest_turns(spark, sf_dir):
    return dedup_latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")])


@query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total_k from events group by event_type")
def parsed_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total_k"))


@query("select c_custkey, md5(cast(c_custkey as varchar) || '||' || c_name) as customer_key, sha256(c_name || '||' || c_mktsegment) as row_hash, case when c_mktsegment in ('', 'na', 'n/a', 'not available', 'unknown', 'null') then null else c_mktsegment end as c_mktsegment from customer")
def keyed_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", surrogate_key("c_custkey", "c_name").alias("customer_key"), row_hash("c_name", "c_mktsegment").alias("row_hash"), "c_mktsegment")
    return null_sentinels(rows, "c_mktsegment")


@query("select r_name, string_agg(n_name, ', ' order by n_name) as nations from region join nation on n_regionkey = r_regionkey group by r_name")
def nations_of_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


@query("select o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders where o_custkey in (select c_custkey from customer where c_mktsegment like 'B%' and c_acctbal between 0 and 5000) group by o_orderpriority")
def orders_of_segment(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").like("B%") & F.col("c_acctbal").between(0, 5000))
    rows = table(spark, sf_dir, "orders").join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select event_type, count(*) as loads, count(distinct user_id) as apps, round(min(value), 6) as min_minutes, round(quantile_cont(value, 0.25), 6) as p25_minutes, round(avg(value), 6) as avg_minutes,
  round(quantile_cont(value, 0.75), 6) as p75_minutes, round(max(value), 6) as max_minutes from events group by event_type""")
def run_statistics(spark, sf_dir):
    return rounded(control.run_statistics(table(spark, sf_dir, "events"), "event_type", "user_id", "value"))


_EXECUTIONS = """executions as (
  select event_type as run_id, user_id as app_id, ts as execution_start_time, ts + to_seconds(cast(event_id % 977 as bigint) * 11) as execution_end_time, cast(floor(value) as bigint) as retrieved,
    case event_id % 5 when 0 then 'empty' when 1 then 'failed' when 2 then 'in-progress' when 3 then 'timeout' else 'success' end as execution_status from events
), timed as (select *, date_diff('minute', execution_start_time, execution_end_time) as m from executions)"""


@query(f"""with {_EXECUTIONS} select run_id, min(execution_start_time) as run_start_time, max(execution_end_time) as run_end_time, min(m) as min_duration, round(quantile_cont(m, 0.25), 6) as p25_duration,
  cast((200 * sum(m) + count(m)) // (2 * count(m)) as double) / 100 as avg_duration, round(quantile_cont(m, 0.75), 6) as p75_duration, max(m) as max_duration, cast(sum(retrieved) as bigint) as retrieved,
  count(distinct app_id) as processed_apps, count(*) filter (where execution_status = 'empty') as empty_loads, count(*) filter (where execution_status not in ('success', 'empty', 'in-progress')) as failed_executions,
  date_diff('minute', min(execution_start_time), max(execution_end_time)) as run_duration from timed group by run_id""")
def load_run_statistics(spark, sf_dir):
    """Executions from events: a run for each type, ended after up to three hours, with a status by number."""
    k = F.col("event_id") % 5
    status = F.when(k == 0, "empty").when(k == 1, "failed").when(k == 2, "in-progress").when(k == 3, "timeout").otherwise("success")
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + (F.col("event_id") % 977) * 11_000_000)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("app_id"), start.alias("execution_start_time"), end.alias("execution_end_time"), F.floor("value").cast("long").alias("retrieved"), status.alias("execution_status"))
    found = control.load_run_statistics(rows).withColumn("avg_duration", F.col("avg_duration").cast("double"))
    return rounded(found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start_time", "run_end_time")}))


@query("select user_id, event_id, event_type, high_water_mark from (select *, max(ts) over (partition by user_id) as high_water_mark, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_executions(spark, sf_dir):
    return control.latest_executions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "high_water_mark")
