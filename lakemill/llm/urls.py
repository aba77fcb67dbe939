"""URL filters: longest-match host rules, then gradient-boosted trees on lexical features (operator 8). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import let, staged

FEATURES = ["length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "suffix_rate", "suffix_share"]
#: Labelled URLs that trees are fitted on, at most: those of least hash.
SAMPLE = 20_000
#: Labelled URLs that a suffix's rate is drawn towards the mean by.
PRIOR = 20.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the (``host/path``, verdict) rules that fits; null if none does."""
    cases = None
    for rule, _ in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        cases = F.when(fits, rule) if cases is None else cases.when(fits, rule)
    return F.lit(None).cast("string") if cases is None else cases


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path`` and the host's suffix (its last label)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    characters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(characters, F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))
    return (
        urls.withColumn("length", F.length(url).cast("double")).withColumn("host_length", F.length("host").cast("double"))
        .withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"))
        .withColumn("labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("digit_ratio", F.length(F.regexp_replace(url, "[^0-9]", "")) / n)
        .withColumn("hyphens", F.length(F.regexp_replace("host", "[^-]", "")).cast("double"))
        .withColumn("entropy", F.coalesce(entropy, F.lit(0.0)))
        .withColumn("parameters", F.when(F.instr(url, "?") > 0, F.regexp_count(url, F.lit("[?&][^=&#]*"))).otherwise(0).cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """For each suffix its rate of blocked URLs, drawn to the overall rate, and the log of its count, over all labelled URLs."""
    every = labelled.agg(F.avg("label").alias("mean"))
    own = labelled.groupBy("suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    return own.crossJoin(every).select(F.col("suffix").alias("of"), ((F.col("bad") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)).alias("suffix_rate"), F.log1p("n").alias("suffix_share"), "mean")


def with_suffixes(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    joined = rows.join(statistics.drop("mean"), F.col("suffix") == F.col("of"), "left").drop("of")
    return joined.fillna({"suffix_rate": 0.5, "suffix_share": 0.0})


def fit_url_trees(labelled: DataFrame, sample: int = SAMPLE, trees: int = 8, depth: int = 4, seed: int = 7):
    """Trees fitted on (lexical features, ``label`` 0 or 1), or the only label seen, or 0.0 without labelled URLs.

    At most ``sample`` URLs, those of least hash of the URL, are used; the choice doesn't depend on row order.
    """
    taken = labelled.orderBy(F.xxhash64("url"), "url", *FEATURES).limit(sample)
    taken = staged(taken.select(*FEATURES, F.col("label").cast("double").alias("label")), "url-sample").coalesce(1)
    labels = sorted(x[0] for x in taken.select("label").distinct().collect())
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(taken)
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(rows)


#: Words of the labelled URLs below.
_PLAIN = "garden river music history school kitchen travel letters museum forest science weather library market island bicycle".split()
_BAIT = "free win bonus cheap login verify prize casino pills crypto update secure".split()
_SECTIONS = "news blog articles guide about docs archive events".split()
_SUFFIXES = "com org net de fr info io co xyz top".split()


def labelled_urls(spark: SparkSession, n: int = 4000, seed: int = 8, words: Sequence[str] = _PLAIN) -> DataFrame:
    """``n`` URLs (url, label) with labels that no rule gave: half ordinary pages, half of the shape of spam and phishing.

    Made by hashes of a row number, so each run gives the same. Both kinds take all suffixes, have paths, numbers and
    parameters; spam has more digits, hyphens and random strings. A tenth of each kind lacks most of these signs.
    """
    draw = lambda k: F.xxhash64("id", F.lit(1000 * seed + k))
    of = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(draw(k), F.lit(len(values))) + 1).cast("int"))
    below = lambda k, m: F.pmod(draw(k), F.lit(m)).cast("string")
    rare = lambda k, m: F.pmod(draw(k), F.lit(m)) == 0
    noise = lambda k, m: F.substring(F.md5(draw(k).cast("string")), 1, m)
    some = lambda condition, *parts: F.when(condition, F.concat(*parts)).otherwise("")
    lit = F.lit
    plain = F.concat(
        lit("https://"), some(rare(1, 2), lit("www.")), of(2, words), some(rare(3, 3), lit("-"), of(4, words)), lit("."), of(5, _SUFFIXES), lit("/"), of(6, _SECTIONS),
        some(rare(7, 3), lit("/20"), below(8, 25), lit("/"), below(9, 12)), lit("/"), of(10, words), lit("-"), of(11, words), some(rare(12, 4), lit(".html")),
        some(rare(13, 5), lit("?page="), below(14, 40)), some(rare(15, 10), lit("&ref="), noise(16, 6)),
    )
    open_ = ~rare(20, 10)
    spam = F.concat(
        lit("http://"), of(2, words), some(open_, lit("-"), of(21, _BAIT), below(22, 900)), some(rare(23, 2), lit("."), noise(24, 6)), lit("."), of(5, _SUFFIXES), lit("/"),
        some(open_, noise(25, 12), lit("/")), of(26, _BAIT), some(rare(27, 2), lit(".php")), lit("?id="), noise(28, 10), some(open_, lit("&sid="), noise(29, 12), lit("&u="), below(30, 99999)),
    )
    rows = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    return rows.select(F.when(F.col("label") == 1, spam).otherwise(plain).alias("url"), "label")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of every URL.

    The longest fitting rule decides. Other URLs are judged by trees fitted on ``labelled`` (url, label 1 = block);
    without it, on the URLs that rules decide, by their verdicts. Null ids stay, a null URL is empty; with no or only
    one label known, all others get that one (allow without any). Repeated rows are judged alike, very long URLs whole;
    an empty table gives no rows; further columns don't matter, whatever their names.
    """
    verdicts = F.create_map(*(F.lit(x) for rule in rules for x in rule)) if rules else F.lit(None).cast("map<string,string>")
    split = lambda df: df.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    rows = split(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = staged(lexical(rows.withColumn("ruled", verdicts[F.col("rule")])), "urls")
    if labelled is None:
        known = rows.filter("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("int"))
    else:
        known = lexical(split(labelled.select("url", "label"))).filter("label is not null")
    statistics = staged(suffix_statistics(known), "url-suffixes")
    model = fit_url_trees(with_suffixes(known, statistics))
    rows = with_suffixes(rows, statistics)
    if isinstance(model, float):
        rows = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        rows = scored.withColumn("score", vector_to_array("probability")[1])
    judged = F.when(F.col("score") > limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
