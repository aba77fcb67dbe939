"""Rule-based sentiment by the published rules of Hutto and Gilbert (2014), for any lexicon given as a table.

Texts are scored on the JVM: tokens and their neighbours by higher-order functions, valences from a table that is broadcast
as one row of small maps, up to a stated size. ``score`` says the same for one text. The lexicon here is our own, with
inflected forms made by rule; equal scores to any library are not claimed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of our own: word valences (-4 to 4) by kind of word, boosters and negations.
VERBS = {
    "admire": 2.3, "adore": 2.9, "annoy": -1.9, "bore": -1.3, "bother": -1.4, "charm": 1.9, "crash": -1.7, "delight": 2.8, "disappoint": -2.2, "dislike": -1.7, "enjoy": 2.2, "fail": -2.5,
    "frustrate": -2.0, "hate": -2.7, "impress": 2.2, "improve": 1.9, "love": 3.2, "please": 1.7, "praise": 2.3, "recommend": 1.8, "ruin": -2.4, "suck": -2.1, "thrill": 2.1, "trust": 2.0, "upset": -1.7, "waste": -1.8, "welcome": 1.9, "worry": -1.9,
}
ADJECTIVES = {
    "awful": -2.3, "bad": -2.5, "bland": -1.0, "brave": 2.3, "bright": 1.7, "clean": 1.5, "clever": 2.0, "cool": 1.4, "cruel": -2.8, "cute": 2.0, "dull": -1.5, "fair": 1.3, "fine": 1.0, "fresh": 1.3, "fun": 2.3, "funny": 1.9, "great": 3.1,
    "happy": 2.7, "lazy": -1.5, "mad": -2.0, "neat": 1.8, "nice": 1.8, "poor": -2.1, "pretty": 1.8, "rich": 1.6, "sad": -2.1, "sharp": 0.9, "smart": 1.7, "smooth": 1.2, "strong": 1.8, "ugly": -2.3, "weak": -1.9, "weird": -0.7,
}
NOUNS = {"bug": -1.3, "disaster": -3.1, "error": -1.7, "gem": 2.1, "joke": 1.2, "joy": 2.8, "masterpiece": 3.1, "mess": -1.5, "pain": -2.3, "pleasure": 2.7, "problem": -1.7, "scam": -2.7, "treasure": 2.3, "winner": 2.8}
OTHERS = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "beautifully": 2.8, "best": 3.2, "better": 1.9, "boring": -1.3, "brilliant": 2.8, "broken": -2.1, "excellent": 2.7, "fantastic": 2.6, "favorite": 2.0, "garbage": -2.4, "good": 1.9, "gorgeous": 3.0,
    "horrible": -2.5, "incredible": 2.5, "junk": -1.9, "lovely": 2.8, "mediocre": -1.2, "outstanding": 3.0, "pathetic": -2.7, "perfect": 2.7, "perfectly": 2.6, "stunning": 2.2, "superb": 3.1, "terrible": -2.1, "trash": -1.8, "unplayable": -2.4,
    "useless": -1.8, "wonderful": 2.7, "worse": -2.1, "worst": -3.1, "worth": 0.9, "worthless": -1.9,
}
BOOSTERS = {"absolutely": 0.293, "completely": 0.293, "extremely": 0.293, "really": 0.293, "so": 0.293, "totally": 0.293, "very": 0.293, "barely": -0.293, "hardly": -0.293, "slightly": -0.293, "somewhat": -0.293}
NEGATIONS = frozenset("aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt neither never no none nor not nothing shouldnt wasnt werent without wont wouldnt".split())
CAPS, NEGATED, BANG, MANY = 0.733, -0.74, 0.292, 15.0
FADING = (1.0, 0.95, 0.9)

_TOKEN = re.compile(r"[\w']+")


def _stem(word: str, ending: str) -> str:
    """``word`` before an ending that begins with a vowel: without its silent e, y as i before e, a last consonant doubled after one short vowel."""
    if word.endswith("e"):
        return word[:-1]
    if re.search("[^aeiou]y$", word) and ending[0] == "e":
        return word[:-1] + "i"
    return word + word[-1] if re.fullmatch("[^aeiou]*[aeiou][^aeiouwxy]", word) else word


def inflected() -> dict[str, float]:
    """All forms of the lexicon's words: verbs by person and tense, adjectives by degree (a tenth more a step) and as adverbs, nouns in the plural."""
    out = dict(OTHERS)
    plural = lambda w: re.sub("y$", "i", w) + "es" if re.search("([^aeiou]y|s|x|ch|sh)$", w) else w + "s"
    for word, v in VERBS.items():
        past = word if word == "upset" else _stem(word, "ed") + "ed"
        out |= {word: v, plural(word): v, past: v, _stem(word, "ing") + "ing": v}
    for word, v in ADJECTIVES.items():
        more = lambda step: math.copysign(min(4.0, round(abs(v) * (1 + step / 10), 2)), v)  # noqa: E731, B023
        degrees = {} if word in ("bad", "awful", "cruel", "fun") else {_stem(word, "er") + "er": more(1), _stem(word, "est") + "est": more(2)}
        adverb = re.sub("y$", "i", word) + ("ly" if not word.endswith("ll") else "y")
        out = {**degrees, **({} if word in ("fun", "cool") else {adverb: v}), word: v, **out}
    for word, v in NOUNS.items():
        out |= {word: v, plural(word): v}
    return out


LEXICON = inflected()


def _round(x: float, digits: int) -> float:
    """As SQL rounds: halves of the shortest decimal form go up."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def score(text: str, lexicon: Mapping[str, float] = LEXICON) -> tuple[float, float, float, float]:
    """(positive, compound, neutral, negative)."""
    tokens = _TOKEN.findall(text)
    lowered = [x.lower().replace("'", "") for x in tokens]
    mixed_case = any(x.isupper() for x in tokens) and not all(x.isupper() for x in tokens)
    values = []
    for i, word in enumerate(lowered):
        value = 0.0 if word in BOOSTERS else lexicon.get(word, 0.0)
        if value:
            sign = math.copysign(1, value)
            if mixed_case and tokens[i].isupper():
                value += sign * CAPS
            for back, fade in enumerate(FADING, 1):
                before = lowered[i - back] if i >= back else ""
                value += sign * BOOSTERS.get(before, 0.0) * fade
            if any(x in NEGATIONS for x in lowered[max(0, i - 3) : i]):
                value *= NEGATED
        values.append(value)
    if "but" in lowered:
        turn = lowered.index("but")
        values = [v * (0.5 if i < turn else 1.5 if i > turn else 1) for i, v in enumerate(values)]
    total = sum(values)
    bangs, asks = min(text.count("!"), 4) * BANG, text.count("?")
    emphasis = bangs + (0.0 if asks < 2 else 0.18 * asks if asks < 4 else 0.96)
    total += math.copysign(emphasis, total) if total else 0.0
    positive, negative = sum(v + 1 for v in values if v > 0), sum(v - 1 for v in values if v < 0)
    if positive > abs(negative):
        positive += emphasis
    elif positive < abs(negative):
        negative -= emphasis
    neutral = sum(v == 0 for v in values)
    everything = positive - negative + neutral
    if not everything:
        return 0.0, 0.0, 0.0, 0.0
    return _round(positive / everything, 3), _round(total / math.sqrt(total * total + MANY), 4), _round(neutral / everything, 3), _round(-negative / everything, 3)


#: Words that a lexicon may have, as it is broadcast; and maps that it is dealt to for each word, so that most hold one at most.
MOST, SHELVES = 200_000, 2


class LexiconTooLarge(ValueError):
    """A lexicon has more words than may be broadcast."""


def lexicon_table(spark: SparkSession, words: Mapping[str, float] | None = None) -> DataFrame:
    """word and valence of a lexicon in memory."""
    return spark.createDataFrame(list((LEXICON if words is None else words).items()), "word string, valence double")


def _shelves(lexicon: DataFrame, most: int) -> tuple[DataFrame, int]:
    """One row: an array of maps, a word's place told by its hash, NULL where there is none. A word given twice has its least valence; boosters and words of no valence count as others."""
    once = lexicon.filter("word is not null and valence is not null").groupBy("word").agg(F.min(F.col("valence").cast("double")).alias("valence"))
    n = once.count()
    if n > most:
        raise LexiconTooLarge(f"{n} words; {most} may be broadcast")
    shelves = max(1, SHELVES * n)
    valued = once.filter((F.col("valence") != 0) & ~F.col("word").isin(*BOOSTERS))
    maps = valued.groupBy(F.pmod(F.xxhash64("word"), F.lit(shelves)).cast("int").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("word", "valence"))).alias("m"))
    every = lexicon.sparkSession.range(shelves).select(F.col("id").cast("int").alias("k")).join(maps, "k", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.map_entries("m").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("__lexicon")), shelves


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _scored(text: Column, lexicon: Column, shelves: int) -> Column:
    boosters = F.create_map(*(F.lit(x) for pair in BOOSTERS.items() for x in pair))
    negations = F.array(*(F.lit(x) for x in sorted(NEGATIONS)))
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    zero = F.lit(0.0)

    # what is done for each word is little: one look into the lexicon. All rules are for the words found in it.
    def valences(low: Column) -> Column:
        return F.transform(low, lambda x: F.try_element_at(F.get(lexicon, F.pmod(F.xxhash64(x), F.lit(shelves)).cast("int")), x))

    def value(w: Column, v: Column, i: Column) -> Column:
        raised = v + F.when(w["caps"] & upper(F.get(w["tokens"], i)), sign(v) * CAPS).otherwise(zero)
        for back, fade in enumerate(FADING, 1):
            raised = raised + sign(v) * F.coalesce(F.try_element_at(boosters, F.get(w["low"], i - back)), zero) * fade
        before = [F.coalesce(F.array_contains(negations, F.get(w["low"], i - back)), F.lit(False)) for back in (1, 2, 3)]
        side = F.when((w["turn"] < 0) | (i == w["turn"]), 1.0).when(i < w["turn"], 0.5).otherwise(1.5)
        return raised * F.when(before[0] | before[1] | before[2], NEGATED).otherwise(1.0) * side

    def values(w: Column) -> Column:
        """Those of the words found, in order, and how many words there are."""
        at = F.filter(F.transform(valences(w["low"]), lambda v, i: F.when(v.isNotNull(), F.struct(v.alias("v"), i.alias("i")))), lambda x: x.isNotNull())
        return F.struct(F.transform(at, lambda x: value(w, x["v"], x["i"])).alias("v"), F.size(w["tokens"]).alias("n"))

    def parts(tokens: Column) -> Column:
        # lowered all at once: a line feed is in no token
        lowered = F.split(F.replace(F.lower(F.array_join(tokens, "\n")), F.lit("'"), F.lit("")), "\n")
        low = F.when(F.size(tokens) > 0, lowered).otherwise(F.array().cast("array<string>"))
        # a word in capitals stands out beside any that is not
        return _let(F.struct(tokens.alias("tokens"), low.alias("low"), F.exists(tokens, lambda x: ~upper(x)).alias("caps")), lambda w: F.struct(w["tokens"].alias("tokens"), w["low"].alias("low"), w["caps"].alias("caps"), (F.array_position(w["low"], "but").cast("int") - 1).alias("turn")))

    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    asks = count("?")
    emphasis = F.least(count("!"), F.lit(4)) * BANG + F.when(asks < 2, zero).when(asks < 4, 0.18 * asks).otherwise(0.96)
    add = lambda vs, f: F.aggregate(vs, zero, lambda a, v: a + f(v))

    def told(w: Column) -> Column:
        vs, more = w["v"], w["e"]
        total = add(vs, lambda v: v)
        total = total + F.when(total == 0, zero).otherwise(sign(total) * more)
        up, down = add(vs, lambda v: F.when(v > 0, v + 1).otherwise(zero)), add(vs, lambda v: F.when(v < 0, v - 1).otherwise(zero))
        neutral = (w["n"] - F.size(F.filter(vs, lambda v: v != 0))).cast("double")
        sums = F.struct(total.alias("t"), up.alias("up"), down.alias("down"), neutral.alias("z"), more.alias("e"))
        leaning = lambda x: F.struct(x["t"].alias("t"), (x["up"] + F.when(x["up"] > F.abs(x["down"]), x["e"]).otherwise(zero)).alias("p"), (x["down"] - F.when(x["up"] < F.abs(x["down"]), x["e"]).otherwise(zero)).alias("n"), x["z"].alias("z"))

        def shares(x: Column) -> Column:
            whole = F.nullif(x["p"] - x["n"] + x["z"], zero)
            part = lambda y: F.coalesce(F.round(y / whole, 3), zero)
            return F.struct(part(x["p"]).alias("positive"), F.when(whole.isNull(), zero).otherwise(F.round(x["t"] / F.sqrt(x["t"] * x["t"] + MANY), 4)).alias("compound"), part(x["z"]).alias("neutral"), part(-x["n"]).alias("negative"))

        return _let(_let(sums, leaning), shares)

    tokens = F.regexp_extract_all(text, F.lit(r"(?U)[\w']+"), F.lit(0))
    found = _let(_let(_let(tokens, parts), values), lambda w: _let(F.struct(w["v"].alias("v"), w["n"].alias("n"), emphasis.alias("e")), told))
    return F.when(text.isNotNull(), found)


def with_sentiment(rows: DataFrame, text: Column, lexicon: DataFrame | None = None, name: str = "sentiment", most: int = MOST) -> DataFrame:
    """``rows`` with a struct of positive, compound, neutral and negative of a text; NULL for NULL.

    ``lexicon``: word (lower case, no apostrophes) and valence, ours if none is given; more than ``most`` words raise.
    """
    one, shelves = _shelves(lexicon_table(rows.sparkSession) if lexicon is None else lexicon, most)
    return rows.crossJoin(F.broadcast(one)).withColumn(name, _scored(text, F.col("__lexicon"), shelves)).drop("__lexicon")  # one row of checked size
