"""Text cleaning and quality features, JVM-side but for emoji names."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The cleaner's patterns and what they become, in the order in which they apply.
CLEANING = (
    (r"\[.*?\]|[^\x00-\x7F]", ""),
    # all of ASCII, as nothing else is left, but letters, digits, white space, ! and ?: ranges are searched faster than what is in none of many
    (r"(?:[\x00-\x08\x0E-\x1F\x22-\x2F\x3A-\x3E@\x5B-\x60\x7B-\x7F]\s*+){3,}+|#|https?://\S+", ""),
    (r"(:heart_suit:){7,}", "fucking"),
    (r"(:heart_suit:){2,}", "fuck"),
    (r":(\w+):", "$1 "),
    (r"_|\s+", " "),
)
BUG_WORDS = r"(?i)\b(bug|bugs|crash|error|lag|stuck|glitch)"
NON_ASCII = r"[^\x00-\x7F]"
EMPHASIS = r"!{2,}|[A-Z]"

_SYMBOL = re.compile("[☀-➿\U0001f300-\U0001faff]️?")


def emoji_names(text: str | None) -> str | None:
    """Symbols and emoji as ``:their_unicode_name:``; names of some differ from those of emoji libraries."""
    if text is None:
        return None
    name = lambda m: ":" + re.sub(r"\W+", "_", unicodedata.name(m[0][0], "emoji").lower().removeprefix("black ")).strip("_") + ":"
    return _SYMBOL.sub(name, text)


def demojize(text: Column) -> Column:
    """``emoji_names`` of a column: an Arrow-batched UDF that only texts outside ASCII go through."""

    @F.pandas_udf(StringType())
    def named(x: pd.Series) -> pd.Series:
        return x.map(emoji_names)

    return F.coalesce(named(F.when(text.rlike(NON_ASCII), text)), text)


def clean_text(text: Column) -> Column:
    for pattern, new in CLEANING:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def quality_features(df: DataFrame, raw: str, cleaned: str) -> DataFrame:
    """Adds lengths, ratios, eligibility and flags. An empty text counts as one word."""
    size = F.length(cleaned)
    words = F.split(cleaned, " ")
    df = df.withColumns({"review_length": size.cast("long"), "word_count": F.size(words).cast("long"), "unique_word_count": F.size(F.array_distinct(words)).cast("long")})
    df = df.withColumns({
        "word_length_ratio": F.col("review_length") / F.col("word_count"),
        "unique_word_ratio": F.col("unique_word_count") / F.col("word_count"),
        "ascii_ratio": F.coalesce(F.length(F.regexp_replace(raw, NON_ASCII, "")) / F.nullif(F.length(raw), F.lit(0)), F.lit(0.0)),
        "emotional_intensity": F.coalesce((size - F.length(F.regexp_replace(cleaned, EMPHASIS, ""))) / F.nullif(size, F.lit(0)), F.lit(0.0)),
        "contains_bug_report": F.col(cleaned).rlike(BUG_WORDS),
    })
    df = df.withColumn("has_credible_text", (F.col("review_length") > 0) & F.col("word_length_ratio").between(2, 15))
    enough = (F.col("ascii_ratio") >= 0.15) | (F.col("unique_word_ratio") == 1)
    return df.withColumn("is_eligible", (F.col("review_length") > 1) & enough & (F.col("unique_word_ratio") >= 0.1) & F.col("has_credible_text"))
