"""Numeric helpers: weighted means, shrinkage, log ratios, tiers, labels and buckets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier limits, labels and bucket limits.
TIERS = ((95, "S"), (87, "A"), (78, "B"), (68, "C"), (55, "D"))
NO_DATA = "Insufficient Data"
LABEL_LIMITS = (95, 80, 70, 40, 20)
LABELS = {
    500: ("Overwhelmingly Positive", "Very Positive", "Mostly Positive", "Mixed", "Mostly Negative", "Overwhelmingly Negative"),
    50: ("Very Positive", "Very Positive", "Mostly Positive", "Mixed", "Mostly Negative", "Very Negative"),
    10: ("Positive", "Positive", "Mostly Positive", "Mixed", "Mostly Negative", "Negative"),
}


def weighted_mean(value: Column, weight: Column) -> Column:
    """A NULL value leaves the numerator only; a zero total gives NULL."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def share(condition: Column) -> Column:
    return F.sum(F.when(condition, 1.0).otherwise(0.0)) / F.count("*")


def shrink(observed: Column, prior: Column, n: Column) -> Column:
    """Draws ``observed`` to ``prior``; each tenfold of ``n`` halves what is left of the way."""
    return observed - (observed - prior) * F.pow(F.lit(2.0), -F.log10(n + 1))


def log_ratio(value: Column, top: Column) -> Column:
    """log(value + 1) relative to log(top + 1); 0 where that is undefined."""
    return F.coalesce(F.log(value + 1) / F.nullif(F.log(top + 1), F.lit(0.0)), F.lit(0.0))


def tier(rating: Column, n: Column) -> Column:
    out = F.when(rating.isNull(), None).when(n < 10, NO_DATA)
    for limit, letter in TIERS:
        out = out.when(rating >= limit, letter)
    return out.otherwise("F")


def volume_label(rating: Column, n: Column) -> Column:
    """The label of a rating (0 to 100) in words that depend on the count; limits are half-open."""

    def ladder(names: tuple[str, ...]) -> Column:
        out = F.when(rating.isNull(), None)
        for limit, name in zip(LABEL_LIMITS, names[:-1], strict=True):
            out = out.when(rating >= limit, name)
        return out.otherwise(names[-1])

    out = F.when(n.isNull(), None)
    for least, names in LABELS.items():
        out = out.when(n >= least, ladder(names))
    return out.otherwise(NO_DATA)


def playtime_bucket(signal: Column) -> Column:
    return F.when(signal >= 0.67, "Hardcore").when(signal >= 0.34, "Regular").otherwise("Casual")


def sentiment_label(compound: Column) -> Column:
    return F.when(compound.isNull(), None).when(compound >= 0.05, "Positive").when(compound <= -0.05, "Negative").otherwise("Neutral")
