"""Recency, decay, keyword and recall scores as Column expressions. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
DAY = 86400.0
RECENCY_DAYS = 1095.0
KEYWORD_WEIGHT, KEYWORD_LIMIT = 0.12, 3
VALID_BONUS, RECENCY_WEIGHT = 0.05, 0.10
SEMANTIC_FLOOR, PARAPHRASE_CUTOFF = 0.25, 0.93
HALF_LIFE_DAYS, DEFAULT_IMPORTANCE, PINNED_FROM = 30.0, 5, 10


def truthy(x: Column) -> Column:
    """x, or null if it is 0 or empty."""
    return F.when(x != 0, x)


def moment(event_date: Column, created_at: Column) -> Column:
    """The date a row is about: event_date, or created_at where that is missing or 0."""
    return F.coalesce(truthy(event_date), truthy(created_at))


def recency(event_date: Column, created_at: Column, now: float) -> Column:
    ts = moment(event_date, created_at)
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - ts) / DAY
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - age / RECENCY_DAYS))


def query_words(query: str) -> list[str]:
    """Lower-case words of three characters or more, repeats included."""
    return [w.lower() for w in query.split() if len(w) >= 3]


def keyword_hits(content: Column, words: list[str]) -> Column:
    low = F.lower(content)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def recall_score(similarity: Column, hits: Column, is_valid: Column, recent: Column) -> Column:
    return similarity + KEYWORD_WEIGHT * F.least(hits, F.lit(KEYWORD_LIMIT)) + VALID_BONUS * is_valid.cast("int") + RECENCY_WEIGHT * recent


def half_life_days(importance: Column) -> Column:
    return F.when(importance >= PINNED_FROM, F.lit(float("inf"))).otherwise(HALF_LIFE_DAYS * (0.5 + importance / 4.0))


def weight_score(importance: Column, event_date: Column, created_at: Column, now: float) -> Column:
    """importance / 10 * exp(-age / half life); importance null or 0 counts as the default."""
    imp = F.coalesce(truthy(importance), F.lit(DEFAULT_IMPORTANCE))
    ts = F.coalesce(moment(event_date, created_at), F.lit(0.0))
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - ts) / DAY)
    return imp / 10.0 * F.exp(-age / half_life_days(imp))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def target_clusters(n: Column) -> Column:
    """Cluster count for n points: all of up to 6, else half-even round(sqrt(n / 2)) within 6 to 14."""
    return F.when(n <= 6, F.greatest(F.lit(1), n)).otherwise(F.least(F.lit(14), F.greatest(F.lit(6), F.bround(F.sqrt(n / 2.0), 0)))).cast("int")


def to_epoch(iso: Column) -> Column:
    """Seconds of an ISO date or time, zone-less ones as UTC; null if blank or malformed."""
    return F.try_to_timestamp(F.when(F.trim(iso) != "", F.trim(iso))).cast("double")


def day_of(epoch: Column) -> Column:
    """ISO date (UTC) of an epoch, ? where it is missing or 0."""
    return F.coalesce(F.date_format(F.timestamp_seconds(truthy(epoch)), "yyyy-MM-dd"), F.lit("?"))
