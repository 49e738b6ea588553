"""Score expressions: cosine, decay, boost, reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCORE_DIGITS = 6


def as_score(c: Column) -> Column:
    """Scores are compared and ranked after rounding, so that order of summation cannot matter."""
    return F.round(c, SCORE_DIGITS)


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Exact row-wise cosine; 0 when a vector has no length.  For joins use the vector kernel."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def _as_ts(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


def age_days(created: Column, reference_time) -> Column:
    """Whole days since ``created``, never negative."""
    secs = _as_ts(reference_time).cast("double") - created.cast("double")
    return F.greatest(F.lit(0), F.floor(secs / 86400)).cast("int")


def temporal_decay(score: Column, created: Column, reference_time, factor: float = 0.95) -> Column:
    return score * F.pow(F.lit(factor), age_days(created, reference_time))


def update_boost(score: Column, created: Column, reference_time, *, invalid_at: Column | None = None,
                 boost: float = 1.2, recent_days: int = 7) -> Column:
    """Full boost for recent rows; for facts 80 % of it if they ceased to hold recently."""
    cutoff = _as_ts(reference_time) - F.expr(f"INTERVAL {recent_days} DAYS")
    out = F.when(created >= cutoff, score * boost)
    if invalid_at is not None:
        out = out.when(invalid_at >= cutoff, score * (boost * 0.8))
    return out.otherwise(score)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)
