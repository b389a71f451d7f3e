"""Numeric Column expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of the storage score (1e6 bytes -> 0, 1e11 bytes -> 100).
SIZE_SCORE_LOG_FLOOR = 6.0
SIZE_SCORE_LOG_CEIL = 11.0

MANAGED_PROVIDERS = ("rds", "aurora", "cloudsql", "azure", "supabase", "neon")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_dp(value: Column | str, places: int) -> Column:
    """Round half away from zero on the scaled double.

    ``round(v, n)`` in Spark rounds the decimal text of ``v`` instead, which differs
    at ties; scaling first keeps the arithmetic every consumer expects.
    """
    scale = F.lit(float(10**places))
    return F.round(col(value) * scale) / scale


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as a double, NULL when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def share_of(part: Column | str, rest: Column | str) -> Column:
    """part / (part + rest), NULL for an empty total."""
    return ratio(col(part), col(part) + col(rest))


def pct_change(before: Column | str, after: Column | str) -> Column:
    """Relative change to four places, NULL when there is no base."""
    b, a = col(before).cast("double"), col(after).cast("double")
    return round_dp(F.try_divide(a - b, b), 4)


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value).cast("double"), F.lit(float(low))), F.lit(float(high)))


def size_score(size: Column | str) -> Column:
    """Bytes on a 0..100 log scale."""
    b = col(size).cast("double")
    span = SIZE_SCORE_LOG_CEIL - SIZE_SCORE_LOG_FLOOR
    scored = clamp((F.log10(b) - SIZE_SCORE_LOG_FLOOR) / F.lit(span) * 100, 0, 100)
    return F.when(b > 0, scored).otherwise(F.lit(0.0))


def severity_rank(sev: Column | str) -> Column:
    s = col(sev)
    return F.when(s == "critical", 3).when(s == "warn", 2).otherwise(1)


def effective_ceiling(max_value: Column | str, type_name: Column | str) -> Column:
    """The lower of a sequence's own maximum and its owning column's range."""
    m, t = col(max_value), col(type_name)
    by_type = F.when(t == "int2", F.lit(32767)).when(t == "int4", F.lit(2147483647))
    return F.least(m, F.coalesce(by_type.cast("long"), m))


def progress_pct(done: Column | str, total: Column | str) -> Column:
    return F.when(col(total) > 0, round_dp(ratio(col(done) * 100, total), 1))


def managed(provider: Column | str) -> Column:
    return F.coalesce(col(provider).isin(*MANAGED_PROVIDERS), F.lit(False))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            col(ts).cast("timestamp_ntz"))
