"""Derived-metric column functions (period-over-period comparison layer).

All of them work on DOUBLE columns and are plain Catalyst expressions, so they
run inside whole-stage codegen on the executors. Guards keep every division
away from a zero denominator (ANSI mode would raise on it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status labels and the lower bound of "Flat" in percent (fixed values):
# change > 0 is Ahead, change >= -5 is Flat, lower is Behind, no change is N/A.
STATUS_AHEAD, STATUS_FLAT, STATUS_BEHIND, STATUS_NA = "Ahead", "Flat", "Behind", "N/A"
FLAT_FLOOR_PCT = -5.0

# Utilization bands by average weekly hours per person (fixed values).
BAND_HIGH_HOURS, BAND_MID_HOURS = 30.0, 20.0
UTILIZATION_MIN_SCALE_HOURS = 40.0
# Share of a bucket in percent from which its label is shown (fixed value).
SHARE_LABEL_MIN_PCT = 3.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def null_to_zero(x) -> Column:
    """NULL, NaN or a value that is not a number becomes 0, as a DOUBLE."""
    return F.coalesce(F.nanvl(_c(x).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def pct_change(current, prior) -> Column:
    """(current - prior) / |prior| * 100; NULL when prior is 0, NULL or NaN."""
    cur, pri = _c(current).cast("double"), _c(prior).cast("double")
    return F.when((pri != 0) & ~F.isnan(pri), (cur - pri) / F.abs(F.nullif(pri, F.lit(0.0))) * 100)


def status(change) -> Column:
    """Ahead / Flat / Behind / N/A. A change of exactly 0 is Flat."""
    c = _c(change)
    return (F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(STATUS_NA))
            .when(c > 0, F.lit(STATUS_AHEAD))
            .when(c >= FLAT_FLOOR_PCT, F.lit(STATUS_FLAT))
            .otherwise(F.lit(STATUS_BEHIND)))


def safe_ratio(num, den, scale: float = 1.0) -> Column:
    """num / den * scale when den > 0, else 0."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    out = n / F.nullif(d, F.lit(0.0))
    if scale != 1.0:
        out = out * scale
    return F.when(d > 0, out).otherwise(F.lit(0.0))


def avg_rate(tvp, hours) -> Column:
    """Average billable rate: TVP per hour, 0 unless hours > 0."""
    return safe_ratio(tvp, hours)


def realization(tvp, write_up_down) -> Column:
    """(TVP + write-up/down) / TVP * 100, 0 unless TVP > 0."""
    t = _c(tvp).cast("double")
    w = _c(write_up_down).cast("double")
    return F.when(t > 0, (t + w) / F.nullif(t, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


def gauge_ratio(current, prior_full) -> Column:
    """current / |prior full period|, 0 when the prior full period is 0."""
    cur, full = _c(current).cast("double"), _c(prior_full).cast("double")
    return F.when(full != 0, cur / F.abs(F.nullif(full, F.lit(0.0)))).otherwise(F.lit(0.0))


def clamp01(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def utilization_band(avg_hours) -> Column:
    h = _c(avg_hours)
    return (F.when(h >= BAND_HIGH_HOURS, F.lit("high"))
            .when(h >= BAND_MID_HOURS, F.lit("mid"))
            .otherwise(F.lit("low")))


def name_contains(text, query: str) -> Column:
    """Case-insensitive substring test, NULL treated as ''."""
    return F.lower(F.coalesce(_c(text), F.lit(""))).contains(query.lower())
