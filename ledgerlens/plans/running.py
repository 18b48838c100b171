"""Period sums for many as-of dates from running totals per day.

``running_totals`` turns facts into one row per group and day: the totals over all rows of the group up to that
day, with the counts that the NULL / 0 rule needs. It is the table to write next to a star for interactive use
(its size is groups x days, whatever the number of facts). A period of closed dates is then the difference of two rows, and
an as-of date with six periods is a dozen lookups, not a pass over its days.

``period_sums`` looks the bounds up: a running total holds from its day to the next day of its group, so each bound falls on
exactly one row, and the rows made are groups x bounds. They are gathered per group (as many as there are bounds), and every
as-of date of the list picks its pairs by position. Lookups of a fine table (firm and service line) add up
to coarser groups (firm, all).

The rule restored: SUM(CASE WHEN in the period THEN value ELSE 0 END) is NULL only if no row lies outside the period and no
value inside it is known. Rows without a date are in no period; they come first in the running order, so they cancel
out of every difference and only count as rows outside.

Skew: facts are summed per group and day before the window, so a group holds days, not facts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import PERIODS, PeriodWindows
from ..operators.measures import Measure

#: A bound after every day: the lookup there holds all rows of a group.
END = dt.date.max


def value_name(m: Measure) -> str:
    """Column suffix of the summed value of a measure (a coalesced value is one of its own)."""
    return m.value + ("_or_0" if m.coalesce else "")


def running_totals(df: DataFrame, date_col: str, measures: Sequence[Measure], by: Sequence[str] = ()) -> DataFrame:
    """by..., day, next_day, rows, and sum_<value>, known_<value> of each value: totals up to and on ``day``."""
    values = {value_name(m): m.value_col() for m in measures}
    per_day = df.groupBy(*by, F.col(date_col).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(f"sum_{n}") for n, v in values.items()],
        *[F.count(v).alias(f"known_{n}") for n, v in values.items()])
    order = Window.partitionBy(*by).orderBy(F.col("day").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [c for c in per_day.columns if c not in (*by, "day")]
    return per_day.select(*by, "day", F.lead("day").over(order).alias("next_day"),
                          *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in names])


def _before(day: dt.date) -> dt.date | None:
    return None if day == dt.date.min else day - dt.timedelta(days=1)


def period_sums(totals: DataFrame, as_of_dates: Sequence[dt.date], measures: Sequence[Measure],
                by: Sequence[str] = ()) -> DataFrame:
    """by..., as_of and the measures: one row per as-of date and group, from ``running_totals``.

    ``by`` may be coarser than the groups of ``totals``. Without ``by`` there is a row per date even if there are no
    facts.
    """
    dates = sorted(set(as_of_dates))
    periods = [p for p in PERIODS if any(m.period == p for m in measures)]
    ranges = {a: {p: PeriodWindows(a).range(p) for p in periods} for a in dates}
    ends = {d for r in ranges.values() for lo, hi in r.values() for d in (_before(lo), hi)} - {None}
    bounds = sorted(ends | {END})
    place = {d: i for i, d in enumerate(bounds)}
    names = ["rows", *dict.fromkeys(f"{k}_{value_name(m)}" for m in measures for k in ("sum", "known"))]

    def date(d: dt.date) -> str:
        return f"DATE'{d.isoformat()}'"

    # Expressions over the list are SQL text: a list of many dates is then one call, not one a literal.
    listed = ", ".join(map(date, bounds))
    # most days are no bound and have none before the next day: a hash lookup drops them
    holds_one = F.expr(f"day IS NULL OR next_day IS NULL OR day IN ({listed}) OR datediff(next_day, day) > 1")
    here = F.expr(f"filter(array({listed}), b -> (day IS NULL OR b >= day) AND (next_day IS NULL OR b < next_day))")
    found = (totals.filter(holds_one).select(*by, F.explode(here).alias("bound"), *names)
             .groupBy(*by, "bound").agg(*[F.sum(c).alias(c) for c in names]))
    gathered = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bound", *names))).alias("_t"))
    # bounds before the first day of a group have no row: the list is short at its front
    gathered = gathered.withColumn("_shift", F.size("_t") - F.lit(len(bounds)))
    spots = ", ".join("named_struct('as_of', " + date(a) + "".join(
        f", '{p}_{end}', {place[d] if d else -len(bounds)}" for p in periods
        for end, d in (("lo", _before(ranges[a][p][0])), ("hi", ranges[a][p][1]))) + ")" for a in dates)
    placed = gathered.select(*by, "_t", "_shift", F.explode(F.expr(f"array({spots})")).alias("_w"))

    def between(name: str, period: str) -> str:  # a place before the list is NULL: nothing up to there
        hi, lo = (f"coalesce(get(_t, _w.{period}_{end} + _shift).{name}, 0)" for end in ("hi", "lo"))
        return f"({hi} - {lo})"

    columns = []
    for m in measures:
        known = f"{between(f'known_{value_name(m)}', m.period)} > 0"
        outside = f"coalesce(get(_t, size(_t) - 1).rows, 0) > {between('rows', m.period)}"
        columns.append(F.expr(f"CASE WHEN {known} OR {outside} THEN {between(f'sum_{value_name(m)}', m.period)} END").alias(m.name))
    return placed.select(*by, F.col("_w.as_of").alias("as_of"), *columns)
