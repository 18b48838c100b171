"""Conditional period sums: many measures over many periods in one aggregate.

Each output column is ``SUM(CASE WHEN d BETWEEN lo AND hi THEN value ELSE 0 END)``
with the range bounds as literals. All columns share one scan and one
``HashAggregate`` pair (partial on the map side, final after a shuffle of one
row per map task, or of one row per group and task when grouped).

Null rules kept from the source queries:

* ``ELSE 0``: a group with rows but none in the period sums to 0, not NULL;
* a NULL measure inside the period is skipped (amounts are not coalesced unless
  the measure asks for it, as write-up/down does);
* a global aggregate over no rows at all is one row of NULLs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import PeriodWindows


@dataclass(frozen=True)
class Measure:
    """One output column: ``name`` = sum of ``value`` over ``period``."""
    name: str
    period: str
    value: str
    coalesce: bool = False

    def value_col(self) -> Column:
        v = F.col(self.value)
        return F.coalesce(v, F.lit(0)) if self.coalesce else v


def in_range(date_col: str, lo: dt.date, hi: dt.date) -> Column:
    return F.col(date_col).between(F.lit(lo), F.lit(hi))


def period_sum(date_col: str, lo: dt.date, hi: dt.date, value: Column,
               where: Column | None = None) -> Column:
    """Sum over the period; ``where`` keeps other rows out of it (they add no 0 either)."""
    inside = in_range(date_col, lo, hi)
    if where is None:
        return F.sum(F.when(inside, value).otherwise(F.lit(0)))
    return F.sum(F.when(where & inside, value).when(where, F.lit(0)))


def measure_columns(date_col: str, windows: PeriodWindows, measures: Sequence[Measure],
                    where: Column | None = None) -> list[Column]:
    ranges = windows.ranges()
    return [period_sum(date_col, *ranges[m.period], m.value_col(), where).alias(m.name)
            for m in measures]


def conditional_sums(df: DataFrame, date_col: str, windows: PeriodWindows,
                     measures: Sequence[Measure], by: Sequence[str] = (),
                     prune: bool = False, profile: DataFrame | None = None) -> DataFrame:
    """Aggregate ``measures`` over ``df``, globally or grouped ``by``.

    ``prune=True`` reads the measures only between Jan 1 of the prior year and the
    as-of date, the span of all six periods, so a date-clustered fact table is
    read for two years instead of its whole history. Rows outside the span only
    add ``ELSE 0`` terms: they turn a NULL sum into 0, or give a group without span
    rows its row of zeros. So their dates and group keys alone are appended to the span's rows
    before the one aggregate. They come from ``profile`` (a date profile of the same rows, see
    ``StarSchema.materialize``) if it has the group keys, else from the key columns of the facts.
    """
    if prune:
        lo, hi = windows.span()
        values = sorted({m.value for m in measures})
        history = profile if profile is not None and set(by) <= set(profile.columns) else df
        keys = list(dict.fromkeys([*by, date_col]))
        df = (df.filter(in_range(date_col, lo, hi)).select(*keys, *values)
              .unionByName(outside_rows(history, date_col, lo, hi).select(*keys), allowMissingColumns=True))
    cols = measure_columns(date_col, windows, measures)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def outside_rows(df: DataFrame, date_col: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Rows outside [lo, hi]; a NULL date is outside every period. Written as a
    disjunction of plain comparisons so it is pushed to the scan."""
    d = F.col(date_col)
    return df.filter((d < F.lit(lo)) | (d > F.lit(hi)) | d.isNull())
