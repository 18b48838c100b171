"""Daily rollup of the time facts, and gauges for many as-of dates in one pass.

Daily rollup
------------
``groupBy(member_firm_id, service_line, is_billable, entry_date)`` with the sums
of hours, TVP and write-up/down. Every period is a set of whole days, so each
rollup row is entirely inside or outside a period and the gauges and service
lines computed on the rollup equal those on the raw facts, NULL rules included:
SUM skips NULLs in both steps, a group whose amounts are all NULL sums to NULL in
both, and an empty input stays empty. Its size is firms x service lines x days,
independent of the number of time entries, so it is the table to materialise
(range-clustered by ``entry_date``) for interactive use. Utilization needs
the person and therefore reads the raw facts.

Many as-of dates
----------------
``series_sums`` computes conditional period sums for a list of as-of dates, globally or per group, from running
totals per day (``plans.running``): each period is the difference of two lookups. ``time_totals`` is
the table of running totals to write next to the daily rollup; the series read it in place of the facts.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import apply_firm, as_of_date
from ..functions.periods import iso_week_in_year
from ..operators import gauges as G
from ..operators.measures import Measure
from ..operators.snapshots import AR_OVER_60, RISK_TOP_K, ar_aging_columns, newest_report, risk_lists
from ..operators.utilization import staffed_levels
from ..sources.star import StarSchema
from .running import period_sums, running_totals

GRAIN = ["member_firm_id", "service_line", "is_billable", "entry_date"]


def daily_time_rollup(time_facts: DataFrame) -> DataFrame:
    return time_facts.groupBy(*GRAIN).agg(
        F.sum("hours").alias("hours"),
        F.sum("production_amount").alias("production_amount"),
        F.sum("write_up_down").alias("write_up_down"),
        F.count(F.lit(1)).alias("entries"))


def with_time_rollup(star: StarSchema, rollup: DataFrame | None = None) -> StarSchema:
    """The star schema with the time facts replaced by their daily rollup."""
    if rollup is None:
        rollup = daily_time_rollup(star.fct_time_entry)
    return dataclasses.replace(star, fct_time_entry=rollup)


def series_sums(df: DataFrame, date_col: str, as_of_dates: Sequence[dt.date],
                measures: Sequence[Measure], by: Sequence[str] = ()) -> DataFrame:
    """Conditional period sums of ``measures`` for every date in ``as_of_dates``.

    One row per as-of date (and group ``by``), equal to ``conditional_sums`` run once per date.
    The list is a parameter (its length is chosen by the caller, not the data).
    """
    return period_sums(running_totals(df, date_col, measures, by), as_of_dates, measures, by)


def time_totals(time_facts: DataFrame) -> DataFrame:
    """Running totals of billable time per firm and service line, for the series of time gauges and service lines."""
    return running_totals(time_facts.filter(F.col("is_billable")), "entry_date", G.TIME_MEASURES,
                          ["member_firm_id", "service_line"])


def _per_firm(star: StarSchema, series: DataFrame, dates: Sequence[dt.date]) -> DataFrame:
    """A row per listed firm and date; firms without rows get NULLs."""
    from .all_firms import BY, listed_firms

    grid = F.explode(F.array(*[F.lit(a) for a in sorted(set(dates))])).alias("as_of")
    return listed_firms(star).select(*BY, grid).join(series, [*BY, "as_of"], "left")


def _time_series(star: StarSchema, dates: Sequence[dt.date], measures: Sequence[Measure], by: Sequence[str],
                 firm: str | None, totals: DataFrame | None) -> DataFrame:
    if totals is None:
        return series_sums(G.billable_time(star, firm), "entry_date", dates, measures, by)
    return period_sums(apply_firm(totals, firm), dates, measures, by)


def time_gauges_series(star: StarSchema, as_of_dates: Sequence[str | dt.date], firm: str | None = None,
                       all_firms: bool = False, totals: DataFrame | None = None) -> DataFrame:
    """``time_gauges`` for every date; ``totals`` is a written ``time_totals`` of the same facts."""
    dates = [as_of_date(a) for a in as_of_dates]
    by = ["member_firm_id"] if all_firms else []
    out = _time_series(star, dates, G.TIME_MEASURES, by, firm, totals)
    return _per_firm(star, out, dates) if all_firms else out


def service_lines_series(star: StarSchema, as_of_dates: Sequence[str | dt.date], firm: str | None = None,
                         totals: DataFrame | None = None) -> DataFrame:
    """``gauges.service_lines`` for every date: as_of, service_line and its measures."""
    dates = [as_of_date(a) for a in as_of_dates]
    return _time_series(star, dates, G.SERVICE_LINE_MEASURES, ["service_line"], firm, totals)


def measures_series(star: StarSchema, as_of_dates: Sequence[str | dt.date],
                    firm: str | None = None, all_firms: bool = False) -> DataFrame:
    """The 28 gauge sums of time, invoice and cash facts, one row per as-of date (and firm).

    Each table gets one ``series_sums`` aggregate; the per-date rows are stacked
    and merged with ``max`` per column (one non-NULL value each), as in
    ``report.scorecard_measures``. Feed it to ``report.perf_table(..., by=["as_of"])``
    for a performance table per date (a weekly trend in one pass).
    """
    dates = [as_of_date(a) for a in as_of_dates]
    by = ["member_firm_id"] if all_firms else []
    parts = [series_sums(G.billable_time(star, firm), "entry_date", dates, G.TIME_MEASURES, by),
             series_sums(apply_firm(star.fct_invoice, firm), "invoice_date", dates,
                         G.INVOICE_MEASURES, by),
             series_sums(apply_firm(star.fct_cash_receipt, firm), "receipt_date", dates,
                         G.CASH_MEASURES, by)]
    keys = [*by, "as_of"]
    names = [c for p in parts for c in p.columns if c not in keys]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])
    return _per_firm(star, out, dates) if all_firms else out


def utilization_series(star: StarSchema, as_of_dates: Sequence[str | dt.date],
                       firm: str | None = None) -> DataFrame:
    """``utilization`` for every date: hours per person and day, placed at the dates whose
    week has that day, then per level."""
    dates = sorted({as_of_date(a) for a in as_of_dates})
    weeks = F.array(*[F.struct(F.lit(a).alias("as_of"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                      for a in dates for lo, hi in iso_week_in_year(a)])
    day = F.col("entry_date")
    per_day = (G.billable_time(star, firm).groupBy("person_key", "entry_date")
               .agg(F.sum("hours").alias("hours"), F.sum("production_amount").alias("tvp")))
    placed = per_day.select("person_key", "hours", "tvp",
                            F.explode(F.filter(weeks, lambda w: (day >= w["lo"]) & (day <= w["hi"]))).alias("_w"))
    people = (placed.groupBy("person_key", F.col("_w.as_of").alias("as_of"))
              .agg(F.sum("hours").alias("hours"), F.sum("tvp").alias("tvp")))
    return (people.join(staffed_levels(star), "person_key")
            .groupBy("as_of", "staff_level", "staff_level_index")
            .agg(F.countDistinct("person_key").alias("headcount"),
                 F.sum("hours").alias("total_hours"), F.sum("tvp").alias("total_tvp")))


def _newest_reports(star: StarSchema, table: str, dates: Sequence[dt.date]) -> tuple[DataFrame, DataFrame]:
    """as_of and the newest report date on or before it (NULL without one), and the snapshot's rows of those dates."""
    snapshot, known = getattr(star, table), star.report_dates.get(table)
    if known is not None:
        pairs = [(a, newest_report(known, a)) for a in dates]
        newest = snapshot.sparkSession.createDataFrame(pairs, "as_of date, report_date date")
        return newest, snapshot.filter(F.col("report_date").isin(sorted({d for _, d in pairs if d})))
    cols = [F.max(F.when(F.col("report_date") <= F.lit(a), F.col("report_date"))).alias(f"_d{i}")
            for i, a in enumerate(dates)]
    pairs = F.array(*[F.struct(F.lit(a).alias("as_of"), F.col(f"_d{i}").alias("report_date"))
                      for i, a in enumerate(dates)])
    newest = snapshot.agg(*cols).select(F.explode(pairs).alias("_p")).select("_p.*")
    return newest, snapshot.join(newest.select("report_date").distinct(), "report_date", "left_semi")


def ar_aging_series(star: StarSchema, as_of_dates: Sequence[str | dt.date],
                    firm: str | None = None) -> DataFrame:
    """``ar_aging`` for every date, each with its own newest snapshot; other snapshots are not aggregated."""
    dates = sorted({as_of_date(a) for a in as_of_dates})
    newest, wanted = _newest_reports(star, "fct_ar_aging_snapshot", dates)
    panels = apply_firm(wanted, firm).groupBy("report_date").agg(*ar_aging_columns())
    return newest.join(panels, "report_date", "left").drop("report_date")


def ar_risk_series(star: StarSchema, as_of_dates: Sequence[str | dt.date],
                   firm: str | None = None, top: int = RISK_TOP_K) -> DataFrame:
    """``ar_risk`` for every date: the top clients of its newest snapshot."""
    dates = sorted({as_of_date(a) for a in as_of_dates})
    newest, wanted = _newest_reports(star, "fct_ar_aging_snapshot", dates)
    lists = risk_lists(apply_firm(wanted, firm), star.dim_client, AR_OVER_60, "ar_amount", top, ["report_date"])
    return newest.join(lists, "report_date").drop("report_date")
