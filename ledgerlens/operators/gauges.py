"""Scorecard gauges over the time, invoice and cash facts, plus the firm list.

Every function takes the star schema, an as-of date and an optional firm, and
returns a lazy DataFrame with exact DECIMAL sums (see ``plans.output`` for the
edge conversion). ``by`` turns the single-firm global aggregate into a grouped
one; ``by=["member_firm_id"]`` serves every firm in one pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import apply_firm, as_of_date
from ..functions.periods import PERIODS, TO_DATE_PERIODS, PeriodWindows
from ..sources.star import StarSchema
from .measures import Measure, conditional_sums

_HOURS_TVP = [Measure(f"{p}_{name}", p, col)
              for p in PERIODS for name, col in (("hours", "hours"), ("tvp", "production_amount"))]
TIME_MEASURES = _HOURS_TVP + [Measure(f"{p}_wuwd", p, "write_up_down", coalesce=True)
                              for p in TO_DATE_PERIODS]
INVOICE_MEASURES = [Measure(f"{p}_billings", p, "invoice_amount") for p in PERIODS]
CASH_MEASURES = [Measure(f"{p}_cash", p, "receipt_amount") for p in PERIODS]
SERVICE_LINE_MEASURES = [m for m in _HOURS_TVP if m.period in TO_DATE_PERIODS]


def pruning(star: StarSchema, table: str, by: Sequence[str], prune: bool | None,
            firm: str | None, billable: bool = False) -> dict:
    """Span pruning is the default where a date profile answers what lies outside the span
    (a materialised star); otherwise it takes ``prune=True``. Returns the arguments of
    ``conditional_sums``, with the profile cut to the same rows as the facts."""
    profile = star.profiles.get(table)
    if profile is not None:
        profile = apply_firm(profile.filter(F.col("is_billable")) if billable else profile, firm)
    if prune is None:
        prune = profile is not None and set(by) <= set(profile.columns)
    return {"by": by, "prune": prune, "profile": profile}


def billable_time(star: StarSchema, firm: str | None = None) -> DataFrame:
    """Billable time facts (``is_billable = true``: NULL and false are dropped)."""
    t = star.fct_time_entry.filter(F.col("is_billable"))
    return apply_firm(t, firm)


def firms(star: StarSchema) -> DataFrame:
    """Member firms that have time facts: id, and the id again as the name; from the date profile if there is one."""
    f = (star.profiles.get("fct_time_entry", star.fct_time_entry)
         .filter(F.col("member_firm_id").isNotNull() & (F.col("member_firm_id") != ""))
         .select("member_firm_id").distinct())
    return (f.select("member_firm_id", F.col("member_firm_id").alias("member_firm_name"))
            .orderBy("member_firm_id"))


def time_gauges(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
                by: Sequence[str] = (), prune: bool | None = None) -> DataFrame:
    """Hours and TVP over the six periods, write-up/down over the four to-date
    periods, of billable time. ``prune`` as in ``pruning``."""
    w = PeriodWindows(as_of_date(as_of))
    return conditional_sums(billable_time(star, firm), "entry_date", w, TIME_MEASURES,
                            **pruning(star, "fct_time_entry", by, prune, firm, True))


def invoice_gauges(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
                   by: Sequence[str] = (), prune: bool | None = None) -> DataFrame:
    w = PeriodWindows(as_of_date(as_of))
    inv = apply_firm(star.fct_invoice, firm)
    return conditional_sums(inv, "invoice_date", w, INVOICE_MEASURES,
                            **pruning(star, "fct_invoice", by, prune, firm))


def cash_gauges(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
                by: Sequence[str] = (), prune: bool | None = None) -> DataFrame:
    w = PeriodWindows(as_of_date(as_of))
    cash = apply_firm(star.fct_cash_receipt, firm)
    return conditional_sums(cash, "receipt_date", w, CASH_MEASURES,
                            **pruning(star, "fct_cash_receipt", by, prune, firm))


def service_lines(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
                  by: Sequence[str] = (), prune: bool | None = None) -> DataFrame:
    """Hours and TVP per service line over the four to-date periods.

    Every service line with billable time gets a row, also when none of its rows
    falls in a period (sums 0); the NULL service line is a group of its own.
    """
    w = PeriodWindows(as_of_date(as_of))
    keys = [*by, "service_line"]
    out = conditional_sums(billable_time(star, firm), "entry_date", w,
                           SERVICE_LINE_MEASURES, **pruning(star, "fct_time_entry", keys, prune, firm, True))
    return out.orderBy(*[F.col(k).asc_nulls_first() for k in keys])
