"""Reporting periods as closed date ranges, computed on the driver.

The scorecard's period tests are date-part predicates on the fact date ``d``
against the as-of date ``t``:

===============  ==================================================
cy_mtd           YEAR(d)=YEAR(t), MONTH(d)=MONTH(t), DAY(d)<=DAY(t)
py_mtd           YEAR(d)=YEAR(t)-1, same month, DAY(d)<=DAY(t)
py_full_month    YEAR(d)=YEAR(t)-1, same month
cy_ytd           YEAR(d)=YEAR(t), d<=t
py_ytd           YEAR(d)=YEAR(t)-1, DAYOFYEAR(d)<=DAYOFYEAR(t)
py_full_year     YEAR(d)=YEAR(t)-1
===============  ==================================================

For DATE values each one is a single closed range, computed here once per
query. A range is a plain ``BETWEEN`` of two literals, which Catalyst pushes to
the parquet scan and prunes partitions with; date-part predicates are not pushed.
The leap-year behaviours of the predicates are kept: as-of 2001-03-01 (day 60)
ends PY YTD at 2000-02-29; as-of 2001-02-28 leaves 2000-02-29 out of PY MTD but
not out of PY full month.

The utilization week, ``WEEKOFYEAR(d)=WEEKOFYEAR(t) AND YEAR(d)=YEAR(t)``, is an
ISO week cut to the calendar year of ``t``; at year edges it is two disjoint
ranges (as-of 1997-12-30: 1-5 Jan 1997 and 29-31 Dec 1997).
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

PERIODS = ["cy_mtd", "py_mtd", "py_full_month", "cy_ytd", "py_ytd", "py_full_year"]
# Periods that end at (the prior-year image of) the as-of date.
TO_DATE_PERIODS = ["cy_mtd", "py_mtd", "cy_ytd", "py_ytd"]

DateRange = tuple[dt.date, dt.date]


def _month_end(year: int, month: int) -> dt.date:
    return dt.date(year, month, calendar.monthrange(year, month)[1])


@dataclass(frozen=True)
class PeriodWindows:
    as_of: dt.date

    def __post_init__(self):
        if self.as_of.year < 2:
            raise ValueError("as-of year must be at least 2 (it has a prior year)")

    @property
    def prior_year(self) -> int:
        return self.as_of.year - 1

    def range(self, period: str) -> DateRange:
        t, py = self.as_of, self.prior_year
        if period == "cy_mtd":
            return dt.date(t.year, t.month, 1), t
        if period == "py_mtd":
            end = _month_end(py, t.month)
            return dt.date(py, t.month, 1), min(end, dt.date(py, t.month, min(t.day, end.day)))
        if period == "py_full_month":
            return dt.date(py, t.month, 1), _month_end(py, t.month)
        if period == "cy_ytd":
            return dt.date(t.year, 1, 1), t
        if period == "py_ytd":
            start = dt.date(py, 1, 1)
            doy = t.timetuple().tm_yday
            return start, min(start + dt.timedelta(days=doy - 1), dt.date(py, 12, 31))
        if period == "py_full_year":
            return dt.date(py, 1, 1), dt.date(py, 12, 31)
        raise KeyError(period)

    def ranges(self) -> dict[str, DateRange]:
        return {p: self.range(p) for p in PERIODS}

    def cuts(self) -> list[dt.date]:
        """First days of the stretches of days that lie in the same periods (ascending); all days before them lie in none."""
        ends = {hi + dt.timedelta(days=1) for _, hi in self.ranges().values() if hi < dt.date.max}
        return sorted({lo for lo, _ in self.ranges().values()} | ends)

    def span(self) -> DateRange:
        """Smallest range covering all six periods: Jan 1 of PY to the as-of date."""
        return dt.date(self.prior_year, 1, 1), self.as_of


def iso_week_in_year(as_of: dt.date) -> list[DateRange]:
    """Dates of year(t) whose ISO week number equals that of t, as ranges."""
    week = as_of.isocalendar()[1]
    day = dt.date(as_of.year, 1, 1)
    last = dt.date(as_of.year, 12, 31)
    ranges: list[list[dt.date]] = []
    while day <= last:
        if day.isocalendar()[1] == week:
            if ranges and ranges[-1][1] == day - dt.timedelta(days=1):
                ranges[-1][1] = day
            else:
                ranges.append([day, day])
        day += dt.timedelta(days=1)
    return [(a, b) for a, b in ranges]


def monday_week(as_of: dt.date) -> DateRange:
    """Alternative, contiguous week rule: the Monday-to-Sunday week of t.

    Not the reference rule; offered as a separately named option.
    """
    start = as_of - dt.timedelta(days=as_of.weekday())
    return start, start + dt.timedelta(days=6)
