"""Period ranges equal the source system's date-part predicates (pure Python)."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions.params import as_of_date, reporting_friday_of
from ledgerlens.functions.periods import PERIODS, PeriodWindows, iso_week_in_year, monday_week


def doy(x: dt.date) -> int:
    return x.timetuple().tm_yday


def predicate(period: str, d: dt.date, t: dt.date) -> bool:
    """The source system's predicates, literally."""
    if period == "cy_mtd":
        return d.year == t.year and d.month == t.month and d.day <= t.day
    if period == "py_mtd":
        return d.year == t.year - 1 and d.month == t.month and d.day <= t.day
    if period == "py_full_month":
        return d.year == t.year - 1 and d.month == t.month
    if period == "cy_ytd":
        return d.year == t.year and d <= t
    if period == "py_ytd":
        return d.year == t.year - 1 and doy(d) <= doy(t)
    if period == "py_full_year":
        return d.year == t.year - 1
    raise KeyError(period)


dates = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31))


@settings(max_examples=400, deadline=None)
@given(t=dates, offset=st.integers(min_value=-800, max_value=400))
def test_ranges_equal_predicates(t, offset):
    d = t + dt.timedelta(days=offset)
    w = PeriodWindows(t)
    for p in PERIODS:
        lo, hi = w.range(p)
        assert (lo <= d <= hi) == predicate(p, d, t), (p, t, d)


def test_all_days_around_leap_years():
    for t in [dt.date(2001, 3, 1), dt.date(2001, 2, 28), dt.date(2000, 12, 31),
              dt.date(2000, 2, 29), dt.date(2004, 3, 1), dt.date(1999, 1, 1)]:
        w = PeriodWindows(t)
        day = dt.date(t.year - 2, 12, 1)
        while day <= dt.date(t.year + 1, 1, 31):
            for p in PERIODS:
                lo, hi = w.range(p)
                assert (lo <= day <= hi) == predicate(p, day, t), (p, t, day)
            day += dt.timedelta(days=1)


def test_leap_edges():
    w = PeriodWindows(dt.date(2001, 3, 1))
    assert w.range("py_ytd") == (dt.date(2000, 1, 1), dt.date(2000, 2, 29))
    w = PeriodWindows(dt.date(2001, 2, 28))
    assert w.range("py_mtd")[1] == dt.date(2000, 2, 28)
    assert w.range("py_full_month")[1] == dt.date(2000, 2, 29)
    w = PeriodWindows(dt.date(2000, 12, 31))
    assert w.range("py_ytd") == (dt.date(1999, 1, 1), dt.date(1999, 12, 31))


@settings(max_examples=200, deadline=None)
@given(t=dates)
def test_iso_week_in_year_equals_predicate(t):
    ranges = iso_week_in_year(t)
    day = dt.date(t.year - 1, 12, 20)
    while day <= dt.date(t.year + 1, 1, 10):
        expected = day.isocalendar()[1] == t.isocalendar()[1] and day.year == t.year
        assert any(lo <= day <= hi for lo, hi in ranges) == expected
        day += dt.timedelta(days=1)


def test_year_edge_week_is_two_ranges():
    assert iso_week_in_year(dt.date(1997, 12, 30)) == [
        (dt.date(1997, 1, 1), dt.date(1997, 1, 5)), (dt.date(1997, 12, 29), dt.date(1997, 12, 31))]
    assert iso_week_in_year(dt.date(1999, 1, 1)) == [(dt.date(1999, 1, 1), dt.date(1999, 1, 3))]
    assert iso_week_in_year(dt.date(2000, 6, 16)) == [(dt.date(2000, 6, 12), dt.date(2000, 6, 18))]
    assert monday_week(dt.date(1997, 12, 30)) == (dt.date(1997, 12, 29), dt.date(1998, 1, 4))


def test_span_covers_all_periods():
    for t in [dt.date(2000, 6, 16), dt.date(2001, 3, 1), dt.date(1997, 12, 30)]:
        w = PeriodWindows(t)
        lo, hi = w.span()
        for p in PERIODS:
            a, b = w.range(p)
            assert lo <= a and b <= hi


def test_strict_date_parameter():
    assert as_of_date("2000-06-16") == dt.date(2000, 6, 16)
    assert as_of_date("", today=dt.date(2020, 1, 1)) == dt.date(2020, 1, 1)
    for bad in ["2024", "2024-1-5", "abc", "2024-02-30", "2000-06-16' OR 1=1 --"]:
        try:
            as_of_date(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_reporting_friday_driver_side():
    # 2000-06-16 is a Friday.
    assert reporting_friday_of(dt.datetime(2000, 6, 16, 16, 59)) == dt.date(2000, 6, 9)
    assert reporting_friday_of(dt.datetime(2000, 6, 16, 17, 0)) == dt.date(2000, 6, 16)
    assert reporting_friday_of(dt.datetime(2000, 6, 17, 9, 0)) == dt.date(2000, 6, 16)
    assert reporting_friday_of(dt.datetime(2000, 6, 22, 23, 0)) == dt.date(2000, 6, 16)


@pytest.mark.parametrize("as_of", ["2000-06-16", "2000-02-29", "2001-03-01", "1999-12-31", "2000-01-01", "9999-12-31"])
def test_days_of_a_stretch_lie_in_the_same_periods(as_of):
    w = PeriodWindows(dt.date.fromisoformat(as_of))
    cuts, day = w.cuts(), dt.date(w.prior_year - 1, 12, 1)
    last = dt.date.fromordinal(min(dt.date.max.toordinal(), w.as_of.toordinal() + 40) - 1)
    inside = lambda d: [lo <= d <= hi for lo, hi in w.ranges().values()]
    while day < last:
        first = max((c for c in cuts if c <= day), default=None)
        assert inside(day) == (inside(first) if first else [False] * len(PERIODS))
        day += dt.timedelta(days=1)
