"""Query parameters: as-of date and member firm, and the reporting-Friday rule."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")

# Default week-ending rule of the scorecard page (fixed values): the most recent
# Friday; on a Friday the same day counts from 17:00 on, before that the Friday
# a week earlier.
FRIDAY_CUTOFF_HOUR = 17


def session_now() -> dt.datetime:
    """The current time in the time zone of the active session (UTC without one)."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    return dt.datetime.now(ZoneInfo(zone))


def as_of_date(value: str | dt.date | None, today: dt.date | None = None) -> dt.date:
    """Strict ``YYYY-MM-DD`` parse; empty or missing means today in the session's time zone.

    Values are never spliced into SQL text, so there is no quoting to get wrong.
    """
    if value is None or value == "":
        return today or session_now().date()
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if not isinstance(value, str) or not _ISO_DATE.match(value):
        raise ValueError(f"as_of_date must be YYYY-MM-DD, got {value!r}")
    return dt.date.fromisoformat(value)


def member_firm(value: str | None) -> str | None:
    """Empty or missing means all firms."""
    return value if value else None


def firm_filter(firm: str | None, col: str = "member_firm_id") -> Column | None:
    firm = member_firm(firm)
    return None if firm is None else (F.col(col) == F.lit(firm))


def apply_firm(df, firm: str | None, col: str = "member_firm_id"):
    cond = firm_filter(firm, col)
    return df if cond is None else df.filter(cond)


def reporting_friday(ts: Column) -> Column:
    """Week-ending Friday of a timestamp, as a DATE column.

    Days back from the timestamp's date: Friday before the cut-off hour 7, Friday
    from the cut-off 0, Saturday 1, Sunday 2, ..., Thursday 6. Computed in the
    session time zone, so the result is always a Friday.
    """
    dow = F.dayofweek(ts)  # 1 = Sunday ... 6 = Friday, 7 = Saturday
    back = (F.when((dow == 6) & (F.hour(ts) < FRIDAY_CUTOFF_HOUR), F.lit(7))
            .otherwise((dow + 1) % 7))
    return F.date_sub(ts.cast("date"), back)


def reporting_friday_of(now: dt.datetime) -> dt.date:
    """Driver-side form of the same rule, for a page default."""
    back = (now.weekday() + 3) % 7  # Monday=0 ... Friday=4 -> 0
    if back == 0 and now.hour < FRIDAY_CUTOFF_HOUR:
        back = 7
    return now.date() - dt.timedelta(days=back)


def page_date(value: str | dt.date | None, now: dt.datetime | None = None) -> dt.date:
    """As-of date of the whole page: empty or missing means the reporting Friday."""
    return as_of_date(value) if value else reporting_friday_of(now or session_now())


def days_before(as_of: str | dt.date | None, days: int) -> dt.date:
    """The as-of date minus ``days`` (the source's unused DATE_SUB helper), as a
    driver-side parameter value."""
    return as_of_date(as_of) - dt.timedelta(days=days)
