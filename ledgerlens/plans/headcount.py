"""Utilization from weekly people: exact distinct headcounts that merge.

``weekly_people`` holds, per firm, staff level and run of days, the people with billable time as bitmaps (one bit a person key,
in buckets of 32,768 keys) and their hours and TVP. A run is a week cut at New Year: it starts at the later of its Monday and
January 1. Both week rules are unions of whole runs, at year edges too: an ISO week number in a calendar year is one run
or two (1-5 and 29-31 December 1997 carry number 1), a Monday week is one run or the two sides of New Year. So
``utilization`` reads a few rows per level in place of the time facts, and bitmaps of several runs or firms are
or-ed, where counts could not be added (a person may work in two runs, or for two firms).

Size: firms x levels x runs x buckets, whatever the number of facts. A bitmap is 4 KB, mostly zeros, which
the file format compresses.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import apply_firm, as_of_date
from ..operators.gauges import billable_time
from ..operators.utilization import WEEK_RULES, staffed_levels
from ..sources.star import StarSchema

LEVEL = ["staff_level", "staff_level_index"]


def weekly_people(star: StarSchema) -> DataFrame:
    """member_firm_id, staff_level, staff_level_index, run_start, bucket, people (bitmap), hours, tvp."""
    start = F.greatest(F.trunc("entry_date", "WEEK"), F.trunc("entry_date", "YEAR")).alias("run_start")
    per_person = (billable_time(star).filter(F.col("entry_date").isNotNull())
                  .groupBy("member_firm_id", "person_key", start)
                  .agg(F.sum("hours").alias("hours"), F.sum("production_amount").alias("tvp")))
    return (per_person.join(staffed_levels(star), "person_key")
            .groupBy("member_firm_id", *LEVEL, "run_start", F.bitmap_bucket_number("person_key").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("person_key")).alias("people"),
                 F.sum("hours").alias("hours"), F.sum("tvp").alias("tvp")))


def run_starts(as_of: dt.date, rule: str = "iso_week_in_year") -> list[dt.date]:
    """First days of the runs that make up the week of ``as_of``."""
    out = []
    for lo, hi in WEEK_RULES[rule](as_of):
        out.append(lo)
        if hi.year > lo.year:
            out.append(dt.date(hi.year, 1, 1))
    return out


def _levels(people: DataFrame, by: Sequence[str]) -> DataFrame:
    merged = people.groupBy(*by, *LEVEL, "bucket").agg(
        F.bitmap_or_agg("people").alias("people"), F.sum("hours").alias("hours"), F.sum("tvp").alias("tvp"))
    return merged.groupBy(*by, *LEVEL).agg(
        F.sum(F.bitmap_count("people")).alias("headcount"), F.sum("hours").alias("total_hours"), F.sum("tvp").alias("total_tvp"))


def utilization(people: DataFrame, as_of: str | dt.date | None, firm: str | None = None, by: Sequence[str] = (),
                week_rule: str = "iso_week_in_year") -> DataFrame:
    """``operators.utilization.utilization`` from a (written) ``weekly_people``."""
    runs = apply_firm(people, firm).filter(F.col("run_start").isin(run_starts(as_of_date(as_of), week_rule)))
    return _levels(runs, by).orderBy(*by, "staff_level_index", "staff_level")


def utilization_series(people: DataFrame, as_of_dates: Sequence[str | dt.date], firm: str | None = None) -> DataFrame:
    """``utilization`` for every date: each run is placed at the dates whose week it belongs to."""
    dates = sorted({as_of_date(a) for a in as_of_dates})
    pairs = [(a, start) for a in dates for start in run_starts(a)]
    spots = F.expr("array(" + ", ".join(f"named_struct('as_of', DATE'{a}', 'start', DATE'{s}')" for a, s in pairs) + ")")
    runs = apply_firm(people, firm).filter(F.col("run_start").isin(sorted({s for _, s in pairs})))
    placed = runs.withColumn("_w", F.explode(F.filter(spots, lambda w: w["start"] == F.col("run_start"))))
    return _levels(placed.withColumn("as_of", F.col("_w.as_of")), ["as_of"])
