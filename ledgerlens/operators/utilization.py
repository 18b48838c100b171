"""Weekly utilization by staff level.

Per (staff_level, staff_level_index): distinct people with billable time in the
week of the as-of date, their total hours and TVP. The week is the reference
rule, ISO week number and calendar year of the as-of date, which at year edges is
two disjoint date ranges; the ranges are computed on the driver and pushed to
the scan. The whole week counts, including days after the as-of date.

Plan: the week's billable facts are first summed per person (partial aggregation
on the map side, so one person with a large share of the rows costs one row per
map task), then joined to the person dimension, then summed per level. The headcount is
the distinct people after the join (also if a dimension repeated a key), over one row per
person. The join side from the facts is at most one row per
person; Spark broadcasts whichever side AQE measures under the threshold and
falls back to a sort-merge join otherwise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.params import as_of_date
from ..functions.periods import iso_week_in_year, monday_week
from ..sources.star import StarSchema
from .gauges import billable_time
from .measures import in_range

WEEK_RULES = {
    "iso_week_in_year": iso_week_in_year,
    "monday_week": lambda t: [monday_week(t)],
}


def week_filter(as_of: dt.date, rule: str = "iso_week_in_year"):
    ranges = WEEK_RULES[rule](as_of)
    return reduce(lambda a, b: a | b, [in_range("entry_date", lo, hi) for lo, hi in ranges])


def staffed_levels(star: StarSchema) -> DataFrame:
    return star.dim_person.filter(F.col("staff_level").isNotNull()
                                  & (F.col("staff_level") != ""))


def utilization(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
                by: Sequence[str] = (), week_rule: str = "iso_week_in_year",
                dropped: Observation | None = None) -> DataFrame:
    """Headcount, hours and TVP per staff level in the week of the as-of date.

    ``dropped`` is told, when the panel runs and at no further scan, what the inner join leaves out: ``facts``, ``hours`` and
    ``tvp`` of time entries whose person is not in the dimension. A plan that Spark
    proves empty observes nothing.
    """
    t = as_of_date(as_of)
    week = billable_time(star, firm).filter(week_filter(t, week_rule))
    per_person = (week.groupBy(*by, "person_key")
                  .agg(F.count(F.lit(1)).alias("facts"), F.sum("hours").alias("hours"),
                       F.sum("production_amount").alias("tvp")))
    return per_level(star, per_person, by, dropped)


def per_level(star: StarSchema, per_person: DataFrame, by: Sequence[str] = (),
              dropped: Observation | None = None) -> DataFrame:
    """Headcount, hours and TVP per staff level from sums per person (``by``, person_key, facts, hours, tvp)."""
    if dropped is None:
        joined = per_person.join(staffed_levels(star), "person_key")
    else:
        known = star.dim_person.withColumn("_known", F.lit(True))
        unknown = F.col("_known").isNull()
        joined = (per_person.join(known, "person_key", "left")
                  .observe(dropped, *[F.coalesce(F.sum(F.when(unknown, F.col(c))), F.lit(0)).alias(c) for c in ("facts", "hours", "tvp")])
                  .filter(F.col("_known") & F.col("staff_level").isNotNull() & (F.col("staff_level") != "")))
    out = (joined.groupBy(*by, "staff_level", "staff_level_index")
           .agg(F.countDistinct("person_key").alias("headcount"),
                F.sum("hours").alias("total_hours"),
                F.sum("tvp").alias("total_tvp")))
    return out.orderBy(*by, "staff_level_index", "staff_level")
