"""As-of snapshot lookups: aging buckets and top-k at-risk client lists.

``latest_snapshot`` keeps the newest report date on or before the as-of date,
chosen over the whole snapshot table (not per firm): a firm missing from that
snapshot gets NULL sums or no risk rows, never an older snapshot of its own.
Where metadata lists the report dates (``StarSchema.report_dates``), the date is a literal and only its
partition is opened. Else it is an uncorrelated scalar subquery over the snapshot, or over its dates alone where the
star has them (``StarSchema.dated``); Spark runs it first and uses the result as a pushed equality filter.
Where the star can build that one report date alone (``StarSchema.newest``), nothing else of the snapshot is built.

Bucket groups are added row-wise before summing (``SUM(a + b + ...)``), so a row
with any NULL bucket drops out of that sum; buckets therefore need not add up to
the total. Both rules are kept on purpose.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.params import apply_firm, as_of_date
from ..sources import schema as S
from ..sources.star import StarSchema

AR_OVER_60, AR_OVER_120 = S.AR_BUCKETS[2:], S.AR_BUCKETS[4:]
WIP_OVER_60, WIP_OVER_120 = S.WIP_BUCKETS[2:], S.WIP_BUCKETS[4:]

# Length of the at-risk lists (fixed value).
RISK_TOP_K = 50


def row_sum(cols: Sequence[str]) -> Column:
    """a + b + ...: NULL when any term is NULL."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def newest_report(dates: Sequence[dt.date], as_of: dt.date) -> dt.date | None:
    """The newest of the report dates on or before ``as_of``."""
    return max((d for d in dates if d <= as_of), default=None)


def latest_report_date(snapshot: DataFrame, as_of: dt.date) -> Column:
    return (snapshot.filter(F.col("report_date") <= F.lit(as_of))
            .agg(F.max("report_date")).scalar())


def latest_snapshot(star: StarSchema, table: str, as_of: dt.date) -> DataFrame:
    """Rows of the newest report date on or before ``as_of`` (none without one)."""
    snapshot, dates = getattr(star, table), star.report_dates.get(table)
    whole, newest = star.newest.get(table, (None, None))
    if whole is snapshot:
        return newest(as_of)
    if dates is None:
        return snapshot.filter(F.col("report_date") == latest_report_date(star.dated.get(table, snapshot), as_of))
    return snapshot.filter(F.col("report_date") == F.lit(newest_report(dates, as_of)).cast("date"))


def ar_aging_columns() -> list[Column]:
    return [F.sum("ar_0_30").alias("current_bucket"),
            F.sum("ar_31_60").alias("bucket_31_60"),
            F.sum("ar_61_90").alias("bucket_61_90"),
            F.sum("ar_91_120").alias("bucket_91_120"),
            F.sum(row_sum(AR_OVER_120)).alias("bucket_120_plus"),
            F.sum("ar_total").alias("total")]


def ar_aging(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    snap = apply_firm(latest_snapshot(star, "fct_ar_aging_snapshot", as_of_date(as_of)), firm)
    return snap.groupBy(*by).agg(*ar_aging_columns()) if by else snap.agg(*ar_aging_columns())


def wip_aging(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    snap = apply_firm(latest_snapshot(star, "fct_wip_aging_snapshot", as_of_date(as_of)), firm)
    cols = [F.sum("wip_0_30").alias("wip_0_30"),
            F.sum("wip_31_60").alias("wip_31_60"),
            F.sum("wip_61_90").alias("wip_61_90"),
            F.sum("wip_91_120").alias("wip_91_120"),
            F.sum(row_sum(WIP_OVER_120)).alias("wip_120_plus"),
            F.sum("wip_total").alias("total")]
    return snap.groupBy(*by).agg(*cols) if by else snap.agg(*cols)


def risk_lists(snap: DataFrame, dim_client: DataFrame, buckets: Sequence[str], amount: str,
               top: int, by: Sequence[str] = (), dropped: Observation | None = None) -> DataFrame:
    """Top ``top`` (client_name, partner_name) groups by the row-wise bucket sum.

    Groups are names, not keys: equal names with the same partner merge, and a
    NULL partner is a group of its own. The snapshot is first reduced to one row
    per client key (partial aggregation, exact because SUM of per-key SUMs keeps
    the NULL-skipping rule), so the join to the client dimension carries at most
    one row per client instead of one per snapshot row.

    ``dropped`` is told, when the list runs and at no further scan, what the inner join leaves out: ``facts`` and
    ``amount`` of snapshot rows whose client is not in the dimension. A plan that Spark
    proves empty observes nothing.
    """
    per_client = snap.groupBy(*by, "client_key").agg(
        F.count(F.lit(1)).alias("_facts"), F.sum(row_sum(buckets)).alias("_amt"))
    names = dim_client.select("client_key", "client_name", "partner_name")
    if dropped is None:
        named = per_client.join(names, "client_key")
    else:
        unknown = F.col("_known").isNull()
        named = (per_client.join(names.withColumn("_known", F.lit(True)), "client_key", "left")
                 .observe(dropped, F.coalesce(F.sum(F.when(unknown, F.col("_facts"))), F.lit(0)).alias("facts"),
                          F.coalesce(F.sum(F.when(unknown, F.col("_amt"))), F.lit(0)).alias("amount"))
                 .filter("_known"))
    groups = (named.groupBy(*by, "client_name", "partner_name")
              .agg(F.sum("_amt").alias(amount))
              .filter(F.col(amount) > 0))
    order = [F.col(amount).desc(), F.col("client_name").asc_nulls_first(),
             F.col("partner_name").asc_nulls_first()]
    if not by:
        # Planned as TakeOrderedAndProject: each task keeps its own top k,
        # only k rows per task reach the final merge.
        return groups.orderBy(*order).limit(top)
    # Per group: a window rank with a limit, planned with WindowGroupLimit, which
    # also cuts to k rows per group before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (groups.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")
            .orderBy(*by, *order))


def ar_risk(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
            top: int = RISK_TOP_K, by: Sequence[str] = (), dropped: Observation | None = None) -> DataFrame:
    snap = apply_firm(latest_snapshot(star, "fct_ar_aging_snapshot", as_of_date(as_of)), firm)
    return risk_lists(snap, star.dim_client, AR_OVER_60, "ar_amount", top, by, dropped)


def wip_risk(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
             top: int = RISK_TOP_K, by: Sequence[str] = (), dropped: Observation | None = None) -> DataFrame:
    snap = apply_firm(latest_snapshot(star, "fct_wip_aging_snapshot", as_of_date(as_of)), firm)
    return risk_lists(snap, star.dim_client, WIP_OVER_60, "wip_amount", top, by, dropped)
