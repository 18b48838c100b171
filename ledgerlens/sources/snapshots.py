"""Periodic aging-snapshot builder.

The scorecard reads AR and WIP aging snapshots: one row per (report_date,
client_key, member_firm_id) with the open amount split into age buckets. The
driver's test data has open items but no snapshots, so this builder derives them:
every open item is placed in each report date on or after its own date, however old
it is, then amounts are summed per bucket.

Items are first summed per client, firm and day (a client that holds a large share of the
items sends one row per day and map task), then placed by a generator over the
(parameter-sized) list of report dates and summed per snapshot row; there is no join.
Where one report date is asked for, ``snapshot_of`` builds its rows alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = ["report_date", "client_key", "member_firm_id"]


def _due(report_dates: Sequence[dt.date]) -> Column:
    """The report dates on or after ``item_date``."""
    dates = F.array(*[F.lit(d) for d in sorted(report_dates)])
    return F.filter(dates, lambda r: r >= F.col("item_date"))


def dates_with_rows(open_items: DataFrame, report_dates: Sequence[dt.date]) -> DataFrame:
    """The report dates of which ``aging_snapshot`` has rows, from the distinct days of the items: no snapshot is built."""
    return open_items.select("item_date").distinct().select(F.explode(_due(report_dates)).alias("report_date")).distinct()


def aging_snapshot(open_items: DataFrame, report_dates: Sequence[dt.date],
                   buckets: Sequence[tuple[str, int, int | None]],
                   total_col: str) -> DataFrame:
    """Aggregate open items into aging snapshots.

    ``open_items`` needs ``client_key``, ``member_firm_id``, ``item_date`` (DATE)
    and ``amount``. ``buckets`` lists (column, lowest age, highest age or None).
    Bucket sums use ``ELSE 0``, so every bucket of a non-empty group is non-null.
    """
    due = _due(report_dates)
    per_day = (open_items.groupBy("client_key", "member_firm_id", "item_date")
               .agg(F.sum("amount").alias("amount")))
    placed = (per_day
              .select("client_key", "member_firm_id", "item_date", "amount",
                      F.explode(due).alias("report_date"))
              .withColumn("age", F.datediff(F.col("report_date"), F.col("item_date"))))

    def in_bucket(lo: int, hi: int | None):
        cond = F.col("age") >= lo
        return cond if hi is None else cond & (F.col("age") <= hi)

    aggs = [F.sum(F.when(in_bucket(lo, hi), F.col("amount")).otherwise(F.lit(0))).alias(name)
            for name, lo, hi in buckets]
    aggs.append(F.sum("amount").alias(total_col))
    return placed.groupBy(*GRAIN).agg(*aggs)


def snapshot_of(day: dt.date, open_items: DataFrame, clients: DataFrame,
                buckets: Sequence[tuple[str, int, int | None]], total_col: str) -> DataFrame:
    """The rows that ``aging_snapshot`` has of the one report date ``day``; ``buckets`` must not overlap.

    ``open_items`` needs no firm here: items are first summed per client and bucket, so at most a row per bucket of a
    client meets ``clients`` (``client_key`` and ``member_firm_id``), and the rows that a client has then
    lie together already for the sums per snapshot row.
    """
    age = F.datediff(F.lit(day), F.col("item_date"))
    numbers = [F.when((age >= lo) if hi is None else age.between(lo, hi), F.lit(i)) for i, (_, lo, hi) in enumerate(buckets)]
    per_bucket = (open_items.filter(F.col("item_date") <= F.lit(day))
                  .groupBy("client_key", F.coalesce(*numbers).alias("_bucket"))
                  .agg(F.sum("amount").alias("amount")))
    aggs = [F.sum(F.when(F.col("_bucket") == i, F.col("amount")).otherwise(F.lit(0))).alias(name)
            for i, (name, _, _) in enumerate(buckets)]
    return (per_bucket.join(clients, "client_key")
            .withColumn("report_date", F.lit(day)).groupBy(*GRAIN)
            .agg(*aggs, F.sum("amount").alias(total_col)))
