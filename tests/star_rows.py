"""Literal rows of the star tables, for the hand-written tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerlens.sources import schema as S
from ledgerlens.sources.star import StarSchema

D = Decimal


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def make_star(spark, **tables) -> StarSchema:
    """A star schema of literal rows; tables not given are empty."""
    dfs = {}
    for name, schema in S.STAR_SCHEMAS.items():
        rows = tables.get(name, [])
        dfs[name] = spark.createDataFrame(rows, schema)
    return StarSchema(**dfs)


def time_row(firm="F1", person=1, day="2000-06-10", hours="1.00", tvp="100.00", wuwd=None,
             billable=True, line="Audit"):
    return (firm, person, d(day), None if hours is None else D(hours),
            None if tvp is None else D(tvp), None if wuwd is None else D(wuwd), billable, line)


def snap_row(kind, report="2000-03-31", client=1, firm="F1", **buckets):
    cols = S.AR_BUCKETS + ["ar_total"] if kind == "ar" else S.WIP_BUCKETS + ["wip_total"]
    vals = [buckets.get(c, D("0.00")) for c in cols]
    return (d(report), client, firm, *vals)
