"""Scale form: every scorecard panel for all member firms in one pass.

The source system answers one (as-of, firm) pair per query, so a report for N
firms costs N scans of each fact table. Here the firm is a group key: one scan,
partial aggregation per map task, and a shuffle of at most (firms x tasks) rows.

To give each firm exactly what its single-firm query gives:

* the firms are the listed ones (non-null, non-empty ids of the time facts);
* a single-firm global aggregate always returns a row (NULLs when the firm has no
  rows), a grouped one does not, so one-row panels are left-joined from the firm
  list (an equi-join on the firm id; the list is one row per firm);
* grouped panels (service lines, utilization, risk lists) keep only listed firms;
* risk lists are a top-k per firm (``row_number`` window with a limit, planned as
  ``WindowGroupLimit``, which cuts to k rows per firm before the final shuffle).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import as_of_date, page_date
from ..functions.periods import PeriodWindows
from ..operators import gauges as G
from ..operators import snapshots as SN
from ..operators import utilization as U
from ..operators.measures import Measure, in_range, measure_columns
from ..session import written
from ..sources.star import StarSchema
from . import report as R

BY = ["member_firm_id"]


def _listed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("member_firm_id").isNotNull() & (F.col("member_firm_id") != ""))


def listed_firms(star: StarSchema) -> DataFrame:
    """Firms of the time facts; from their date profile where the star has one."""
    facts = star.profiles.get("fct_time_entry", star.fct_time_entry)
    return _listed(facts.select("member_firm_id")).distinct()


def _per_firm_row(star: StarSchema, grouped: DataFrame,
                  firms: DataFrame | None = None) -> DataFrame:
    firms = listed_firms(star) if firms is None else firms
    return firms.join(grouped, BY, "left")


def time_gauges(star: StarSchema, as_of: str | dt.date | None,
                prune: bool | None = None) -> DataFrame:
    """Time gauges of every listed firm.

    One scan: all rows are grouped, so every listed firm gets its row, and the billable test
    stands inside the sums, where other rows add nothing (a firm without billable rows keeps
    its NULLs). With a date profile, or ``prune=True``, only the span of the periods is read.
    """
    if prune or (prune is None and star.profiles):
        return _per_firm_row(star, G.time_gauges(star, as_of, by=BY, prune=True))
    windows = PeriodWindows(as_of_date(as_of))
    cols = measure_columns("entry_date", windows, G.TIME_MEASURES, F.col("is_billable"))
    return _listed(star.fct_time_entry).groupBy(*BY).agg(*cols)


def invoice_gauges(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return _per_firm_row(star, G.invoice_gauges(star, as_of, by=BY))


def cash_gauges(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return _per_firm_row(star, G.cash_gauges(star, as_of, by=BY))


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per firm of the first part: every other part has at most one row per firm and columns of its own."""
    parts = [parts[0].withColumn("_is_listed", F.lit(True)), *parts[1:]]
    names = [c for p in parts for c in p.columns if c not in BY]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return (stacked.groupBy(*BY).agg(*[F.max(c).alias(c) for c in names])
            .filter("_is_listed").drop("_is_listed"))


def measures(star: StarSchema, as_of: str | dt.date | None, prune: bool | None = None) -> DataFrame:
    """The 28 gauge sums of every listed firm. The list of firms is one more part of the merge, not a
    join: without pruning it is the time part itself, else the date profile (or the key column)."""
    money = [G.invoice_gauges(star, as_of, by=BY, prune=prune), G.cash_gauges(star, as_of, by=BY, prune=prune)]
    if prune or (prune is None and star.profiles):
        return _merged([listed_firms(star), G.time_gauges(star, as_of, by=BY, prune=True), *money])
    return _merged([time_gauges(star, as_of, prune=False), *money])


def perf_table(star: StarSchema, as_of: str | dt.date | None,
               prune: bool | None = None) -> DataFrame:
    return R.perf_table(measures(star, as_of, prune), BY)


def gauges(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return R.gauges_table(measures(star, as_of), BY)


def service_lines(star: StarSchema, as_of: str | dt.date | None,
                  prune: bool | None = None) -> DataFrame:
    return _listed(G.service_lines(star, as_of, by=BY, prune=prune))


def utilization(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return _listed(U.utilization(star, as_of, by=BY))


def utilization_share(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return R.utilization_share(utilization(star, as_of), BY)


def wip_aging(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return _per_firm_row(star, SN.wip_aging(star, as_of, by=BY))


def tvp_summary(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return R.tvp_summary(time_gauges(star, as_of), BY)


def service_line_change(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return R.service_line_change(service_lines(star, as_of), BY)


def ar_aging(star: StarSchema, as_of: str | dt.date | None,
             firms: DataFrame | None = None) -> DataFrame:
    return _per_firm_row(star, SN.ar_aging(star, as_of, by=BY), firms)


def ar_distribution(star: StarSchema, as_of: str | dt.date | None,
                    firms: DataFrame | None = None) -> DataFrame:
    return R.ar_distribution(ar_aging(star, as_of, firms), BY)


def _risk_for_listed(star: StarSchema, risk: DataFrame,
                     firms: DataFrame | None = None) -> DataFrame:
    firms = listed_firms(star) if firms is None else firms
    return risk.join(firms, BY, "left_semi")


def ar_risk(star: StarSchema, as_of: str | dt.date | None, top: int = SN.RISK_TOP_K,
            firms: DataFrame | None = None) -> DataFrame:
    return _risk_for_listed(star, SN.ar_risk(star, as_of, top=top, by=BY), firms)


def wip_risk(star: StarSchema, as_of: str | dt.date | None, top: int = SN.RISK_TOP_K,
             firms: DataFrame | None = None) -> DataFrame:
    return _risk_for_listed(star, SN.wip_risk(star, as_of, top=top, by=BY), firms)


def _risk_total(star: StarSchema, risk: DataFrame, amount: str,
                firms: DataFrame | None = None) -> DataFrame:
    """Per firm: items and total of its top-k list. A single-firm total over an
    empty list is (0, 0.0), so firms without at-risk clients get that row."""
    totals = R.risk_total(risk, amount, BY)
    firms = listed_firms(star) if firms is None else firms
    return (firms.join(totals, BY, "left")
            .select("member_firm_id", F.coalesce("items", F.lit(0)).alias("items"),
                    F.coalesce("total", F.lit(0.0)).alias("total")))


def ar_risk_total(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return _risk_total(star, ar_risk(star, as_of), "ar_amount")


def wip_risk_total(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    return _risk_total(star, wip_risk(star, as_of), "wip_amount")


def _stretch(date_col: str, windows: PeriodWindows) -> Column:
    """The first day of the stretch of days that lie in the same periods; null before all periods."""
    return reduce(lambda when, d: F.when(F.col(date_col) >= F.lit(d), F.lit(d)).otherwise(when), windows.cuts(), F.lit(None).cast("date"))


def money_sums(facts: DataFrame, date_col: str, as_of: str | dt.date | None, measures: Sequence[Measure]) -> DataFrame:
    """The measures of one amount per firm, as ``conditional_sums`` has them.

    A fact adds one sum, per firm and stretch of days, not one per measure; the measures repeat only these sums.
    Facts outside all periods only name their firm: their amounts are neither cast nor added.
    """
    windows, amount = PeriodWindows(as_of_date(as_of)), measures[0].value
    inside = in_range(date_col, *windows.span())
    facts = facts.withColumn(amount, F.when(inside, F.col(amount)))
    stretches = facts.groupBy(*BY, _stretch(date_col, windows).alias(date_col)).agg(F.sum(amount).alias(amount))
    return stretches.groupBy(*BY).agg(*measure_columns(date_col, windows, measures))


# Numbers of the grouping sets of ``time_grains``: a bit per key (firm, service line, person), set if the set lacks it.
FIRM_GRAIN, LINE_GRAIN, PERSON_GRAIN = 0b011, 0b001, 0b010


def time_grains(star: StarSchema, as_of: str | dt.date | None) -> DataFrame:
    """All that the page needs of the time facts, in one scan.

    The facts are summed once, per firm, service line, person of the as-of date's week (null in other rows), billable test
    and stretch of days that lie in the same periods (named by its first day, null before all periods): three sums per
    fact, not one per measure. The measures and grouping sets repeat only these sums: per firm, per firm and service
    line, and per firm and person of the as-of date's week. ``billable`` counts the rows that pass the test, so
    lines without one can be left out, and firms without one keep their NULLs. Facts outside all periods and the week
    are counted, but their amounts, which no measure has, are neither cast nor added: most facts of a long history.
    """
    t = as_of_date(as_of)
    windows, billable = PeriodWindows(t), F.coalesce("is_billable", F.lit(False))
    rows = (_listed(star.fct_time_entry)
            .withColumn("_week", F.coalesce(billable & U.week_filter(t), F.lit(False)))
            .withColumn("person", F.when(F.col("_week"), F.col("person_key"))))
    used = in_range("entry_date", *windows.span()) | F.col("_week")
    amounts = {"hours": F.col("hours"), "production_amount": F.col("production_amount"), "write_up_down": F.coalesce("write_up_down", F.lit(0))}
    rows = rows.withColumns({name: F.when(used, amount) for name, amount in amounts.items()})
    fine = (rows.groupBy("member_firm_id", "service_line", "person", "_week", billable.alias("is_billable"), _stretch("entry_date", windows).alias("entry_date"))
            .agg(F.count(F.lit(1)).alias("facts"), *[F.sum(name).alias(name) for name in amounts]))
    sums = measure_columns("entry_date", windows, G.TIME_MEASURES, F.col("is_billable"))
    return (fine.groupingSets([["member_firm_id"], ["member_firm_id", "service_line"], ["member_firm_id", "person"]],
                              "member_firm_id", "service_line", "person")
            .agg(F.grouping_id().alias("grain"), F.sum(F.when(F.col("is_billable"), F.col("facts")).otherwise(0)).alias("billable"), *sums,
                 F.sum(F.when(F.col("_week"), F.col("hours"))).alias("week_hours"),
                 F.sum(F.when(F.col("_week"), F.col("production_amount"))).alias("week_tvp")))


def _cut(grains: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three grains: gauges per firm, service lines per firm, hours per firm and person of the week."""
    firm = grains.filter(F.col("grain") == FIRM_GRAIN).select(*BY, *[m.name for m in G.TIME_MEASURES])
    lines = (grains.filter((F.col("grain") == LINE_GRAIN) & (F.col("billable") > 0))
             .select(*BY, "service_line", *[m.name for m in G.SERVICE_LINE_MEASURES]))
    people = (grains.filter((F.col("grain") == PERSON_GRAIN) & F.col("person").isNotNull())
              .select(*BY, F.col("person").alias("person_key"), F.col("week_hours").alias("hours"), F.col("week_tvp").alias("tvp")))
    return firm, lines, people


def _with_latest(star: StarSchema, table: str, t: dt.date) -> StarSchema:
    """The star with the newest snapshot on or before ``t`` written as all of ``table``, unless metadata lists its dates."""
    if table in star.report_dates:
        return star
    latest = written(SN.latest_snapshot(star, table, t), "latest-snapshot")
    return replace(star, **{table: latest}, dated={k: v for k, v in star.dated.items() if k != table})


def scorecard(star: StarSchema, as_of: str | dt.date | None,
              time_rollup: DataFrame | None = None) -> dict[str, DataFrame]:
    """All panels of the page for all listed firms.

    The time facts are scanned once (``time_grains``), invoices and receipts once, and each risk list is
    computed once for the list and its total; two panels read the written newest AR snapshot. What several panels read is written to the shared folder (rows
    per firm, line, person of the week, or top-k), so panels can run as separate jobs without a cache.
    ``time_rollup`` as in ``report.scorecard``: gauges and lines from the rollup, utilization from the facts.
    """
    from .rollup import with_time_rollup

    t = page_date(as_of)
    if time_rollup is None:
        time, lines, people = _cut(written(time_grains(star, t), "time-grains"))
        levels = U.per_level(star, people, BY)
    else:
        rolled = with_time_rollup(star, time_rollup)
        time, lines, levels = time_gauges(rolled, t, prune=False), service_lines(rolled, t), utilization(star, t)
    money = [money_sums(star.fct_invoice, "invoice_date", t, G.INVOICE_MEASURES), money_sums(star.fct_cash_receipt, "receipt_date", t, G.CASH_MEASURES)]
    m = written(_merged([time, *money]), "firm-measures")
    firms = m.select(*BY)
    star = _with_latest(star, "fct_ar_aging_snapshot", t)
    wip, ar = (written(_risk_for_listed(star, risk(star, t, by=BY), firms), name)
               for risk, name in ((SN.wip_risk, "wip-risk"), (SN.ar_risk, "ar-risk")))
    return {
        "tvp_summary": R.tvp_summary(m, BY),
        "gauges": R.gauges_table(m, BY),
        "perf_table": R.perf_table(m, BY),
        "service_line_change": R.service_line_change(lines, BY),
        "utilization": R.utilization_metrics(levels, BY),
        "utilization_share": R.utilization_share(levels, BY),
        "ar_distribution": ar_distribution(star, t, firms),
        "wip_risk": wip,
        "wip_risk_total": _risk_total(star, wip, "wip_amount", firms),
        "ar_risk": ar,
        "ar_risk_total": _risk_total(star, ar, "ar_amount", firms),
    }
