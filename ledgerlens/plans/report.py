"""Derived scorecard layer: performance table, gauges and the other panels.

The source page computes these per firm and date in the browser from the query
results. Here each one is a projection (or, for the handful of rows of a panel,
a window) over the DataFrames of ``operators``, so it runs on the executors and
works unchanged on the grouped form: with ``by=["member_firm_id"]`` one pass
serves every firm.

Values are first made numbers the way the page does (NULL -> 0) and then compared
in DOUBLE; see ``functions.compare`` for the rules.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compare as C
from ..functions.params import page_date
from ..operators import gauges as G
from ..operators import snapshots as SN
from ..operators import utilization as U
from ..sources.star import StarSchema

num = C.null_to_zero


# ---------------------------------------------------------------------------
# Inputs: time, invoice and cash gauges in one aggregate
# ---------------------------------------------------------------------------

def scorecard_measures(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
                       by: Sequence[str] = (), prune: bool | None = None) -> DataFrame:
    """The 28 gauge sums of the time, invoice and cash facts as one row (per group).

    Each fact table gets its own aggregate (one scan each, fully codegen'd
    partial aggregation, each row evaluating only its own table's measures);
    the one-row (or one-row-per-firm) results are then stacked and merged with
    ``max``, which sees one non-NULL value per column. No join between the
    results, and each table keeps its own NULL/0 rules: a firm without invoices
    still gets NULL billings, as the separate queries give.
    """
    parts = [G.time_gauges(star, as_of, firm, by=by, prune=prune),
             G.invoice_gauges(star, as_of, firm, by=by, prune=prune),
             G.cash_gauges(star, as_of, firm, by=by, prune=prune)]
    names = [c for p in parts for c in p.columns if c not in by]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = [F.max(c).alias(c) for c in names]
    return stacked.groupBy(*by).agg(*merged) if by else stacked.agg(*merged)


# ---------------------------------------------------------------------------
# Unpivot helper: one input row -> a fixed list of labelled rows
# ---------------------------------------------------------------------------

def _unpivot(df: DataFrame, by: Sequence[str], rows: list[dict]) -> DataFrame:
    """Explode a literal list of structs built from the row's columns.

    A Generate over each row; no shuffle, no N-way union of scans.
    """
    structs = [F.struct(*[(v if not isinstance(v, (str, int, float, bool)) else F.lit(v)).alias(k)
                          for k, v in r.items()]) for r in rows]
    return df.select(*by, F.explode(F.array(*structs)).alias("_r")).select(*by, "_r.*")


_PERIOD_KEYS = (("MTD", "mtd", "month"), ("YTD", "ytd", "year"))


def perf_table(measures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Six metrics x {MTD, YTD}: current, prior, percent change, status."""
    rows = []
    for period, k, _ in _PERIOD_KEYS:
        cy_h, py_h = num(f"cy_{k}_hours"), num(f"py_{k}_hours")
        cy_t, py_t = num(f"cy_{k}_tvp"), num(f"py_{k}_tvp")
        cy_w, py_w = num(f"cy_{k}_wuwd"), num(f"py_{k}_wuwd")
        metrics = [
            ("Billable Hours", "number", cy_h, py_h),
            ("TVP", "currency", cy_t, py_t),
            ("Avg Billable Rate", "rate", C.avg_rate(cy_t, cy_h), C.avg_rate(py_t, py_h)),
            ("Billings", "currency", num(f"cy_{k}_billings"), num(f"py_{k}_billings")),
            ("Realization %", "percent", C.realization(cy_t, cy_w), C.realization(py_t, py_w)),
            ("Collections", "currency", num(f"cy_{k}_cash"), num(f"py_{k}_cash")),
        ]
        for pos, (metric, unit, cur, pri) in enumerate(metrics, 1):
            rows.append({"period": period, "position": pos, "metric": metric, "unit": unit,
                         "current": cur, "prior": pri})
    out = _unpivot(measures, by, rows)
    return (out.withColumn("pct_chg", C.pct_change("current", "prior"))
            .withColumn("status", C.status(F.col("pct_chg"))))


def gauges_table(measures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hours, TVP, Billings, Collections x {MTD, YTD}: current, prior-year same
    period, prior-year full period, change, status, gauge fill ratio."""
    rows = []
    for period, k, full in _PERIOD_KEYS:
        labels = [("Hours", "hours", "number"), ("TVP", "tvp", "currency"),
                  ("Billings", "billings", "currency"), ("Collections", "cash", "currency")]
        for pos, (label, m, unit) in enumerate(labels, 1):
            rows.append({"period": period, "position": pos, "label": label, "unit": unit,
                         "current": num(f"cy_{k}_{m}"), "py_same": num(f"py_{k}_{m}"),
                         "py_full": num(f"py_full_{full}_{m}")})
    out = _unpivot(measures, by, rows)
    return (out.withColumn("pct_chg", C.pct_change("current", "py_same"))
            .withColumn("status", C.status(F.col("pct_chg")))
            .withColumn("ratio", C.gauge_ratio("current", "py_full"))
            .withColumn("ratio_clamped", C.clamp01(F.col("ratio"))))


def tvp_summary(time_gauges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TVP now and a year ago, MTD and YTD, with change and status."""
    rows = [{"period": p, "current": num(f"cy_{k}_tvp"), "prior": num(f"py_{k}_tvp")}
            for p, k, _ in _PERIOD_KEYS]
    out = _unpivot(time_gauges, by, rows)
    return (out.withColumn("pct_chg", C.pct_change("current", "prior"))
            .withColumn("status", C.status(F.col("pct_chg"))))


def service_line_change(service_lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MTD hours and TVP per service line against the prior year."""
    h_cur, h_pri = num("cy_mtd_hours"), num("py_mtd_hours")
    t_cur, t_pri = num("cy_mtd_tvp"), num("py_mtd_tvp")
    out = service_lines.select(
        *by, "service_line",
        h_cur.alias("cy_mtd_hours"), h_pri.alias("py_mtd_hours"),
        C.pct_change(h_cur, h_pri).alias("hours_pct_chg"),
        t_cur.alias("cy_mtd_tvp"), t_pri.alias("py_mtd_tvp"),
        C.pct_change(t_cur, t_pri).alias("tvp_pct_chg"))
    return (out.withColumn("hours_status", C.status(F.col("hours_pct_chg")))
            .withColumn("tvp_status", C.status(F.col("tvp_pct_chg"))))


def utilization_metrics(utilization: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per level: average hours, TVP per person and average rate per hour."""
    hc = F.coalesce(F.col("headcount"), F.lit(0)).cast("double")
    hours, tvp = num("total_hours"), num("total_tvp")
    return utilization.select(
        *by, "staff_level", "staff_level_index", F.col("headcount"),
        F.when(hc > 0, hours / F.nullif(hc, F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_hours"),
        F.when(hc > 0, tvp / F.nullif(hc, F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_tvp"),
        C.avg_rate(tvp, hours).alias("avg_rate"))


def utilization_share(utilization: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bar length of each level: average hours against the largest average (at
    least 40 hours), in percent, capped at 100; and the hours band.

    The window holds the rows of one panel (one per staff level), so its
    partition is as small as the level list even when ``by`` is empty.
    """
    m = utilization_metrics(utilization, by)
    scale = F.greatest(F.max("avg_hours").over(Window.partitionBy(*by)),
                       F.lit(C.UTILIZATION_MIN_SCALE_HOURS))
    return (m.select(*by, "staff_level", "staff_level_index", "avg_hours",
                     scale.alias("scale_hours"))
            .withColumn("bar_pct", F.least(F.col("avg_hours") / F.col("scale_hours") * 100,
                                           F.lit(100.0)))
            .withColumn("band", C.utilization_band(F.col("avg_hours"))))


AR_BUCKET_LABELS = [("Current", "current_bucket"), ("31-60", "bucket_31_60"),
                    ("61-90", "bucket_61_90"), ("91-120", "bucket_91_120"),
                    ("120+", "bucket_120_plus")]


def ar_distribution(ar_aging: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Five labelled AR buckets: amount, height relative to the largest bucket
    (at least 1), share of the total (0 unless the total is positive)."""
    values = [num(c) for _, c in AR_BUCKET_LABELS]
    base = ar_aging.select(*by, *[v.alias(c) for v, (_, c) in zip(values, AR_BUCKET_LABELS)],
                           num("total").alias("total"))
    max_val = F.greatest(*[F.col(c) for _, c in AR_BUCKET_LABELS], F.lit(1.0))
    rows = [{"position": i, "bucket": label, "amount": F.col(c), "max_amount": max_val,
             "total": F.col("total")} for i, (label, c) in enumerate(AR_BUCKET_LABELS, 1)]
    out = _unpivot(base, by, rows)
    share = (F.when(F.col("total") > 0,
                    F.col("amount") / F.nullif(F.col("total"), F.lit(0.0)) * 100)
             .otherwise(F.lit(0.0)))
    return (out.withColumn("rel_height", F.col("amount") / F.col("max_amount"))
            .withColumn("share_pct", share)
            .withColumn("show_label", F.col("share_pct") >= C.SHARE_LABEL_MIN_PCT)
            .drop("max_amount"))


def risk_total(risk: DataFrame, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of listed clients and their total, over the returned top-k rows.

    The total is summed exactly (DECIMAL) and converted once, so it does not
    depend on the order in which tasks deliver the rows."""
    cols = [F.count(F.lit(1)).alias("items"),
            F.coalesce(F.sum(F.col(amount)).cast("double"), F.lit(0.0)).alias("total")]
    return risk.groupBy(*by).agg(*cols) if by else risk.agg(*cols)


def risk_search(risk: DataFrame, query: str) -> DataFrame:
    """Rows whose client or partner name contains ``query`` (any case)."""
    if not query:
        return risk
    return risk.filter(C.name_contains("client_name", query)
                       | C.name_contains("partner_name", query))


# ---------------------------------------------------------------------------
# The page as a whole
# ---------------------------------------------------------------------------

def scorecard(star: StarSchema, as_of: str | dt.date | None, firm: str | None = None,
              by: Sequence[str] = (), time_rollup: DataFrame | None = None,
              measures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every panel of the scorecard for one (as-of, firm). Lazy DataFrames.

    A missing as-of date means the reporting Friday. ``time_rollup`` (the daily rollup of
    ``plans.rollup``, ideally materialised) serves the time gauges and service lines, which
    are exact on it; utilization needs the person and keeps reading the raw time facts.
    Nothing is cached here: panels that run as separate jobs can share a ``measures``
    frame that the caller caches and releases. For all firms at once use
    ``plans.all_firms.scorecard``, which also gives firms without rows their NULL row.
    """
    from .rollup import with_time_rollup

    t = page_date(as_of)
    gstar = star if time_rollup is None else with_time_rollup(star, time_rollup)
    measures = scorecard_measures(gstar, t, firm, by=by) if measures is None else measures
    lines = G.service_lines(gstar, t, firm, by=by)
    util = U.utilization(star, t, firm, by=by)
    aging = SN.ar_aging(star, t, firm, by=by)
    wip_r = SN.wip_risk(star, t, firm, by=by)
    ar_r = SN.ar_risk(star, t, firm, by=by)
    return {
        "tvp_summary": tvp_summary(measures, by),
        "gauges": gauges_table(measures, by),
        "perf_table": perf_table(measures, by),
        "service_line_change": service_line_change(lines, by),
        "utilization": utilization_metrics(util, by),
        "utilization_share": utilization_share(util, by),
        "ar_distribution": ar_distribution(aging, by),
        "wip_risk": wip_r,
        "wip_risk_total": risk_total(wip_r, "wip_amount", by),
        "ar_risk": ar_r,
        "ar_risk_total": risk_total(ar_r, "ar_amount", by),
    }


# Columns that name a row of each panel, in the order of the page (fixed values). Risk
# lists are ordered by amount first.
ROW_LABELS = {
    "tvp_summary": ["period"], "gauges": ["period", "position", "label"],
    "perf_table": ["period", "position", "metric"], "service_line_change": ["service_line"],
    "utilization": ["staff_level_index", "staff_level"],
    "utilization_share": ["staff_level_index", "staff_level"],
    "ar_distribution": ["position", "bucket"],
    "wip_risk": ["client_name", "partner_name"], "ar_risk": ["client_name", "partner_name"],
    "wip_risk_total": [], "ar_risk_total": [],
}


def long_form(panels: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The page as one frame: by..., panel, position, label, measure, value, text.

    One row per panel row and measure; numbers are in ``value``, everything else in ``text``.
    Panels are small (a few rows, or a top-k list, per group), so ranking their rows is too.
    """
    parts = []
    for name, df in panels.items():
        labels = ROW_LABELS[name]
        order = [F.col(c).asc_nulls_first() for c in labels]
        if name in ("wip_risk", "ar_risk"):
            order.insert(0, F.col(name.replace("risk", "amount")).desc())
        position = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) if labels else F.lit(1)
        cells = []
        for f in df.schema.fields:
            if f.name in labels or f.name in by:
                continue
            number = isinstance(f.dataType, T.NumericType)
            cells.append(F.struct(
                F.lit(f.name).alias("measure"),
                (F.col(f.name) if number else F.lit(None)).cast("double").alias("value"),
                (F.lit(None) if number else F.col(f.name)).cast("string").alias("text")))
        label = F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels])
        # ranked before the cells are spread
        rows = df.select(*by, F.lit(name).alias("panel"), position.alias("position"),
                         label.alias("label"), F.array(*cells).alias("_cells"))
        parts.append(rows.withColumn("_c", F.explode("_cells"))
                     .select(*by, "panel", "position", "label", "_c.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)
