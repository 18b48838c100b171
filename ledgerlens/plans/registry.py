"""Registered queries: name -> (Spark callable, oracle SQL factory or None).

Every Spark callable takes ``(spark, sf_dir)``, maps the driver's tables in
``sf_dir`` to the star schema and runs one scorecard operator over the whole
tables, returning the edge-normalised DataFrame. The oracle factory returns the
DuckDB statement over the same raw tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import firms_sql as FQ
from oracle import page_sql as PQ
from oracle import queries as Q
from oracle import report_sql as RQ

from ..functions.params import reporting_friday
from ..operators import gauges as G
from ..operators import snapshots as SN
from ..operators import utilization as U
from ..sources.star import StarSchema, from_test_tables, with_null_bucket, without_firm
from . import all_firms as AF
from . import headcount as H
from . import report as R
from . import rollup as RU
from .adhoc import adhoc
from .output import normalize

# Parameter sets of the checks (see FIXTURES): a Friday as the flagship as-of
# date, year-edge and leap-year dates, a named firm, a firm missing from the
# latest snapshot, an unknown firm.
AS_OF = "2000-06-16"
LEAP_DAY = "2001-03-01"
LEAP_YEAR_END = "2000-12-31"
NO_DATA_YEAR = "1990-06-15"
YEAR_EDGE = "1997-12-30"
BEFORE_SNAPSHOTS = "1999-01-01"
FIRM = "NATION_3"
MISSING_FIRM = "NATION_2"
UNKNOWN_FIRM = "NO_SUCH_FIRM"

SparkFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[SparkFn, Callable[[], str] | None]] = {}


def register(name: str, oracle: Callable[[], str] | None):
    def wrap(fn: Callable[[StarSchema], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(from_test_tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = (run, oracle)
        return fn
    return wrap


def _simple(name, op, oracle, as_of=AS_OF, firm=None, **kw):
    register(name, lambda: oracle(as_of, firm))(lambda star: op(star, as_of, firm, **kw))


# Edge inputs of the snapshot panels, only for the entries that test them.
EDGES = {
    "null_bucket": with_null_bucket,
    "missing_firm": lambda star: without_firm(star, MISSING_FIRM, dt.date(2000, 3, 31)),
}


def _edge(name, edge, op, oracle, firm=None):
    register(name, lambda: oracle(AS_OF, firm, edge))(lambda star: op(EDGES[edge](star), AS_OF, firm))


# -- source queries ---------------------------------------------------------------
register("firms", Q.firms)(G.firms)
_simple("time_gauges", G.time_gauges, Q.time_gauges)
_simple("invoice_gauges", G.invoice_gauges, Q.invoice_gauges)
_simple("cash_gauges", G.cash_gauges, Q.cash_gauges)
_simple("service_lines", G.service_lines, Q.service_lines)
_simple("utilization", U.utilization, Q.utilization)
_simple("ar_aging", SN.ar_aging, Q.ar_aging)
_simple("wip_aging", SN.wip_aging, Q.wip_aging)
_simple("wip_risk", SN.wip_risk, Q.wip_risk)
_simple("ar_risk", SN.ar_risk, Q.ar_risk)

# -- parameter variants -----------------------------------------------------------
_simple("time_gauges_firm", G.time_gauges, Q.time_gauges, firm=FIRM)
_simple("time_gauges_leap_day", G.time_gauges, Q.time_gauges, as_of=LEAP_DAY)
_simple("time_gauges_leap_year_end", G.time_gauges, Q.time_gauges, as_of=LEAP_YEAR_END)
_simple("time_gauges_no_data_year", G.time_gauges, Q.time_gauges, as_of=NO_DATA_YEAR)
_simple("time_gauges_unknown_firm", G.time_gauges, Q.time_gauges, firm=UNKNOWN_FIRM)
_simple("time_gauges_year_edge", G.time_gauges, Q.time_gauges, as_of=YEAR_EDGE)
_simple("time_gauges_unpruned", G.time_gauges, Q.time_gauges, prune=False)
_simple("invoice_gauges_firm", G.invoice_gauges, Q.invoice_gauges, firm=FIRM)
_simple("invoice_gauges_leap_day", G.invoice_gauges, Q.invoice_gauges, as_of=LEAP_DAY)
_simple("cash_gauges_firm", G.cash_gauges, Q.cash_gauges, firm=FIRM)
_simple("cash_gauges_leap_year_end", G.cash_gauges, Q.cash_gauges, as_of=LEAP_YEAR_END)
_simple("service_lines_firm", G.service_lines, Q.service_lines, firm=FIRM)
_simple("service_lines_no_data_year", G.service_lines, Q.service_lines, as_of=NO_DATA_YEAR)
_simple("utilization_year_edge", U.utilization, Q.utilization, as_of=YEAR_EDGE)
_simple("utilization_leap_year_end", U.utilization, Q.utilization, as_of=LEAP_YEAR_END)
_simple("utilization_firm", U.utilization, Q.utilization, firm=FIRM)
_simple("ar_aging_firm", SN.ar_aging, Q.ar_aging, firm=FIRM)
_edge("ar_aging_missing_firm", "missing_firm", SN.ar_aging, Q.ar_aging, MISSING_FIRM)
_edge("wip_aging_missing_firm", "missing_firm", SN.wip_aging, Q.wip_aging, MISSING_FIRM)
_edge("wip_risk_missing_firm", "missing_firm", SN.wip_risk, Q.wip_risk, MISSING_FIRM)
_edge("ar_aging_null_bucket", "null_bucket", SN.ar_aging, Q.ar_aging)
_edge("wip_aging_null_bucket", "null_bucket", SN.wip_aging, Q.wip_aging)
_edge("ar_risk_null_bucket", "null_bucket", SN.ar_risk, Q.ar_risk)
_edge("wip_risk_null_bucket", "null_bucket", SN.wip_risk, Q.wip_risk)
_simple("ar_aging_before_first_snapshot", SN.ar_aging, Q.ar_aging, as_of=BEFORE_SNAPSHOTS)
_simple("wip_aging_firm", SN.wip_aging, Q.wip_aging, firm=FIRM)
_simple("wip_risk_firm", SN.wip_risk, Q.wip_risk, firm=FIRM)
_simple("ar_risk_firm", SN.ar_risk, Q.ar_risk, firm=FIRM)
_edge("ar_risk_missing_firm", "missing_firm", SN.ar_risk, Q.ar_risk, MISSING_FIRM)

# -- derived layer ----------------------------------------------------------------


SEARCH = "nation_1"
CLIENT_SEARCH = "#0000011"


def _measures(star, as_of=AS_OF, firm=None, **kw):
    return R.scorecard_measures(star, as_of, firm, **kw)


register("perf_table", lambda: RQ.perf_table(AS_OF))(lambda s: R.perf_table(_measures(s)))
register("perf_table_unpruned", lambda: RQ.perf_table(AS_OF))(
    lambda s: R.perf_table(_measures(s, prune=False)))
register("perf_table_firm", lambda: RQ.perf_table(AS_OF, FIRM))(
    lambda s: R.perf_table(_measures(s, firm=FIRM)))
register("perf_table_no_data_year", lambda: RQ.perf_table(NO_DATA_YEAR))(
    lambda s: R.perf_table(_measures(s, as_of=NO_DATA_YEAR)))
register("perf_table_leap_day", lambda: RQ.perf_table(LEAP_DAY))(
    lambda s: R.perf_table(_measures(s, as_of=LEAP_DAY)))
register("gauges", lambda: RQ.gauges(AS_OF))(lambda s: R.gauges_table(_measures(s)))
register("gauges_leap_year_end", lambda: RQ.gauges(LEAP_YEAR_END))(
    lambda s: R.gauges_table(_measures(s, as_of=LEAP_YEAR_END)))
register("gauges_unknown_firm", lambda: RQ.gauges(AS_OF, UNKNOWN_FIRM))(
    lambda s: R.gauges_table(_measures(s, firm=UNKNOWN_FIRM)))
register("tvp_summary", lambda: RQ.tvp_summary(AS_OF))(
    lambda s: R.tvp_summary(G.time_gauges(s, AS_OF)))
register("service_line_change", lambda: RQ.service_line_change(AS_OF))(
    lambda s: R.service_line_change(G.service_lines(s, AS_OF)))
register("utilization_metrics", lambda: RQ.utilization_metrics(AS_OF))(
    lambda s: R.utilization_metrics(U.utilization(s, AS_OF)))
register("utilization_share", lambda: RQ.utilization_share(AS_OF))(
    lambda s: R.utilization_share(U.utilization(s, AS_OF)))
register("utilization_share_firm", lambda: RQ.utilization_share(AS_OF, FIRM))(
    lambda s: R.utilization_share(U.utilization(s, AS_OF, FIRM)))
register("ar_distribution", lambda: RQ.ar_distribution(AS_OF))(
    lambda s: R.ar_distribution(SN.ar_aging(s, AS_OF)))
_edge("ar_distribution_missing_firm", "missing_firm",
      lambda s, t, firm: R.ar_distribution(SN.ar_aging(s, t, firm)), RQ.ar_distribution, MISSING_FIRM)
register("ar_risk_total", lambda: RQ.risk_total("ar", AS_OF))(
    lambda s: R.risk_total(SN.ar_risk(s, AS_OF), "ar_amount"))
register("wip_risk_total", lambda: RQ.risk_total("wip", AS_OF))(
    lambda s: R.risk_total(SN.wip_risk(s, AS_OF), "wip_amount"))
register("ar_risk_search", lambda: RQ.risk_search("ar", SEARCH.upper(), AS_OF))(
    lambda s: R.risk_search(SN.ar_risk(s, AS_OF), SEARCH.upper()))
register("wip_risk_search", lambda: RQ.risk_search("wip", CLIENT_SEARCH, AS_OF))(
    lambda s: R.risk_search(SN.wip_risk(s, AS_OF), CLIENT_SEARCH))


def _reporting_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event tagged with its week-ending (reporting) Friday."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return normalize(ev.select("event_id", "ts", reporting_friday(F.col("ts")).alias("week_ending")))


QUERIES["reporting_friday"] = (_reporting_friday, RQ.reporting_friday)

# -- scale form: all firms in one pass ----------------------------------------------


for _name, _op, _oracle in [
    ("time_gauges_all_firms", AF.time_gauges, FQ.time_gauges),
    ("perf_table_all_firms", AF.perf_table, FQ.perf_table),
    ("gauges_all_firms", AF.gauges, FQ.gauges),
    ("service_lines_all_firms", AF.service_lines, FQ.service_lines),
    ("utilization_all_firms", AF.utilization, FQ.utilization),
    ("utilization_share_all_firms", AF.utilization_share, FQ.utilization_share),
    ("ar_aging_all_firms", AF.ar_aging, FQ.ar_aging),
    ("ar_distribution_all_firms", AF.ar_distribution, FQ.ar_distribution),
    ("ar_risk_all_firms", AF.ar_risk, FQ.ar_risk),
    ("wip_risk_all_firms", AF.wip_risk, FQ.wip_risk),
    ("invoice_gauges_all_firms", AF.invoice_gauges, FQ.invoice_gauges),
    ("cash_gauges_all_firms", AF.cash_gauges, FQ.cash_gauges),
    ("tvp_summary_all_firms", AF.tvp_summary, FQ.tvp_summary),
    ("service_line_change_all_firms", AF.service_line_change, FQ.service_line_change),
    ("wip_aging_all_firms", AF.wip_aging, FQ.wip_aging),
]:
    register(_name, (lambda o=_oracle: o(AS_OF)))(lambda s, op=_op: op(s, AS_OF))

# -- daily rollup and many as-of dates --------------------------------------------

SERIES = [YEAR_EDGE, BEFORE_SNAPSHOTS, AS_OF, LEAP_YEAR_END, LEAP_DAY, NO_DATA_YEAR]

register("time_gauges_rollup", lambda: Q.time_gauges(AS_OF))(
    lambda s: G.time_gauges(RU.with_time_rollup(s), AS_OF))
register("time_gauges_rollup_leap_day", lambda: Q.time_gauges(LEAP_DAY, FIRM))(
    lambda s: G.time_gauges(RU.with_time_rollup(s), LEAP_DAY, FIRM))
register("service_lines_rollup", lambda: Q.service_lines(AS_OF))(
    lambda s: G.service_lines(RU.with_time_rollup(s), AS_OF))
register("perf_table_rollup", lambda: RQ.perf_table(AS_OF))(
    lambda s: R.perf_table(R.scorecard_measures(RU.with_time_rollup(s), AS_OF)))
register("time_gauges_series", lambda: Q.time_gauges_series(SERIES))(
    lambda s: RU.time_gauges_series(s, SERIES))
register("time_gauges_series_firm", lambda: Q.time_gauges_series(SERIES, FIRM))(
    lambda s: RU.time_gauges_series(RU.with_time_rollup(s), SERIES, FIRM))

# -- alternative week rule and ad-hoc SQL ------------------------------------------

_simple("utilization_monday_week", U.utilization, Q.utilization_monday_week, as_of=YEAR_EDGE,
        week_rule="monday_week")


def _adhoc_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's SQL over the star views, cut to the 200-row preview.

    The bound parameter stands for a value a caller would pass; the statement
    text equals the oracle's (whose literal takes its place).
    """
    star = from_test_tables(spark, sf_dir)
    sql = Q.ADHOC_SQL.replace("DATE '2000-01-01'", ":since")
    return normalize(adhoc(spark, sql, {"since": dt.date(2000, 1, 1)}, star=star))


QUERIES["adhoc_preview"] = (_adhoc_preview, Q.adhoc_preview)

# -- more edges -----------------------------------------------------------------------

# Every reporting Friday of 2000 (week-ending dates of one year).
FRIDAYS_2000 = [(dt.date(2000, 1, 7) + dt.timedelta(weeks=i)).isoformat() for i in range(52)]

_simple("service_lines_leap_day", G.service_lines, Q.service_lines, as_of=LEAP_DAY)
_simple("utilization_no_data_year", U.utilization, Q.utilization, as_of=NO_DATA_YEAR)
_simple("wip_risk_before_first_snapshot", SN.wip_risk, Q.wip_risk, as_of=BEFORE_SNAPSHOTS)
_simple("wip_aging_before_first_snapshot", SN.wip_aging, Q.wip_aging, as_of=BEFORE_SNAPSHOTS)
_simple("cash_gauges_no_data_year", G.cash_gauges, Q.cash_gauges, as_of=NO_DATA_YEAR)
register("gauges_firm", lambda: RQ.gauges(AS_OF, FIRM))(
    lambda s: R.gauges_table(_measures(s, firm=FIRM)))
register("ar_distribution_firm", lambda: RQ.ar_distribution(AS_OF, FIRM))(
    lambda s: R.ar_distribution(SN.ar_aging(s, AS_OF, FIRM)))
register("ar_distribution_before_first_snapshot",
         lambda: RQ.ar_distribution(BEFORE_SNAPSHOTS))(
    lambda s: R.ar_distribution(SN.ar_aging(s, BEFORE_SNAPSHOTS)))
register("time_gauges_series_weekly", lambda: Q.time_gauges_series(FRIDAYS_2000))(
    lambda s: RU.time_gauges_series(s, FRIDAYS_2000))

# -- grouped span pruning (opt-in) ------------------------------------------------------
_simple("service_lines_pruned", G.service_lines, Q.service_lines, prune=True)
_simple("service_lines_pruned_no_data_year", G.service_lines, Q.service_lines,
        as_of=NO_DATA_YEAR, prune=True)
register("time_gauges_all_firms_pruned", lambda: FQ.time_gauges(AS_OF))(
    lambda s: AF.time_gauges(s, AS_OF, prune=True))
register("service_lines_all_firms_pruned", lambda: FQ.service_lines(AS_OF))(
    lambda s: AF.service_lines(s, AS_OF, prune=True))
register("perf_table_all_firms_pruned", lambda: FQ.perf_table(AS_OF))(
    lambda s: AF.perf_table(s, AS_OF, prune=True))
register("perf_table_series", lambda: RQ.perf_table_series(SERIES))(
    lambda s: R.perf_table(RU.measures_series(s, SERIES), ["as_of"]))
register("perf_table_series_firm", lambda: RQ.perf_table_series(SERIES, FIRM))(
    lambda s: R.perf_table(RU.measures_series(s, SERIES, FIRM), ["as_of"]))
register("utilization_metrics_all_firms", lambda: FQ.utilization_metrics(AS_OF))(
    lambda s: R.utilization_metrics(AF.utilization(s, AS_OF), AF.BY))
# firm forms of the derived layer
register("tvp_summary_firm", lambda: RQ.tvp_summary(AS_OF, FIRM))(
    lambda s: R.tvp_summary(G.time_gauges(s, AS_OF, FIRM)))
register("service_line_change_firm", lambda: RQ.service_line_change(AS_OF, FIRM))(
    lambda s: R.service_line_change(G.service_lines(s, AS_OF, FIRM)))
register("utilization_metrics_firm", lambda: RQ.utilization_metrics(AS_OF, FIRM))(
    lambda s: R.utilization_metrics(U.utilization(s, AS_OF, FIRM)))
register("ar_risk_total_firm", lambda: RQ.risk_total("ar", AS_OF, FIRM))(
    lambda s: R.risk_total(SN.ar_risk(s, AS_OF, FIRM), "ar_amount"))
register("wip_risk_total_firm", lambda: RQ.risk_total("wip", AS_OF, FIRM))(
    lambda s: R.risk_total(SN.wip_risk(s, AS_OF, FIRM), "wip_amount"))
register("ar_risk_search_firm", lambda: RQ.risk_search("ar", "#00000", AS_OF, FIRM))(
    lambda s: R.risk_search(SN.ar_risk(s, AS_OF, FIRM), "#00000"))
register("wip_risk_search_firm", lambda: RQ.risk_search("wip", "#00000", AS_OF, FIRM))(
    lambda s: R.risk_search(SN.wip_risk(s, AS_OF, FIRM), "#00000"))
register("ar_risk_total_all_firms", lambda: FQ.risk_total("ar", AS_OF))(
    lambda s: AF.ar_risk_total(s, AS_OF))
register("wip_risk_total_all_firms", lambda: FQ.risk_total("wip", AS_OF))(
    lambda s: AF.wip_risk_total(s, AS_OF))
register("time_gauges_series_all_firms", lambda: FQ.time_gauges_series(SERIES))(
    lambda s: RU.time_gauges_series(s, SERIES, all_firms=True))
register("perf_table_series_all_firms", lambda: FQ.perf_table_series(SERIES))(
    lambda s: R.perf_table(RU.measures_series(s, SERIES, all_firms=True), ["member_firm_id", "as_of"]))
register("service_lines_series", lambda: Q.service_lines_series(SERIES))(
    lambda s: RU.service_lines_series(s, SERIES))
register("utilization_series", lambda: Q.utilization_series(SERIES))(
    lambda s: RU.utilization_series(s, SERIES))
register("ar_aging_series", lambda: Q.ar_aging_series(SERIES))(
    lambda s: RU.ar_aging_series(s, SERIES))
register("ar_risk_series", lambda: Q.ar_risk_series(SERIES))(
    lambda s: RU.ar_risk_series(s, SERIES))
# utilization from bitmaps of people, and series from the written kind of running totals
register("utilization_weekly_people", lambda: Q.utilization(YEAR_EDGE))(
    lambda s: H.utilization(H.weekly_people(s), YEAR_EDGE))
register("utilization_series_weekly_people", lambda: Q.utilization_series(SERIES))(
    lambda s: H.utilization_series(H.weekly_people(s), SERIES))
register("service_lines_series_totals", lambda: Q.service_lines_series(SERIES))(
    lambda s: RU.service_lines_series(s, SERIES, totals=RU.time_totals(s.fct_time_entry)))
register("time_gauges_series_totals", lambda: FQ.time_gauges_series(SERIES))(
    lambda s: RU.time_gauges_series(s, SERIES, all_firms=True, totals=RU.time_totals(s.fct_time_entry)))
# the page as one frame
register("scorecard", lambda: PQ.scorecard(AS_OF))(
    lambda s: R.long_form(R.scorecard(s, AS_OF)))
register("scorecard_firm", lambda: PQ.scorecard(AS_OF, FIRM))(
    lambda s: R.long_form(R.scorecard(s, AS_OF, FIRM)))
register("scorecard_all_firms", lambda: PQ.scorecard_all_firms(AS_OF))(
    lambda s: R.long_form(AF.scorecard(s, AS_OF), AF.BY))
