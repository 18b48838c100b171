"""Plan shape: filters reach the scan, top-k stays bounded, no pair-producing joins."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import re
import uuid
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from ledgerlens.functions.periods import PERIODS, PeriodWindows
from ledgerlens.operators import gauges as G
from ledgerlens.operators import snapshots as SN
from ledgerlens.operators import utilization as U
from ledgerlens.plans import all_firms as AF
from ledgerlens.plans import registry
from ledgerlens.plans import report as R
from ledgerlens.plans import rollup as RU
from ledgerlens.session import shared_path
from ledgerlens.sources.star import from_test_tables

SF = "/root/testdata/sf0.001"
AS_OF = "2000-06-16"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def count_nodes(p: str, node: str) -> int:
    """Nodes of a kind in the detail section of a formatted plan."""
    return len(re.findall(rf"^\(\d+\) {node}", p, flags=re.M))


@pytest.fixture(scope="module")
def star(spark):
    root = shared_path(spark, f"test-star-{uuid.uuid4().hex[:8]}")
    return from_test_tables(spark, SF).materialize(root)


def test_period_span_and_billable_flag_pushed_and_columns_pruned(star):
    p = plan(G.time_gauges(star, AS_OF, "NATION_3"))
    assert "GreaterThanOrEqual(entry_date,1999-01-01)" in p
    assert "LessThanOrEqual(entry_date,2000-06-16)" in p
    assert "EqualTo(is_billable,true)" in p
    assert "EqualTo(member_firm_id,NATION_3)" in p
    scan = [line for line in p.splitlines() if line.startswith("ReadSchema")][0]
    assert "person_key" not in scan and "service_line" not in scan
    # What lies outside the span comes from the date profile, in the same aggregate.
    assert "Subquery:" not in p
    assert "LessThan(entry_date,1999-01-01)" in p


def test_unpruned_gauges_is_one_scan_one_aggregate(star):
    p = plan(G.time_gauges(star, AS_OF, prune=False))
    assert count_nodes(p, "Scan parquet") == 1
    assert "Exchange" in p and "SinglePartition" in p


def test_utilization_week_bounds_pushed(star):
    p = plan(U.utilization(star, AS_OF))
    assert "GreaterThanOrEqual(entry_date,2000-06-12)" in p
    assert "LessThanOrEqual(entry_date,2000-06-18)" in p
    # Hours are summed per person below the join to the person dimension.
    assert re.search(r"Keys \[1\]: \[person_key#\d+L\]", p)


def test_year_edge_week_is_pushed_as_two_ranges(star):
    p = plan(U.utilization(star, "1997-12-30"))
    assert "LessThanOrEqual(entry_date,1997-01-05)" in p
    assert "GreaterThanOrEqual(entry_date,1997-12-29)" in p


def test_latest_snapshot_opens_the_chosen_date_only(star):
    """The date comes from the list of report dates: a literal partition filter, no subquery."""
    for df in (SN.ar_aging(star, AS_OF), SN.wip_risk(star, AS_OF)):
        p = plan(df)
        assert "Subquery" not in p
        assert re.search(r"PartitionFilters: \[.*\(report_date#\d+ = 2000-03-31\)", p)
    p = plan(RU.ar_aging_series(star, ["2000-06-16", "2000-06-23", "2001-01-05"]))
    assert re.search(r"PartitionFilters: \[.*report_date#\d+ IN \(2000-03-31,2000-12-31\)", p)


def test_without_a_list_the_newest_date_is_a_subquery_that_prunes(star):
    from dataclasses import replace

    p = plan(SN.ar_aging(replace(star, report_dates={}), AS_OF))
    assert re.search(r"PartitionFilters: \[.*\(report_date#\d+ = Subquery", p)
    assert re.search(r"PartitionFilters: \[.*\(report_date#\d+ <= 2000-06-16\)", p)


def test_page_of_all_firms_scans_the_time_facts_once(star):
    p = plan(AF.time_grains(star, AS_OF))
    assert count_nodes(p, "Scan parquet") == 1 and count_nodes(p, "Expand") == 1
    panels = AF.scorecard(star, AS_OF)
    assert len(panels) == 11
    for name, df in panels.items():
        assert "fct_time_entry" not in plan(df), name
        if "ar_distribution" not in name:
            assert "fct_" not in plan(df), name


def test_risk_is_bounded_top_k(star):
    assert "TakeOrderedAndProject" in plan(SN.ar_risk(star, AS_OF))
    p = plan(AF.ar_risk(star, AS_OF))
    assert "WindowGroupLimit" in p


def test_perf_table_merges_per_table_aggregates_without_join(star):
    p = plan(R.perf_table(R.scorecard_measures(star, AS_OF, prune=False)))
    assert count_nodes(p, "Scan parquet") == 3
    assert "Union" in p
    assert "Join" not in p


def test_pruning_reads_a_profile_and_no_history(spark, tmp_path):
    """What lies outside the span is answered by the date profile: on a table of many files the
    pruned query lists no scan of the fact table besides the one of the span."""
    many = from_test_tables(spark, SF)
    root = shared_path(spark, f"test-star-{uuid.uuid4().hex[:8]}")
    many.fct_time_entry = many.fct_time_entry.repartition(40)
    star = many.materialize(root)
    p = plan(G.time_gauges(star, AS_OF))
    places = re.findall(r"Location: .*\[(.*)\]", p)
    assert len(places) == 2 and sum("_date_profiles/fct_time_entry" in x for x in places) == 1
    assert star.profiles["fct_time_entry"].rdd.getNumPartitions() == 1
    # without a profile there is no hidden probe: one scan
    star.profiles = {}
    assert count_nodes(plan(G.time_gauges(star, AS_OF)), "Scan parquet") == 1


def test_all_firms_gauges_scan_the_time_facts_once(spark):
    root = shared_path(spark, f"test-star-{uuid.uuid4().hex[:8]}")
    star = from_test_tables(spark, SF).materialize(root)
    star.profiles = {}
    assert plan(AF.time_gauges(star, AS_OF)).count("fct_time_entry]") == 1
    assert plan(AF.measures(star, AS_OF)).count("fct_time_entry]") == 1


def test_series_sum_days_before_the_running_totals(star):
    p = plan(RU.time_gauges_series(star, ["2000-06-16", "2000-06-23"]))
    tree = p[:p.index("(1) ")]
    assert tree.index("Generate") < tree.index("Window") < tree.rindex("HashAggregate")  # deeper nodes come later


def test_series_make_a_row_per_group_and_bound(star):
    """Rows that the generator of the lookups makes: groups x distinct bounds, whatever the days of the facts."""
    from ledgerlens.plans import running

    weeks = [dt.date(2000, 1, 7) + dt.timedelta(weeks=i) for i in range(52)]
    totals = running.running_totals(star.fct_invoice, "invoice_date", G.INVOICE_MEASURES, ["member_firm_id"])
    groups = star.fct_invoice.select("member_firm_id").distinct().count()
    bounds = {d for a in weeks for p in PERIODS for lo, hi in [PeriodWindows(a).range(p)] for d in (lo - dt.timedelta(days=1), hi)}
    out = running.period_sums(totals, weeks, G.INVOICE_MEASURES, ["member_firm_id"])
    made = [int(n) for n in generated(out)]
    assert len(made) == 2 and max(made) <= groups * (len(bounds) + 1) and min(made) <= groups * len(weeks)


def generated(df) -> list[int]:
    """Output rows of the generators of a plan that has run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "Generate":
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_day_with_half_of_the_rows_is_written_by_several_tasks(spark):
    from ledgerlens.sources import schema as S

    day = F.when(F.col("id") % 2 == 0, F.lit("2000-01-31")).otherwise(F.lit("2000-02-01")).cast("date")
    facts = spark.range(20000).select(
        F.lit("F1").alias("member_firm_id"), F.col("id").alias("person_key"), day.alias("entry_date"))
    spread = facts.repartitionByRange(8, *S.CLUSTER_COLUMNS["fct_time_entry"])
    tasks = (spread.filter("entry_date = '2000-01-31'").select(F.spark_partition_id().alias("p")).distinct().count())
    assert tasks >= 3


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_pair_producing_join_or_python_udf(spark, name):
    p = plan(registry.QUERIES[name][0](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython"):
        assert bad not in p, (name, bad)


def test_page_repeats_sums_and_not_facts(spark):
    """The grouping sets of the all-firms page stand above an aggregate of the facts."""
    df = AF.time_grains(from_test_tables(spark, "/root/testdata/sf0.001"), "2000-06-16")
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Expand") == 1 and "Aggregate" in p[p.index("Expand"):]


def test_dates_of_a_snapshot_need_no_snapshot(spark):
    star = from_test_tables(spark, "/root/testdata/sf0.001")
    for table in ("fct_ar_aging_snapshot", "fct_wip_aging_snapshot"):
        assert {r[0] for r in star.dated[table].collect()} == {r[0] for r in getattr(star, table).select("report_date").distinct().collect()}


def test_newest_snapshot_is_built_alone(spark):
    """No item is placed in other report dates, and a fact adds three sums to the page's aggregate, not one per measure."""
    star = from_test_tables(spark, "/root/testdata/sf0.001")
    for risk in (SN.ar_risk, SN.wip_risk):
        assert "explode" not in risk(star, AS_OF, by=AF.BY)._jdf.queryExecution().optimizedPlan().toString()
    p = AF.time_grains(star, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert p[p.index("Expand"):].count(" sum(") <= 3


def test_newest_snapshot_has_the_rows_of_the_whole(spark, tmp_path):
    """Repeated and unknown clients, null keys, days and amounts; none before the first report date; a replaced frame is read."""
    day = lambda s: None if s is None else dt.datetime.fromisoformat(s)
    tables = {
        "nation": ("n_nationkey long, n_name string", [(0, "A"), (1, "B"), (2, "C"), (3, "D")]),
        "customer": ("c_custkey long, c_name string, c_nationkey long",
                     [(10, "x", 2), (10, "y", 2), (10, "z", 3), (11, "u", 0), (12, "v", 1), (None, "w", 2), (14, "n", None)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(1, 2)]),
        "part": ("p_partkey long, p_size int, p_type string", [(1, 2, "t")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderstatus string",
                   [(k, c, day(d), p, s) for k, c, d, p, s in
                    [(1, 10, "2000-01-05", 5.25, "O"), (2, 10, "1998-01-05", None, "P"), (3, 11, "2000-06-30", 7.5, "O"), (4, 12, None, 3.0, "O"),
                     (5, None, "2000-01-01", 2.0, "O"), (6, 99, "2000-01-01", 2.0, "O"), (7, 14, "2000-01-01", 2.0, "O"), (7, 11, "1999-12-01", 2.0, None),
                     (8, 12, "2000-03-30", 4.0, "F"), (8, 12, "2000-03-31", 4.0, "O"), (9, 11, "2000-01-07", None, "O")]]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(k, 1, 1, 1, 1.0, p, 0.1, "N", s, day(d)) for k in (1, 2, 3, 7, 8, 9, 77, None) for p, s, d in
                      [(1.5, "O", "2000-01-05"), (1.5, "O", "2000-01-05"), (None, "O", "1999-10-05"), (2.0, "F", "1999-01-01"), (9.0, "O", "1997-01-01"),
                       (4.0, "O", None), (8.0, None, "2000-01-01"), (3.0, "O", "2000-04-01")]]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    star = from_test_tables(spark, str(tmp_path))
    for table in ("fct_ar_aging_snapshot", "fct_wip_aging_snapshot"):
        whole = getattr(star, table)
        for as_of in (dt.date(1999, 3, 30), dt.date(1999, 3, 31), dt.date(2000, 3, 31), dt.date(2000, 6, 16), dt.date(2005, 1, 1)):
            last = whole.filter(F.col("report_date") <= F.lit(as_of)).agg(F.max("report_date")).first()[0]
            expected = whole.filter(F.col("report_date") == F.lit(last)) if last else whole.limit(0)
            got = SN.latest_snapshot(star, table, as_of)
            assert got.schema == whole.schema
            assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())), (table, as_of)
            assert last is None or got.count() > 0
        other = replace(star, dated={}, **{table: whole.filter("report_date < '2000-01-01'")})
        assert {str(r[0]) for r in SN.latest_snapshot(other, table, dt.date(2000, 6, 16)).select("report_date").collect()} == {"1999-12-31"}
