"""Loader checks and the star mapping's documented sizes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from star_rows import make_star
from ledgerlens.functions.params import days_before
from ledgerlens.sources.schema import duplicate_keys
from ledgerlens.sources.star import REPORT_DATES, from_test_tables


def test_duplicate_dimension_keys_are_reported(spark):
    star = make_star(spark, dim_client=[(1, "A", None), (1, "B", None), (2, "C", "P")])
    assert [r.client_key for r in duplicate_keys(star.dim_client, "client_key").collect()] == [1]
    with pytest.raises(ValueError):
        star.validate()
    make_star(spark, dim_client=[(1, "A", None)]).validate()


def test_report_dates_are_quarter_ends():
    assert REPORT_DATES[0] == dt.date(1999, 3, 31) and REPORT_DATES[-1] == dt.date(2001, 9, 30)
    assert len(REPORT_DATES) == 11
    assert days_before("2000-03-01", 1) == dt.date(2000, 2, 29)


def test_mapping_sizes_and_sums_sf001(spark):
    star = from_test_tables(spark, "/root/testdata/sf0.01")
    t = star.fct_time_entry.agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("h"),
                                F.sum("write_up_down").alias("w")).collect()[0]
    assert t.n == 60000 and str(t.h) == "1524135.00" and str(t.w) == "-159247543.7393"
    cash = star.fct_cash_receipt.agg(F.count(F.lit(1)).alias("n"),
                                     F.sum("receipt_amount").alias("s")).collect()[0]
    assert cash.n == 10021 and str(cash.s) == "1869870428.900"
    star.validate()


@pytest.mark.parametrize("kind", ["ar", "wip"])
def test_snapshot_total_is_all_open_items(spark, kind):
    """Per report date, the snapshot holds every open item up to then, however old."""
    import duckdb

    from oracle.star_sql import with_star

    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    rows = con.execute(with_star([f"{kind}_items"]) + f"""
        SELECT report_date, (SELECT SUM(amount) FROM {kind}_items WHERE item_date <= report_date)
        FROM report_dates ORDER BY 1""").fetchall()
    star = from_test_tables(spark, "/root/testdata/sf0.01")
    snap = star.fct_ar_aging_snapshot if kind == "ar" else star.fct_wip_aging_snapshot
    buckets = [c for c in snap.columns if c.startswith(kind) and not c.endswith("total")]
    got = (snap.groupBy("report_date").agg(F.sum(f"{kind}_total").alias("t"), sum(F.sum(c) for c in buckets).alias("b"))
           .orderBy("report_date").collect())
    assert [(r.report_date, r.t) for r in got] == rows
    assert all(r.t == r.b for r in got)


def test_amounts_are_never_rounded_on_load(spark):
    from decimal import Decimal

    from ledgerlens.sources import schema as S

    fine = spark.sql("SELECT CAST('F' AS STRING) member_firm_id, 1L person_key, DATE '2000-06-10' entry_date, "
                     "CAST(0.125 AS DECIMAL(10,3)) hours, CAST(1 AS DECIMAL(18,2)) production_amount, "
                     "CAST(NULL AS DECIMAL(28,4)) write_up_down, true is_billable, 'A' service_line FROM range(8)")
    out = S.conform(fine, S.FCT_TIME_ENTRY)
    assert out.agg(F.sum("hours")).first()[0] == Decimal("1.000")
    with pytest.raises(TypeError):
        S.conform(fine.withColumn("hours", F.lit(0.125)), S.FCT_TIME_ENTRY)


def test_duplicate_person_counts_once(spark):
    from star_rows import time_row
    from ledgerlens.operators import utilization as U

    star = make_star(spark, fct_time_entry=[time_row(day="2000-06-14")],
                     dim_person=[(1, "Staff", 4), (1, "Staff", 4)])
    assert U.utilization(star, "2000-06-16").first()["headcount"] == 1
    with pytest.raises(ValueError):
        star.materialize("/nowhere")


def test_sink_replaces_exactly_its_own_date_and_firm(spark, tmp_path):
    from ledgerlens.plans.output import write_panels

    rows = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    root = str(tmp_path)
    write_panels({"p": rows}, root, "2000-06-16")
    write_panels({"p": rows}, root, "2000-06-16", "F/1")
    write_panels({"p": rows}, root, "2000-06-23")
    write_panels({"p": rows.limit(0)}, root, dt.date(2000, 6, 16))
    left = {(str(r.as_of), r.firm): r.n for r in spark.read.parquet(root + "/p").groupBy("as_of", "firm").agg(F.count("x").alias("n")).collect()}
    assert left == {("2000-06-16", "F%2F1"): 3, ("2000-06-23", "__all__"): 3} or left == {("2000-06-16", "F/1"): 3, ("2000-06-23", "__all__"): 3}
    with pytest.raises(ValueError):
        write_panels({"p": rows}, root, "16.06.2000")


def test_shared_folder_is_required_off_local_masters():
    from types import SimpleNamespace

    from ledgerlens.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)
