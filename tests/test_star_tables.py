"""Star tables as a user has them: catalog tables, written tables that change, weekly people, ad-hoc SQL."""

from __future__ import annotations

import datetime as dt
import uuid
import warnings
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerlens.operators import gauges as G
from ledgerlens.operators import snapshots as SN
from ledgerlens.operators import utilization as U
from ledgerlens.plans import all_firms as AF
from ledgerlens.plans import headcount as H
from ledgerlens.plans import rollup as RU
from ledgerlens.plans.adhoc import adhoc, preview
from ledgerlens.session import shared_path
from ledgerlens.sources.star import StarSchema, from_test_tables
from star_rows import make_star, snap_row, time_row

SF = "/root/testdata/sf0.001"
AS_OF = "2000-06-16"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def root(spark):
    at = shared_path(spark, f"test-star-{uuid.uuid4().hex[:8]}")
    from_test_tables(spark, SF).materialize(at)
    return at


# -- what is derived from a table is trusted only while the table is the same ---------------------------


def test_profile_of_a_table_that_grew_is_not_used(spark):
    at = shared_path(spark, f"test-star-{uuid.uuid4().hex[:8]}")
    star = make_star(spark, fct_time_entry=[time_row(firm="A", hours=None)], fct_ar_aging_snapshot=[snap_row("ar", "2000-03-31")]).materialize(at)
    assert G.time_gauges(star, AS_OF).first()["cy_mtd_hours"] is None
    assert set(star.profiles) == {"fct_time_entry", "fct_invoice", "fct_cash_receipt"}
    # one entry long before the span turns NULL into 0 and lists a firm; a newer snapshot appears
    make_star(spark, fct_time_entry=[time_row(firm="B", day="1990-01-02")]).fct_time_entry.write.mode("append").parquet(f"{at}/fct_time_entry")
    (make_star(spark, fct_ar_aging_snapshot=[snap_row("ar", "2000-06-09", ar_total=Decimal("7.00"))]).fct_ar_aging_snapshot
     .write.mode("append").partitionBy("report_date").parquet(f"{at}/fct_ar_aging_snapshot"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        star = StarSchema.from_path(spark, at, profiles=True)
    assert {str(w.message).split()[0] for w in said if "profile" in str(w.message)} == {"fct_time_entry", "fct_ar_aging_snapshot"}
    assert set(star.profiles) == {"fct_invoice", "fct_cash_receipt"}
    assert G.time_gauges(star, AS_OF).first()["cy_mtd_hours"] == Decimal("0.00")
    assert [r[0] for r in rows(AF.listed_firms(star))] == ["A", "B"] and [r[0] for r in rows(G.firms(star))] == ["A", "B"]
    assert SN.ar_aging(star, AS_OF).first()["total"] == Decimal("7.00")


def test_profile_of_an_unchanged_table_is_used(spark, root):
    star = StarSchema.from_path(spark, root, profiles=True)
    assert set(star.profiles) == {"fct_time_entry", "fct_invoice", "fct_cash_receipt"}
    assert [str(d) for d in star.report_dates["fct_wip_aging_snapshot"]][:2] == ["1999-03-31", "1999-06-30"]
    plain = StarSchema.from_path(spark, root)
    assert not plain.profiles and plain.report_dates == star.report_dates
    assert "_date_profiles" in G.firms(star).inputFiles()[0] and rows(G.firms(star)) == rows(G.firms(plain))


def test_no_snapshot_before_the_date(spark, root):
    star = StarSchema.from_path(spark, root)
    assert SN.ar_aging(star, "1999-01-01").first()["total"] is None
    assert SN.ar_risk(star, "1999-01-01").count() == 0
    assert [r.total for r in RU.ar_aging_series(star, ["1999-01-01"]).collect()] == [None]


# -- catalog tables ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def catalog(spark):
    name = f"star_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, name)}'")
    star = from_test_tables(spark, SF).save_to_catalog(name, buckets=4)
    yield name, star
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_catalog_tables_give_the_same_rows(spark, catalog):
    star, mapped = StarSchema.from_catalog(spark, catalog[0]), from_test_tables(spark, SF)
    for run in (lambda s: U.utilization(s, AS_OF), lambda s: SN.ar_risk(s, AS_OF), lambda s: SN.wip_aging(s, AS_OF),
                lambda s: G.service_lines(s, AS_OF), lambda s: AF.ar_risk(s, AS_OF)):
        assert rows(run(star)) == rows(run(mapped))


def test_joins_of_catalog_tables_need_no_exchange(spark, catalog):
    from test_plans import plan

    star = catalog[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (U.utilization(star, AS_OF), SN.ar_risk(star, AS_OF)):
            p = plan(df)
            tree = p[:p.index("(1) ")]
            lines = tree.splitlines()
            at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
            assert not [line for line in lines[at:] if "Exchange" in line and "Subquery" not in line], tree
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_catalog_with_a_repeated_key_is_refused(spark):
    name = f"star_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, name)}'")
    for table, df in make_star(spark, dim_client=[(1, "A", None), (1, "B", None)]).tables().items():
        df.write.saveAsTable(f"{name}.{table}")
    with pytest.raises(ValueError):
        StarSchema.from_catalog(spark, name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


# -- weekly people and running totals ---------------------------------------------------------------------


def test_headcounts_from_bitmaps_are_exact(spark, root):
    star = StarSchema.from_path(spark, root)
    at = shared_path(spark, f"people-{uuid.uuid4().hex[:8]}")
    H.weekly_people(star).write.parquet(at)
    people = spark.read.parquet(at)
    columns = U.utilization(star, AS_OF).columns
    for day, firm, rule in ((AS_OF, None, "iso_week_in_year"), ("1997-12-30", None, "iso_week_in_year"), ("1999-01-01", None, "iso_week_in_year"),
                            ("2000-12-31", "NATION_3", "iso_week_in_year"), ("1998-01-01", None, "monday_week"), ("1990-06-15", None, "monday_week")):
        want = U.utilization(star, day, firm, week_rule=rule)
        assert rows(H.utilization(people, day, firm, week_rule=rule).select(*columns)) == rows(want), (day, firm, rule)
    by = ["member_firm_id"]
    assert rows(H.utilization(people, AS_OF, by=by)) == rows(U.utilization(star, AS_OF, by=by))
    dates = ["1997-12-30", "1999-01-01", AS_OF, "2000-06-17", "2000-12-31"]
    series = RU.utilization_series(star, dates)
    assert rows(H.utilization_series(people, dates).select(*series.columns)) == rows(series)


def test_a_person_of_two_firms_counts_once(spark):
    star = make_star(spark, dim_person=[(1, "Staff", 4), (70000, "Staff", 4), (-5, "Staff", 4)], fct_time_entry=[
        time_row("A", 1, "2000-06-14"), time_row("B", 1, "2000-06-15"), time_row("B", 70000, "2000-06-18"),
        time_row("B", -5, "2000-06-12"), time_row("B", 9, "2000-06-12"), time_row("B", None, "2000-06-12")])
    people = H.weekly_people(star)
    assert [(r.headcount, r.total_hours) for r in H.utilization(people, AS_OF).collect()] == [(3, Decimal("4.00"))]
    assert rows(H.utilization(people, AS_OF, by=["member_firm_id"])) == rows(U.utilization(star, AS_OF, by=["member_firm_id"]))


def test_series_from_written_totals(spark, root):
    star = StarSchema.from_path(spark, root)
    at = shared_path(spark, f"totals-{uuid.uuid4().hex[:8]}")
    RU.time_totals(star.fct_time_entry).write.parquet(at)
    totals, dates = spark.read.parquet(at), ["1990-06-15", "1999-01-01", AS_OF, "2001-03-01"]
    for kw in ({}, {"firm": "NATION_3"}, {"firm": "NO_SUCH_FIRM"}, {"all_firms": True}):
        assert rows(RU.time_gauges_series(star, dates, totals=totals, **kw)) == rows(RU.time_gauges_series(star, dates, **kw)), kw
    assert rows(RU.service_lines_series(star, dates, totals=totals)) == rows(RU.service_lines_series(star, dates))


def test_series_rules_of_null_and_zero(spark):
    star = make_star(spark, fct_time_entry=[
        time_row("A", hours=None), time_row("B", hours="5.00"),
        time_row("C", hours=None), time_row("C", day="1990-01-01", hours=None), time_row("D", day="2030-01-01")])
    by = ["member_firm_id"]
    for day in (dt.date(2000, 6, 16), dt.date(1001, 1, 1), dt.date(9998, 12, 31)):
        want = rows(G.time_gauges(star, day, by=by, prune=False))
        assert rows(RU.time_gauges_series(star, [day], all_firms=True).drop("as_of")) == want


# -- facts that the inner joins drop ------------------------------------------------------------------------


def test_facts_without_a_person_come_with_the_panel(spark):
    star = make_star(spark, dim_person=[(1, "Staff", 4), (2, "", 5)], fct_time_entry=[
        time_row(person=1, day="2000-06-14"), time_row(person=2, day="2000-06-14"), time_row(person=8, day="2000-06-14", hours="2.50"),
        time_row(person=8, day="2000-06-15"), time_row(person=None, day="2000-06-15"), time_row(person=8, day="2000-05-01")])
    seen = Observation()
    panel = U.utilization(star, AS_OF, dropped=seen)
    assert rows(panel) == rows(U.utilization(star, AS_OF))
    assert (seen.get["facts"], seen.get["hours"], seen.get["tvp"]) == (3, Decimal("4.50"), Decimal("300.00"))


def test_snapshot_rows_without_a_client_come_with_the_list(spark):
    star = make_star(spark, dim_client=[(1, "A", None)], fct_ar_aging_snapshot=[
        snap_row("ar", client=1, ar_61_90=Decimal("5.00")), snap_row("ar", client=2, ar_61_90=Decimal("3.00")),
        snap_row("ar", client=None, ar_365_plus=Decimal("1.00")), snap_row("ar", client=2, firm="F2", ar_0_30=Decimal("9.00"))])
    seen = Observation()
    assert rows(SN.ar_risk(star, AS_OF, dropped=seen)) == rows(SN.ar_risk(star, AS_OF)) == [("A", None, Decimal("5.00"))]
    assert (seen.get["facts"], seen.get["amount"]) == (3, Decimal("4.00"))


# -- ad-hoc SQL ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    return make_star(spark, fct_time_entry=[time_row(firm=f"F{i}") for i in range(5)], dim_client=[(1, "A", None)])


@pytest.mark.parametrize("sql", [
    "DROP TABLE keep_me", "INSERT INTO keep_me VALUES (9)", "CREATE TABLE t (x INT)", "CREATE OR REPLACE TEMP VIEW fct_invoice AS SELECT 1", "SET x = 1",
    "SELECT 1; DROP TABLE keep_me", "SELECT 1) x; DROP TABLE keep_me --", "TRUNCATE TABLE keep_me", "CACHE TABLE dim_client", ""])
def test_commands_raise_before_anything_runs(spark, small, sql):
    at = shared_path(spark, f"keep-{uuid.uuid4().hex[:8]}")
    spark.sql(f"CREATE TABLE keep_me (x INT) USING parquet LOCATION '{at}'")
    try:
        spark.sql("INSERT INTO keep_me VALUES (1)")
        with pytest.raises((ParseException, ValueError)):
            adhoc(spark, sql, star=small)
        assert spark.table("keep_me").count() == 1
    finally:
        spark.sql("DROP TABLE keep_me")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM mine", "SELECT (SELECT max(x) FROM mine) FROM dim_client", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT * FROM dim_client WHERE client_key IN (SELECT x FROM mine)", "WITH a AS (SELECT * FROM mine) SELECT * FROM a", "SELECT 1) x, mine, (SELECT 2"])
def test_other_tables_are_refused(spark, small, sql):
    spark.range(3).selectExpr("id AS x").createOrReplaceTempView("mine")
    try:
        with pytest.raises((ParseException, ValueError)):
            adhoc(spark, sql, star=small)
    finally:
        spark.catalog.dropTempView("mine")


def test_preview_says_whether_rows_were_cut(spark, small):
    spark.range(1).createOrReplaceTempView("dim_client")  # a caller's view of the same name is neither read nor lost
    before = {t.name for t in spark.catalog.listTables()}
    sql = "WITH f AS (SELECT member_firm_id AS firm FROM fct_time_entry) SELECT firm FROM f WHERE firm <> :no ORDER BY firm DESC; -- last first\n"
    sql = sql.replace("; -- last first\n", " -- last first")
    got = preview(spark, sql, {"no": "F4"}, star=small, limit=3)
    assert (got.columns, [r.firm for r in got.rows], got.cut) == (["firm"], ["F3", "F2", "F1"], True)
    assert not preview(spark, sql, {"no": "F4"}, star=small, limit=4).cut
    assert preview(spark, "SELECT client_name FROM dim_client;", star=small).rows[0].client_name == "A"
    assert {t.name for t in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("dim_client")
    with pytest.raises(AnalysisException):
        spark.table("dim_client").collect()
