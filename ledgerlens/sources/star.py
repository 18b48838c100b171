"""The star schema the scorecard reads, and the ways to obtain it.

``StarSchema`` bundles the seven tables. It can come from

* a catalog namespace (``catalog.schema``), as in production,
* a folder of parquet tables written by :meth:`StarSchema.materialize`, or
* the driver's TPC-H-like test tables, mapped by :func:`from_test_tables`.

All three give lazy DataFrames; nothing is collected.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest as M
from . import schema as S
from .snapshots import aging_snapshot, dates_with_rows, snapshot_of

TABLES = list(S.STAR_SCHEMAS)
PROFILES = "_date_profiles"
REPORTS = "_report_dates"


@dataclass
class StarSchema:
    fct_time_entry: DataFrame
    fct_invoice: DataFrame
    fct_cash_receipt: DataFrame
    fct_ar_aging_snapshot: DataFrame
    fct_wip_aging_snapshot: DataFrame
    dim_person: DataFrame
    dim_client: DataFrame
    # date profiles by table name, as written by ``materialize``
    profiles: dict[str, DataFrame] = field(default_factory=dict)
    # report dates of the snapshots by table name, where metadata lists them (ascending)
    report_dates: dict[str, list[dt.date]] = field(default_factory=dict)
    # lazy frames of the report dates of which a snapshot has rows, by table name, where they cost less than the snapshot
    dated: dict[str, DataFrame] = field(default_factory=dict)
    # by table name, a snapshot and what gives its rows of the newest report date on or before a day at less cost than the
    # whole snapshot; not used once another frame stands in the snapshot's place
    newest: dict[str, tuple[DataFrame, Callable[[dt.date], DataFrame]]] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    def register(self, prefix: str = "") -> None:
        """Register every table as a temp view (for SQL and ``adhoc``)."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def validate(self) -> None:
        S.assert_unique_keys(self.tables())

    # -- constructors ------------------------------------------------------
    @classmethod
    def from_catalog(cls, spark: SparkSession, namespace: str) -> "StarSchema":
        """Tables of a catalog namespace; dimension keys are checked, as duplicates would multiply facts."""
        star = cls(**{t: S.conform(spark.table(f"{namespace}.{t}"), S.STAR_SCHEMAS[t])
                      for t in TABLES})
        star.validate()
        return star

    def save_to_catalog(self, namespace: str, buckets: int = 64) -> "StarSchema":
        """Write the tables into a catalog namespace, bucketed by the keys of their joins.

        Facts and their dimension have the same buckets (time entries and people by person, snapshots and clients by
        client), so the sums per person or client and the joins to the dimension need no exchange. Choose
        ``buckets`` so that a bucket of the largest fact is a few hundred MB per report date or year.
        """
        self.validate()
        for name, df in self.tables().items():
            key = S.BUCKET_KEYS.get(name)
            writer = df.repartition(buckets, key).write if key else df.write
            if key:
                writer = writer.bucketBy(buckets, key).sortBy(key)
            writer.mode("overwrite").saveAsTable(f"{namespace}.{name}")
        return StarSchema.from_catalog(self.fct_time_entry.sparkSession, namespace)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, profiles: bool = False) -> "StarSchema":
        """Tables below ``root``.

        ``profiles``: with what :meth:`materialize` wrote next to them. A profile or list of report dates
        answers for its table only while the table has the files it was made from; else it is left out with a
        warning, and queries scan the facts. Report dates then come from the partition listing.
        """
        star = cls(**{t: _stored(spark, root, t) for t in TABLES})
        for t in S.PARTITION_COLUMNS if profiles else ():
            if _trusted(spark, root, t):
                dates = spark.read.parquet(os.path.join(root, REPORTS, t)).collect()  # one row per report date
                star.report_dates[t] = sorted(r.report_date for r in dates)
        for t in S.DATE_COLUMNS if profiles else ():
            if _trusted(spark, root, t):
                star.profiles[t] = spark.read.parquet(os.path.join(root, PROFILES, t))
        for t in S.PARTITION_COLUMNS:
            if t not in star.report_dates:
                star.report_dates[t] = listed_report_dates(getattr(star, t))
        star.report_dates = {t: dates for t, dates in star.report_dates.items() if dates}
        return star

    def materialize(self, root: str, mode: str = "overwrite") -> "StarSchema":
        """Write the tables as parquet below ``root`` and return them read back.

        Transaction facts are range-clustered and sorted by date and keys, snapshots are
        partitioned by report date and range-clustered inside it (``schema.CLUSTER_COLUMNS``,
        ``PARTITION_COLUMNS``): the keys after the date let a day with very many rows go
        to several tasks. Dimension keys are checked first. Next to each transaction fact lies
        its date profile (rows per day, firm and billable flag), which lets period queries skip
        the history, next to each snapshot the list of its report dates, and next to both the manifest of the files they
        were made from. ``root`` should be a shared folder (see ``session.shared_path``); the
        written tables also cut the lineage of the mapping joins, so a lost executor re-reads
        files instead of recomputing the star build.
        """
        self.validate()
        spark = self.fct_time_entry.sparkSession
        for name, df in self.tables().items():
            cluster = S.CLUSTER_COLUMNS.get(name)
            part = S.PARTITION_COLUMNS.get(name)
            if cluster:
                df = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
            writer = df.write.mode(mode)
            if part:
                writer = writer.partitionBy(part)
            writer.parquet(os.path.join(root, name))
        written = StarSchema(**{t: _stored(spark, root, t) for t in TABLES})
        for name, date_col in S.DATE_COLUMNS.items():
            profile = date_profile(getattr(written, name), date_col)
            profile.hint("rebalance").write.mode(mode).parquet(os.path.join(root, PROFILES, name))
        for name in S.PARTITION_COLUMNS:
            dates = [(d,) for d in listed_report_dates(getattr(written, name))]
            (spark.createDataFrame(dates, "report_date date").coalesce(1)  # a row per partition folder
             .write.mode(mode).parquet(os.path.join(root, REPORTS, name)))
        for name in [*S.DATE_COLUMNS, *S.PARTITION_COLUMNS]:
            M.record(spark, os.path.join(root, name), os.path.join(root, M.MANIFESTS, name), mode)
        return StarSchema.from_path(spark, root, profiles=True)


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    path, schema = os.path.join(root, table), S.STAR_SCHEMAS[table]
    try:
        return S.conform(spark.read.parquet(path), schema)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.read.schema(schema).parquet(path)  # a partitioned table without rows has no file


def _trusted(spark: SparkSession, root: str, table: str) -> bool:
    if M.is_current(spark, os.path.join(root, table), os.path.join(root, M.MANIFESTS, table)):
        return True
    warnings.warn(f"{table} is not what its profile was made from; it is read without", stacklevel=3)
    return False


def listed_report_dates(snapshot: DataFrame) -> list[dt.date]:
    """Report dates of a snapshot that is partitioned by them, from its file listing; no file is opened."""
    found = {m[1] for f in snapshot.inputFiles() if (m := re.search(r"/report_date=(\d{4}-\d\d-\d\d)/", f))}
    return sorted(dt.date.fromisoformat(d) for d in found)


def date_profile(facts: DataFrame, date_col: str) -> DataFrame:
    """Rows per day, firm and (if there is one) billable flag of a transaction fact."""
    keys = [c for c in (date_col, "member_firm_id", "is_billable") if c in facts.columns]
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------------------
# Mapping from the driver's test tables (TPC-H-like) to the star schema.
# ---------------------------------------------------------------------------

# Fixed values of the test mapping.
# Staff levels by supplier key % 6; level NULL when key % 12 == 11.
STAFF_LEVELS = ["Partner", "Director", "Manager", "Senior", "Staff", ""]
# Snapshot report dates: every quarter end from 1999-03-31 to 2001-09-30.
FIRST_REPORT_QUARTER = (1999, 1)
LAST_REPORT_QUARTER = (2001, 3)


def quarter_ends(first: tuple[int, int], last: tuple[int, int]) -> list[dt.date]:
    out = []
    year, q = first
    while (year, q) <= last:
        month = 3 * q
        nxt = dt.date(year + (month == 12), month % 12 + 1, 1)
        out.append(nxt - dt.timedelta(days=1))
        year, q = (year + 1, 1) if q == 4 else (year, q + 1)
    return out


REPORT_DATES = quarter_ends(FIRST_REPORT_QUARTER, LAST_REPORT_QUARTER)

# Age buckets: (column, lowest age, highest age or None for open-ended).
AR_AGE_BUCKETS = [("ar_0_30", 0, 30), ("ar_31_60", 31, 60), ("ar_61_90", 61, 90),
                  ("ar_91_120", 91, 120), ("ar_121_150", 121, 150),
                  ("ar_151_180", 151, 180), ("ar_181_364", 181, 364),
                  ("ar_365_plus", 365, None)]
WIP_AGE_BUCKETS = [("wip_0_30", 0, 30), ("wip_31_60", 31, 60), ("wip_61_90", 61, 90),
                   ("wip_91_120", 91, 120), ("wip_121_150", 121, 150),
                   ("wip_151_180", 151, 180), ("wip_181_210", 181, 210),
                   ("wip_211_240", 211, 240), ("wip_241_270", 241, 270),
                   ("wip_271_300", 271, 300), ("wip_301_330", 301, 330),
                   ("wip_331_364", 331, 364), ("wip_1yr_2yr", 365, 730),
                   ("wip_2yr_plus", 731, None)]


def _firm(nation_key: str = "n_nationkey", nation_name: str = "n_name"):
    """Member firm of a nation: NULL for nation 0, '' for nation 1, else its name."""
    return (F.when(F.col(nation_key) == 0, F.lit(None).cast("string"))
            .when(F.col(nation_key) == 1, F.lit(""))
            .otherwise(F.col(nation_name)))


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The nation table has 25 rows by definition of the TPC-H schema: a
    # broadcast of fixed size.
    return F.broadcast(_read(spark, sf_dir, "nation", "n_nationkey", "n_name"))


def _customers_with_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    return (cust.join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_name", "c_nationkey", "n_name",
                    _firm().alias("member_firm_id")))


def time_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber",
               "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    sup = (_read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
           .join(_nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
           .select("s_suppkey", _firm().alias("member_firm_id")))
    part = _read(spark, sf_dir, "part", "p_partkey", "p_size", "p_type")
    joined = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey")))
    wuwd = (F.col("l_extendedprice").cast("decimal(12,2)")
            * F.col("l_discount").cast("decimal(4,2)") * F.lit(-1))
    billable = (F.when(F.col("l_returnflag") == "R", F.lit(False))
                .when(F.col("l_linenumber") == 7, F.lit(None).cast("boolean"))
                .otherwise(F.lit(True)))
    out = joined.select(
        F.col("member_firm_id"),
        F.col("l_suppkey").alias("person_key"),
        F.col("l_shipdate").cast("date").alias("entry_date"),
        F.col("l_quantity").cast(S.MONEY).alias("hours"),
        F.col("l_extendedprice").cast(S.MONEY).alias("production_amount"),
        F.when(F.col("l_discount") == 0, F.lit(None)).otherwise(wuwd).alias("write_up_down"),
        billable.alias("is_billable"),
        F.when(F.col("p_size") == 1, F.lit(None)).otherwise(F.col("p_type"))
        .alias("service_line"))
    return S.conform(out, S.FCT_TIME_ENTRY)


def _orders_with_firm(spark: SparkSession, sf_dir: str, *order_cols: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders", "o_custkey", *order_cols)
    cust = _customers_with_firm(spark, sf_dir).select("c_custkey", "member_firm_id")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders_with_firm(spark, sf_dir, "o_orderdate", "o_totalprice")
    out = o.select("member_firm_id", F.col("o_custkey").alias("client_key"),
                   F.col("o_orderdate").cast("date").alias("invoice_date"),
                   F.col("o_totalprice").cast(S.MONEY).alias("invoice_amount"))
    return S.conform(out, S.FCT_INVOICE)


def cash_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (_orders_with_firm(spark, sf_dir, "o_orderdate", "o_totalprice", "o_orderstatus")
         .filter(F.col("o_orderstatus").isin("F", "P")))
    share = F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).otherwise(F.lit(0.5))
    out = o.select("member_firm_id", F.col("o_custkey").alias("client_key"),
                   F.date_add(F.col("o_orderdate").cast("date"), 30).alias("receipt_date"),
                   (F.col("o_totalprice").cast("decimal(14,2)") * share.cast("decimal(2,1)"))
                   .alias("receipt_amount"))
    return S.conform(out, S.FCT_CASH_RECEIPT)


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = _read(spark, sf_dir, "supplier", "s_suppkey")
    idx = (F.col("s_suppkey") % 6).cast("int")
    level = F.element_at(F.array(*[F.lit(s) for s in STAFF_LEVELS]), idx + 1)
    out = sup.select(F.col("s_suppkey").alias("person_key"),
                     F.when(F.col("s_suppkey") % 12 == 11, F.lit(None)).otherwise(level)
                     .alias("staff_level"),
                     idx.alias("staff_level_index"))
    return S.conform(out, S.DIM_PERSON)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers_with_firm(spark, sf_dir)
    out = c.select(F.col("c_custkey").alias("client_key"), F.col("c_name").alias("client_name"),
                   F.when(F.col("c_nationkey") == 0, F.lit(None)).otherwise(F.col("n_name"))
                   .alias("partner_name"))
    return S.conform(out, S.DIM_CLIENT)


def _signed(amount_col: str):
    amt = F.col(amount_col).cast(S.MONEY)
    return F.when(F.col("client_key") % 10 == 0, -amt).otherwise(amt)


def _firms_of_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers_with_firm(spark, sf_dir).select(F.col("c_custkey").alias("client_key"), "member_firm_id")


def _open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (_read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
              .filter(F.col("o_orderstatus") != "F")
              .select(F.col("o_custkey").alias("client_key"), F.col("o_orderdate").cast("date").alias("item_date"), "o_totalprice"))
    return orders.withColumn("amount", _signed("o_totalprice"))


def ar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open_orders(spark, sf_dir).join(_firms_of_clients(spark, sf_dir), "client_key")


def ar_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = aging_snapshot(ar_items(spark, sf_dir), REPORT_DATES, AR_AGE_BUCKETS, "ar_total")
    return S.conform(snap, S.FCT_AR_AGING_SNAPSHOT)


def _open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (_read(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_shipdate",
                "l_linestatus")
          .filter(F.col("l_linestatus") == "O"))
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    open_items = (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                  .select(F.col("o_custkey").alias("client_key"),
                          F.col("l_shipdate").cast("date").alias("item_date"),
                          F.col("l_extendedprice")))
    return open_items.withColumn("amount", _signed("l_extendedprice"))


def wip_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open_lines(spark, sf_dir).join(_firms_of_clients(spark, sf_dir), "client_key")


def wip_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = aging_snapshot(wip_items(spark, sf_dir), REPORT_DATES, WIP_AGE_BUCKETS, "wip_total")
    return S.conform(snap, S.FCT_WIP_AGING_SNAPSHOT)


def _newest_snapshot(whole: DataFrame, open_items: DataFrame, clients: DataFrame, buckets: list, total_col: str, schema) -> tuple:
    """An entry of ``StarSchema.newest`` for a snapshot over ``REPORT_DATES``.

    An item is placed in every report date on or after its day, so where the newest report date has no row,
    no earlier one has any.
    """
    def newest(as_of: dt.date) -> DataFrame:
        day = max((d for d in REPORT_DATES if d <= as_of), default=None)
        if day is None:
            return whole.filter(F.lit(False))
        return S.conform(snapshot_of(day, open_items, clients, buckets, total_col), schema)

    return whole, newest


def with_null_bucket(star: StarSchema) -> StarSchema:
    """Edge input: the 121-150 bucket is unknown (NULL) for client keys % 25 == 1."""
    unknown = F.col("client_key") % 25 == 1

    def plant(snap: DataFrame, bucket: str) -> DataFrame:
        return snap.withColumn(bucket, F.when(unknown, F.lit(None)).otherwise(F.col(bucket)))

    return replace(star, fct_ar_aging_snapshot=plant(star.fct_ar_aging_snapshot, "ar_121_150"),
                   fct_wip_aging_snapshot=plant(star.fct_wip_aging_snapshot, "wip_121_150"))


def without_firm(star: StarSchema, firm: str, since: dt.date) -> StarSchema:
    """Edge input: a firm that stopped reporting, absent from snapshots since a date."""
    gone = (F.coalesce(F.col("member_firm_id") == firm, F.lit(False))
            & (F.col("report_date") >= F.lit(since)))
    return replace(star, report_dates={}, dated={}, fct_ar_aging_snapshot=star.fct_ar_aging_snapshot.filter(~gone),
                   fct_wip_aging_snapshot=star.fct_wip_aging_snapshot.filter(~gone))


def from_test_tables(spark: SparkSession, sf_dir: str) -> StarSchema:
    """Star schema over the driver's test tables (lazy)."""
    firms = _firms_of_clients(spark, sf_dir)
    ar, wip = ar_snapshot(spark, sf_dir), wip_snapshot(spark, sf_dir)
    return StarSchema(
        fct_time_entry=time_entries(spark, sf_dir),
        fct_invoice=invoices(spark, sf_dir),
        fct_cash_receipt=cash_receipts(spark, sf_dir),
        fct_ar_aging_snapshot=ar,
        fct_wip_aging_snapshot=wip,
        dim_person=persons(spark, sf_dir),
        dim_client=clients(spark, sf_dir),
        dated={"fct_ar_aging_snapshot": dates_with_rows(ar_items(spark, sf_dir), REPORT_DATES),
               "fct_wip_aging_snapshot": dates_with_rows(wip_items(spark, sf_dir), REPORT_DATES)},
        newest={"fct_ar_aging_snapshot": _newest_snapshot(ar, _open_orders(spark, sf_dir), firms, AR_AGE_BUCKETS, "ar_total",
                                                          S.FCT_AR_AGING_SNAPSHOT),
                "fct_wip_aging_snapshot": _newest_snapshot(wip, _open_lines(spark, sf_dir), firms, WIP_AGE_BUCKETS, "wip_total",
                                                           S.FCT_WIP_AGING_SNAPSHOT)},
    )
