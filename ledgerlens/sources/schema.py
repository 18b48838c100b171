"""Declared schemas of the star tables and the checks a loader runs on them.

The scorecard reads five fact tables and two dimensions. Nothing in the source
system declares them, so the column sets below are fixed from how the queries use
them; loaders select exactly these columns, in this order, with these types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Bucket columns of the two aging snapshots, youngest first (fixed names).
AR_BUCKETS = ["ar_0_30", "ar_31_60", "ar_61_90", "ar_91_120", "ar_121_150",
              "ar_151_180", "ar_181_364", "ar_365_plus"]
WIP_BUCKETS = ["wip_0_30", "wip_31_60", "wip_61_90", "wip_91_120", "wip_121_150",
               "wip_151_180", "wip_181_210", "wip_211_240", "wip_241_270", "wip_271_300",
               "wip_301_330", "wip_331_364", "wip_1yr_2yr", "wip_2yr_plus"]


def _fields(*spec):
    return T.StructType([T.StructField(n, t, True) for n, t in spec])


FCT_TIME_ENTRY = _fields(
    ("member_firm_id", T.StringType()), ("person_key", T.LongType()),
    ("entry_date", T.DateType()), ("hours", MONEY), ("production_amount", MONEY),
    ("write_up_down", T.DecimalType(28, 4)), ("is_billable", T.BooleanType()),
    ("service_line", T.StringType()))

FCT_INVOICE = _fields(
    ("member_firm_id", T.StringType()), ("client_key", T.LongType()),
    ("invoice_date", T.DateType()), ("invoice_amount", MONEY))

FCT_CASH_RECEIPT = _fields(
    ("member_firm_id", T.StringType()), ("client_key", T.LongType()),
    ("receipt_date", T.DateType()), ("receipt_amount", T.DecimalType(17, 3)))

FCT_AR_AGING_SNAPSHOT = _fields(
    ("report_date", T.DateType()), ("client_key", T.LongType()),
    ("member_firm_id", T.StringType()),
    *[(c, T.DecimalType(28, 2)) for c in AR_BUCKETS + ["ar_total"]])

FCT_WIP_AGING_SNAPSHOT = _fields(
    ("report_date", T.DateType()), ("client_key", T.LongType()),
    ("member_firm_id", T.StringType()),
    *[(c, T.DecimalType(28, 2)) for c in WIP_BUCKETS + ["wip_total"]])

DIM_PERSON = _fields(
    ("person_key", T.LongType()), ("staff_level", T.StringType()),
    ("staff_level_index", T.IntegerType()))

DIM_CLIENT = _fields(
    ("client_key", T.LongType()), ("client_name", T.StringType()),
    ("partner_name", T.StringType()))

STAR_SCHEMAS = {
    "fct_time_entry": FCT_TIME_ENTRY,
    "fct_invoice": FCT_INVOICE,
    "fct_cash_receipt": FCT_CASH_RECEIPT,
    "fct_ar_aging_snapshot": FCT_AR_AGING_SNAPSHOT,
    "fct_wip_aging_snapshot": FCT_WIP_AGING_SNAPSHOT,
    "dim_person": DIM_PERSON,
    "dim_client": DIM_CLIENT,
}

DIMENSION_KEYS = {"dim_person": "person_key", "dim_client": "client_key"}

# Layout of each table when it is materialised.
# Transaction facts are range-clustered by their date and then by keys (so a day that holds a
# large share of the rows is split over tasks): every file holds a narrow,
# sorted date range, so the pushed period filter skips files and row groups by
# their min/max statistics, without one directory per day (thousands of small
# partitions at small scale, and a listing bottleneck at large scale).
CLUSTER_COLUMNS = {
    "fct_time_entry": ["entry_date", "member_firm_id", "person_key"],
    "fct_invoice": ["invoice_date", "member_firm_id", "client_key"],
    "fct_cash_receipt": ["receipt_date", "member_firm_id", "client_key"],
    "fct_ar_aging_snapshot": ["report_date", "client_key"],
    "fct_wip_aging_snapshot": ["report_date", "client_key"],
}
DATE_COLUMNS = {"fct_time_entry": "entry_date", "fct_invoice": "invoice_date",
                "fct_cash_receipt": "receipt_date"}
# Snapshots have few report dates and are read one date at a time: one
# directory per report date, pruned by the latest-snapshot filter.
PARTITION_COLUMNS = {
    "fct_ar_aging_snapshot": "report_date",
    "fct_wip_aging_snapshot": "report_date",
}
# Join keys that facts and dimensions are bucketed by in a catalog.
BUCKET_KEYS = {"fct_time_entry": "person_key", "dim_person": "person_key", "fct_ar_aging_snapshot": "client_key",
               "fct_wip_aging_snapshot": "client_key", "dim_client": "client_key"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns in order, with the declared types.

    Amounts are never rounded: a decimal source with a finer scale keeps its scale (and enough
    digits for the declared integer part), and a floating-point source is refused, since
    it has no exact scale; cast it to the decimal that it stands for first.
    """
    cols = []
    for f in schema.fields:
        kind, have = f.dataType, df.schema[f.name].dataType
        if isinstance(kind, T.DecimalType):
            if isinstance(have, (T.DoubleType, T.FloatType)):
                raise TypeError(f"{f.name}: floating-point amounts have no exact scale; cast to DECIMAL first")
            if isinstance(have, T.DecimalType) and have.scale > kind.scale:
                whole = max(kind.precision - kind.scale, have.precision - have.scale)
                if whole + have.scale > 38:
                    raise TypeError(f"{f.name}: {have.simpleString()} does not fit DECIMAL(38) without rounding")
                kind = T.DecimalType(whole + have.scale, have.scale)
        cols.append(F.col(f.name).cast(kind).alias(f.name))
    return df.select(cols)


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; empty for a valid dimension.

    A duplicate dimension key would multiply fact rows in the inner joins of the
    utilization and risk queries, so loaders are expected to check this once.
    The check is a distributed aggregate; only offending keys come back.
    """
    return dim.groupBy(key).count().filter(F.col("count") > 1)


def assert_unique_keys(dims: dict[str, DataFrame]) -> None:
    for name, key in DIMENSION_KEYS.items():
        if name in dims and not duplicate_keys(dims[name], key).isEmpty():
            raise ValueError(f"{name}.{key} is not unique")
