"""Places of rows within their group, without putting a group in one task.

The rows are range-sorted by (keys, order) and written; a group that holds a third of all rows then lies
over many partitions. Inside one partition a place is a row number. Only a group that crosses a border
has rows in earlier partitions; their number comes from counts per group and partition, and the groups
that cross a border are no more than the partitions, so their counts are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import materialize


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``place``: 0, 1, ... in ``order`` among the rows of equal ``keys`` (null is a key like any other)."""
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    rows = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by)
                       .withColumn("__row", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__row", 33))
    pieces = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (pieces.withColumn("__before", F.sum("__n").over(earlier)).where("__before IS NOT NULL")
                .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__kp"), "__before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)],
                  F.col("__part") == F.col("__kp"))
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__row")) - 1
    placed = rows.withColumn("__local", local).join(F.broadcast(crossing), same, "left")
    return (placed.withColumn("place", F.col("__local") + F.coalesce("__before", F.lit(0)))
            .select(*df.columns, "place"))
