"""Helpers of the operators in this folder: tables, shared intermediate tables, prefix sums."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import shared_path

#: ASCII white space, the word separator of most contracts (fixed value).
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and fixes the rows that later passes see.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind; else these stay on the disks until the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_open = threading.local()


@contextlib.contextmanager
def paths_written() -> Iterator[list[str]]:
    """The paths of the tables that :func:`materialize` writes inside."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield scopes[-1]
    finally:
        left = scopes.pop()
        if scopes:
            scopes[-1].extend(left)


def settled(make: Callable[[], DataFrame], name: str, compression: str = "zstd") -> DataFrame:
    """The rows of ``make()`` as a table of their own; the intermediate tables written on the way are deleted.

    Only tables that :func:`materialize` writes while ``make`` runs are deleted, once the result is whole, so
    nothing that is still to be read, or to be made again after a lost executor, needs them.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        out = make()
        passed = list(scopes[-1])
        kept = materialize(out, name, compression)
        remove(out.sparkSession, passed)
        scopes[-1] = scopes[-1][len(passed):]
        return kept
    finally:
        left = scopes.pop()
        if scopes:  # an enclosing scope deletes them in its turn
            scopes[-1].extend(left)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder, by the file system that holds them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece hold about ``max_bytes``.

    A single longer text is a piece of its own; no text is ever cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > max_bytes and i > first:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(n)
        yield batch.slice(first)


#: Bytes of one Arrow batch of texts.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands texts to Python in Arrow batches of about ``BATCH_BYTES``.

    Spark's default is 64 MB, held by the executor and by the worker at once, for every running task. A longer
    text is a batch of its own; results do not depend on batches.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                rows_per_block: int = 4_000) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same ``keys`` in ``order``.

    In levels, so that a key with a third of all rows is not one task: the rows of a key are dealt to blocks by a
    leading piece of the first order column (a hex digest) and summed within their block; the sums of the
    blocks are added up the same way, by fewer digits, until a key has few enough. So every window stays bounded,
    at the lowest level by ``rows_per_block`` and above by 4,096 blocks. The number of hex digits follows the size of
    the largest key.

    ``keys`` may hold nulls (one group). Rows equal in ``order`` are told apart by no more
    than that, so their order among themselves is free.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 0
    while largest > rows_per_block * 16 ** digits:
        digits += 1
    return _sums_before(df, keys, order, value, out, digits)


def _sums_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, digits: int) -> DataFrame:
    """``running_sum`` with blocks by ``digits`` leading digits of the first order column."""
    earlier = (Window.unboundedPreceding, -1)
    if not digits:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
        return df.withColumn(out, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    block, below, base = f"_block{digits}", f"_in_block{digits}", f"_before{digits}"
    df = df.withColumn(block, F.substring(F.col(order[0]), 1, digits))
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias(below))
    sums = _sums_before(sums, keys, [block], below, base, max(0, digits - 3))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(block).alias("_kb"), base)
    same: Column = F.col(block) == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(*earlier)
    return (df.join(sums, same, "left")
            .withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop(block, "_kb", base, *[f"_k{i}" for i in range(len(keys))]))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they cannot find it themselves.

    Nothing to do if the folder is on PYTHONPATH or is the working folder of a local master; else
    the package is sent along as a zip file, once per session.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local["):
        seen.append(os.getcwd())
    if root in seen or spark.conf.get("ledgerlens.shipped", None):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-zip-"), "ledgerlens")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "ledgerlens"))
    spark.conf.set("ledgerlens.shipped", "true")
