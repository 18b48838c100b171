"""What a derived table was made from: the files of its base table, checked before it is trusted.

A date profile, a list of report dates or a rollup answers for its facts only while they are the same. Next to it lies a
manifest, the names and sizes of the data files at the time of writing. Spark writes new files on every append or
overwrite (their names carry a random id), so any change of the base shows. Listing goes through Spark's file
source, so it works wherever the tables lie and reads no content; the comparison is one small aggregate.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """file (below ``path``), bytes of every parquet file of a table."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").load(path))
    name = os.path.basename(path.rstrip("/"))
    return listed.select(F.substring_index("path", f"/{name}/", -1).alias("file"), F.col("length").alias("bytes"))


def record(spark: SparkSession, path: str, manifest: str, mode: str = "overwrite") -> None:
    """Write the manifest of the table at ``path``."""
    data_files(spark, path).coalesce(1).write.mode(mode).parquet(manifest)


def is_current(spark: SparkSession, path: str, manifest: str) -> bool:
    """Whether the table at ``path`` has exactly the files of the manifest; False without a manifest."""
    try:
        known = spark.read.parquet(manifest).select("file", "bytes", F.lit(1).alias("n"))
    except AnalysisException:
        return False
    now = data_files(spark, path).withColumn("n", F.lit(-1))
    return known.unionByName(now).groupBy("file", "bytes").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty()
