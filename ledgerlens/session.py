"""SparkSession helpers.

Everything in the library takes a ``SparkSession`` from the caller; this module only
offers a builder with settings that suit the plans here, and the one place that
decides where materialised intermediate tables go.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in the library relies on. AQE coalesces the few-row
# aggregate shuffles, converts joins to broadcast only when the runtime size is
# under the threshold, and splits skewed join partitions (a hot client or person
# key may hold a large share of all rows).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens", driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is None:
        shuffle_partitions = 8 if cores == "*" else max(int(cores), 1)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for materialised tables and checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system named by
    the cluster), read from the session. Only a ``local`` master without that
    setting gets a fresh local folder (tests); any other master raises, because
    executors cannot see a folder on the driver's disk.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: computed once, whatever reads it afterwards."""
    path = shared_path(df.sparkSession, "written", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
