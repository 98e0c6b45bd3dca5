"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session with adaptive execution on and time in UTC."""
    builder = (
        SparkSession.builder.master(master)
        .appName("inkfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a folder of this machine stands in, but only if all work is done on this machine.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file:///tmp/checkpoints"
    return path.rstrip("/") + "/inkfold"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores: small rows that take much work come from few, small files."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
