"""Reading inputs and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.session import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that later jobs start from files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df begins with it; Spark's names ignore case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def id_crc(column: str = "doc_id"):
    """crc32 of an id's decimal text; held-out sets are remainders of it."""
    return F.crc32(F.col(column).cast("string"))


def hash_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """The `bound` rows with the smallest hash of `key`.

    The hashes are cut at about a third more than the bound before they are sorted, so what is gathered
    doesn't grow with the table.
    """
    steps = 1 << 40
    total = rows.count()
    place = F.pmod(F.xxhash64(key), F.lit(steps))
    if total > 2 * bound:
        rows = rows.where(place < int(steps * (bound + 1000) * 1.3 / total))
    return rows.orderBy(place, key).limit(bound)


def labelled(labels: DataFrame, target: str, held_out: tuple[int, int]) -> DataFrame:
    """All (doc_id, label) rows outside the held-out remainder.

    Rows without an id or a label are dropped; repeated ids with different labels take the mean, rounded.
    """
    mod, rem = held_out
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
        .where(id_crc() % mod != rem)
        .groupBy("doc_id")
        .agg(F.round(F.avg(F.col(target).cast("double"))).cast("int").alias("label"))
    )
