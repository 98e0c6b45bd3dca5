"""Archives of pages (zip and cbz), by the data source: pages in natural order, and folders packed into archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.operators.gallery import in_natural_order, unique_names
from inkfold.sources.page_archives import register


def entries(spark: SparkSession, path: str, columns: str = "archive string, path string, size long, why string", **options: str) -> DataFrame:
    """Page entries below path, from the directories alone unless `data` or `head` is among the columns."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("page_archive").schema(columns).options(**{"push_filters": push} | options).load(path)


def pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(archive, place, name, type, data) of the page images; places follow the natural order of their paths.

    Places come from the directories, so ordering doesn't move page bytes unless there are very many pages.
    """
    listed = entries(spark, path, "archive string, path string", **options).where("path is not null")
    placed = in_natural_order(listed, "archive", "path")
    found = entries(spark, path, "archive string, path string, data binary, why string", **options).where("path is not null and why is null")
    return found.join(placed, ["archive", "path"]).select("archive", "place", t.base_name(F.col("path")).alias("name"), t.image_type(F.col("path")).alias("type"), "data")


def pack(files: DataFrame, path: str, archive: str = "archive", name: str = "name", order: str = "place", data: str = "data", mode: str = "append", spread: bool = False) -> None:
    """Writes each archive's files, stored without compression in their order under names that don't clash, below path.

    A task streams the files of its archives, one after the other. spread: an archive may be dealt over several
    tasks; its parts are then put together by the commit, which copies their bytes.
    """
    register(files.sparkSession)
    names = unique_names(files.select(archive, name, order), archive, name, order).select(archive, order, "unique_name")
    rows = files.join(names, [archive, order]).select(F.col(archive).alias("archive"), F.col("unique_name").alias("path"), F.col(order).alias("place"), F.col(data).alias("data"))
    dealt = rows.repartitionByRange("archive", "place") if spread else rows.repartition("archive")
    dealt.sortWithinPartitions("archive", "place").write.format("page_archive").mode(mode).save(path)
