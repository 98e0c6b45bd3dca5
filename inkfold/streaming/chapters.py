"""The cast of each chapter, kept while mentions and corrections stream in, by the rules of the batch fold.

What is kept of a name (`folds.facts`) is the same however its events are ordered, so late news and late
corrections, in any batch, end where one batch of all of them ends: the sequence number of an event decides,
not its arrival. The state is an aggregate of fixed size for each chapter and name, held by Spark itself; a batch
writes the names that it touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold.operators import folds


def keep(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts keeping events (a stream as folds.facts takes it) below `folder`.

    A batch that is run again after a crash overwrites what it wrote before.
    """
    return (
        folds.facts(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")).start()
    )


def kept(spark: SparkSession, folder: str, most: int = folds.CAST) -> DataFrame:
    """The cast as it stands: chapter, name, gender, note, settled, place."""
    every = spark.read.option("basePath", folder).parquet(folder)
    newest = F.row_number().over(Window.partitionBy("chapter", "name").orderBy(F.desc("batch")))
    return folds.settled_cast(every.withColumn("newest", newest).where("newest = 1").drop("newest", "batch"), most)
