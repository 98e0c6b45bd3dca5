"""Work done once for each distinct content: answers are kept in a table by content hash and fan out to all rows that have it.

The table has two parts. `answers` is written first, under the run that asked, then `asked`: the contents of that
run. Only answers of a run that got as far as `asked` count, so a run that dies half way is as if it hadn't been,
and a content without any answer isn't asked again. If two runs asked for one content at once, the first by name counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Answer = Callable[[DataFrame], DataFrame]


def content_hash(payload: str | Column) -> Column:
    """The key of a content; null has none."""
    return F.sha2(payload, 256)


def _asked(spark: SparkSession, folder: str) -> DataFrame | None:
    """(content, run) of what was asked so far."""
    try:
        found = spark.read.schema("content string, run string").parquet(f"{folder}/asked")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.groupBy("content").agg(F.min("run").alias("run"))


def recalled(spark: SparkSession, folder: str) -> DataFrame:
    """All answers that count, with their content."""
    answers = spark.read.parquet(f"{folder}/answers")
    return answers.join(_asked(spark, folder), ["content", "run"], "left_semi").drop("run")


def ask_for_new(rows: DataFrame, payload: str, answer: Answer, folder: str) -> int:
    """Asks for the contents of rows that aren't in the table yet, each once; how many there were.

    answer: a function from (content, payload) to any number of rows with `content`, such as a model stage. Copies are
    put together before they are shuffled, so a content that very many rows share costs a row of each task. Keys alone
    tell what is new; payloads move once, and not at all if nothing is.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    own = rows.select(content_hash(payload).alias("content"), payload).where("content is not null")
    known = _asked(spark, folder)
    if known is not None:
        own.select("content").distinct().join(known, "content", "left_anti").write.parquet(f"{folder}/new/run={run}")
        new = spark.read.schema("content string").parquet(f"{folder}/new/run={run}")
        if new.isEmpty():
            return 0
        own = own.join(new, "content", "left_semi")
    once = own.groupBy("content").agg(F.any_value(payload).alias(payload))
    # the contents are written with their payload, so that what is asked and what is noted as asked are the same
    once.write.parquet(f"{folder}/asking/run={run}")
    once = spark.read.parquet(f"{folder}/asking/run={run}")
    answer(once).write.parquet(f"{folder}/answers/run={run}")
    once.select("content", F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/asked")
    return once.count()


def answered(rows: DataFrame, payload: str, answer: Answer, folder: str) -> DataFrame:
    """rows without their payload, each with the answers to its content; nulls where there is no answer.

    Contents that the table has aren't asked for again, whoever had them.
    """
    ask_for_new(rows, payload, answer, folder)
    keyed = rows.withColumn("content", content_hash(payload)).drop(payload)
    return keyed.join(recalled(rows.sparkSession, folder), "content", "left")
