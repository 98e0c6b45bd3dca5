"""The languages that a page can be in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import text as t

# Code, name, right to left, stacked in columns, words are spaced.
LANGUAGES = [
    ("ja", "Japanese", True, True, False),
    ("zh", "Chinese (simplified)", False, True, False),
    ("zh-Hant", "Chinese (traditional)", True, True, False),
    ("ko", "Korean", False, True, True),
    ("en", "English", False, False, True),
]
DEFAULT = "ja"


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, language string, rtl boolean, stacked boolean, spaced boolean")


def looked_up(rows: DataFrame, asked: str) -> DataFrame:
    """rows with the columns of the language asked for: blank is the default, unknown codes give nulls. The dimension has five rows."""
    key = F.lower(F.coalesce(F.nullif(t.strip(F.col(asked)), F.lit("")), F.lit(DEFAULT)))
    known = dimension(rows.sparkSession).withColumn("key", F.lower("code"))
    return rows.withColumn("key", key).join(F.broadcast(known), "key", "left").drop("key")


def unknown(rows: DataFrame, asked: str) -> DataFrame:
    """The rows that ask for a language that there isn't."""
    return looked_up(rows, asked).where("code is null").select(rows.columns)
