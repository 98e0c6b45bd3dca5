"""Lines of a page: one question for equal lines, answers for all of them, counts that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import text as t


def not_blank(lines: DataFrame) -> DataFrame:
    """Lines with text; ord stays."""
    return lines.where(~t.blank(F.col("text")))


def asked_once(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """One row per text and kind of a page: n by first appearance, from 1, and the tightest budget.

    A budget of null doesn't count. A first line with budget 0 keeps 0, whatever its copies have. Texts are
    compared as they stand, not stripped.
    """
    first = F.min_by("budget", "ord")
    budget = F.when(first == 0, 0).otherwise(F.min(F.nullif("budget", F.lit(0))))
    asked = lines.groupBy(page, "text", "kind").agg(F.min("ord").alias("first_ord"), budget.alias("budget"), F.count("*").alias("copies"))
    return asked.withColumn("n", F.row_number().over(Window.partitionBy(page).orderBy("first_ord")))


def fanned_out(lines: DataFrame, answers: DataFrame, page: str = "page_id") -> DataFrame:
    """lines with the answer to their text and kind."""
    return lines.join(answers.select(page, "text", "kind", "answer"), [page, "text", "kind"], "left")


def misaligned(left: DataFrame, right: DataFrame, page: str = "page_id") -> DataFrame:
    """Pages where the two lists aren't of one length, with both lengths."""
    a = left.groupBy(page).agg(F.count("*").alias("wanted"))
    b = right.groupBy(page).agg(F.count("*").alias("got"))
    both = a.join(b, page, "full").select(page, F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("got", F.lit(0)).alias("got"))
    return both.where("wanted <> got")


def zipped(left: DataFrame, right: DataFrame, page: str = "page_id") -> DataFrame:
    """left and right row by row on ord, for the pages whose lists are of one length."""
    wrong = misaligned(left, right, page)
    return left.join(right, [page, "ord"]).join(wrong, page, "left_anti")


def numbered(asked: DataFrame) -> DataFrame:
    return asked.withColumn("line", t.numbered(F.col("n"), F.col("text"), F.col("kind"), F.coalesce("budget", F.lit(0))))


def page_texts(rows: DataFrame, page: str, order: str, by: str = "\n") -> DataFrame:
    """The texts of a page that aren't blank, joined in order; a page without any is still there."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: t.strip(x.text))
    return rows.groupBy(page).agg(F.array_join(F.filter(listed, lambda x: x != ""), by).alias("text"))


def missing(stage: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a later run has still to do."""
    return stage.join(done.select(key), key, "left_anti")


def reasons(rows: DataFrame, why: str = "why") -> DataFrame:
    """How many rows failed for each reason."""
    return rows.where(F.col(why).isNotNull()).groupBy(why).agg(F.count("*").alias("n"))
