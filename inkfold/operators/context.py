"""What a page is told of its chapter: beats before and after it, fixed windows of pages, prompt parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import text as t

BEFORE, AFTER = 6, 2
SURVEY_PAGES = 8
NOTE, SCENE, CAST_NOTE, SYNOPSIS, REGISTER, BEAT = 80, 600, 200, 1200, 200, 160


def around(pages: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Adds context: the beats from `before` pages back to `after` pages on, one a line.

    A blank beat is left out but its page keeps its place; the page itself has an arrow; pages count from 1.
    """
    near = Window.partitionBy("chapter").orderBy("page_no").rowsBetween(-before, after)
    # cut before the window, which would cut a page's text again for every page that sees it
    rows = pages.withColumn("seen", F.struct("page_no", t.cut(F.col("beat"), BEAT).alias("beat"))).withColumn("seen", F.collect_list("seen").over(near))
    line = F.transform(
        F.filter("seen", lambda b: b.beat != ""),
        lambda b: F.concat(F.when(b.page_no == F.col("page_no"), "→ ").otherwise("  "), (b.page_no + 1).cast("string"), F.lit(". "), b.beat),
    )
    return rows.withColumn("context", F.array_join(line, "\n")).withColumn("n_seen", F.size("seen")).drop("seen")


def survey_windows(pages: DataFrame, size: int = SURVEY_PAGES) -> DataFrame:
    """The chapter in windows of `size` pages: the first page, how many, and their beats, one a line."""
    window = F.floor(F.col("page_no") / size).cast("int")
    beat = F.struct("page_no", F.concat(F.lit("Page "), (F.col("page_no") + 1).cast("string"), F.lit(":\n"), t.strip(F.col("beat"))).alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(beat)), lambda b: b.text)
    return pages.groupBy("chapter", window.alias("window")).agg(F.min("page_no").alias("first"), F.count("*").alias("pages"), F.array_join(listed, "\n\n").alias("text"))


def positions(pages: DataFrame) -> DataFrame:
    """`This is page p of n.` if any beat of the chapter has text, else nothing."""
    whole = Window.partitionBy("chapter")
    told = F.bool_or(~t.blank(F.col("beat"))).over(whole)
    sentence = F.format_string("This is page %d of %d.", F.col("page_no") + 1, F.count("*").over(whole))
    return pages.withColumn("position", F.when(told, sentence).otherwise(""))


def fits(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether a chapter has a beat for each page; only then is it handed on."""
    n = pages.groupBy("chapter").agg(F.count("*").alias("pages"))
    return chapters.join(n, "chapter", "left").withColumn("fits", F.coalesce(F.size("beats") == F.col("pages"), F.lit(False))).drop("pages")
