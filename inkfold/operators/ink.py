"""Ink in small grids as rows of cells: runs, blanks, percentiles, thresholds, votes and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(cells: DataFrame, key: str, ink: Column, least: int = 3) -> DataFrame:
    """(key, start, end) of runs of inked cells along i, ends exclusive; shorter ones drop out."""
    inked = cells.where(ink).select(key, "i")
    island = F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i"))
    grouped = inked.withColumn("island", island).groupBy(key, "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return grouped.where(F.col("end") - F.col("start") >= least).select(key, "start", "end")


def interior_blanks(cells: DataFrame, key: str, ink: Column) -> DataFrame:
    """(key, start, length) of the gaps between inked cells; blanks at either end don't count."""
    inked = cells.where(ink).select(key, "i")
    gap = F.lead("i").over(Window.partitionBy(key).orderBy("i")) - F.col("i") - 1
    return inked.withColumn("length", gap).where("length > 0").select(key, (F.col("i") + 1).alias("start"), "length")


def widest_blank(blanks: DataFrame, key: str) -> DataFrame:
    """The longest blank, the first of equals."""
    return blanks.groupBy(key).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("b")).select(key, "b.start", "b.length")


def character_size(marks: DataFrame, key: str, side: str, short: str) -> DataFrame:
    """The 75th percentile of mark sizes, each at most the region's short side; that side with fewer than two marks; 1 at least."""
    size = F.percentile(F.least(side, short), 0.75)
    return marks.groupBy(key).agg(F.greatest(F.when(F.count("*") < 2, F.max(short).cast("double")).otherwise(size), F.lit(1.0)).alias("size"))


def background(cells: DataFrame, key: str, ink: Column, channels: list[str]) -> DataFrame:
    """The median of the cells without ink, cut to whole numbers; white if all are inked."""
    mid = [F.coalesce(F.percentile(F.when(~ink, F.col(c)), 0.5).cast("int"), F.lit(255)).alias(c) for c in channels]
    return cells.groupBy(key).agg(*mid)


def inverted(cells: DataFrame, key: str, ink: Column, edge: Column) -> DataFrame:
    """Whether more than half of the edge is ink, so that ink and ground change places."""
    return cells.where(edge).groupBy(key).agg((F.avg(ink.cast("int")) > 0.5).alias("inverted"))


def otsu(cells: DataFrame, key: str, grey: str) -> DataFrame:
    """The grey level that parts a region's cells with the most variance between the classes; the lowest of equals.

    Cells up to the level are one class. Whole numbers throughout: the score of a level is
    (n0 * s - n * s0)^2 / (n0 * n1), compared as a double.
    """
    histogram = cells.groupBy(key, grey).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy(grey).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    weight = F.col(grey) * F.col("n")
    h = histogram.select(key, grey, F.sum("n").over(upto).alias("n0"), F.sum(weight).over(upto).alias("s0"), F.sum("n").over(whole).alias("n_all"), F.sum(weight).over(whole).alias("s_all"))
    apart = F.col("n0") * F.col("s_all") - F.col("n_all") * F.col("s0")
    below = F.col("n0") * (F.col("n_all") - F.col("n0"))
    score = F.coalesce(F.try_divide((apart * apart).cast("double"), below.cast("double")), F.lit(0.0))
    return h.groupBy(key).agg(F.max_by(grey, F.struct(score, -F.col(grey))).alias("level"))


def dilated(cells: DataFrame, key: str, width: int, height: int, n: int) -> DataFrame:
    """(key, i): the cells within n rows and columns of a given cell. Cells are (key, i), counted row by row.

    Every cell gives its square of neighbours, so the work is in proportion to the cells.
    """
    x, y = F.col("i") % width, F.floor(F.col("i") / width)
    steps = F.sequence(F.lit(-n), F.lit(n))
    around = cells.select(key, x.alias("x"), y.alias("y")).select(key, "x", "y", F.explode(steps).alias("dx")).select(key, (F.col("x") + F.col("dx")).alias("x"), "y", F.explode(steps).alias("dy"))
    inside = around.select(key, "x", (F.col("y") + F.col("dy")).alias("y")).where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return inside.select(key, (F.col("y") * width + F.col("x")).cast("int").alias("i")).distinct()


def united(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The larger value of two masks at each place; missing places are 0."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return both.select(*keys, F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias(value))


def blended(over: Column, under: Column, mask: Column) -> Column:
    """over where the mask is 255, under where it is 0, in proportion between; rounded half up."""
    return F.floor((over * mask + under * (255 - mask)) / 255.0 + 0.5).cast("int")


def boxes(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The bounding box of the cells of each key; ends exclusive."""
    x, y = F.col("i") % width, F.floor(F.col("i") / width).cast("int")
    return cells.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))
