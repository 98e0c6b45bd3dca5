"""Marks on pages of any size as rows of pixels: connected marks, patches to work on, and lines of ink, by joins and windows.

A page's pixels are rows (key, x, y), of which only the inked ones are there. Work is on runs of a row, so it is in
proportion to the ink's outline; every join has the page as a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators import ink
from inkfold.session import kept


def _kept(df: DataFrame) -> DataFrame:
    return kept(df, "marks")


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles: nothing is gathered on the driver for a broadcast, however small it looks in some round."""
    return a.join(b.hint("merge"), on, how)


def row_runs(cells: DataFrame, key: str) -> DataFrame:
    """(key, id, y, a, b): runs of neighbouring pixels of a row, from a to before b. id follows the order of rows, then columns."""
    island = F.col("x") - F.row_number().over(Window.partitionBy(key, "y").orderBy("x"))
    found = cells.select(key, "x", "y", island.alias("island")).groupBy(key, "y", "island").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    return found.select(key, (F.shiftleft(F.col("y").cast("long"), 32) + F.col("a")).alias("id"), "y", "a", "b")


def labelled(cells: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """(key, y, a, b, root): runs with the first run of their mark. reach: 1 if pixels that touch at a corner belong together, else 0.

    Each round every mark so far takes the smallest label that one of its runs' neighbours has, as a whole, and that
    label's own new label; so marks at least halve in number, however they wind.
    """
    runs = _kept(row_runs(cells, key))
    above, below = runs.alias("p"), runs.alias("n")
    touch = (F.col(f"p.{key}") == F.col(f"n.{key}")) & (F.col("p.y") + 1 == F.col("n.y")) & (F.col("p.a") < F.col("n.b") + reach) & (F.col("n.a") < F.col("p.b") + reach)
    pairs = above.join(below.hint("merge"), touch).select(F.col(f"p.{key}").alias(key), F.col("p.id").alias("u"), F.col("n.id").alias("v"))
    pairs = _kept(pairs.unionByName(pairs.select(key, F.col("v").alias("u"), F.col("u").alias("v"))))
    now = runs.select(key, "id", F.col("id").alias("root"))
    while True:
        told = _joined(pairs, now.select(key, F.col("id").alias("v"), F.col("root").alias("told")), [key, "v"]).select(key, F.col("u").alias("id"), "told")
        met = _joined(told, now, [key, "id"]).where("told < root").groupBy(key, "root").agg(F.min("told").alias("further"))
        met = _kept(met)
        if met.isEmpty():
            return _joined(runs, now, [key, "id"]).select(key, "y", "a", "b", "root")
        again = met.select(key, F.col("root").alias("further"), F.col("further").alias("furthest"))
        to = _joined(met, again, [key, "further"], "left").select(key, "root", F.coalesce("furthest", "further").alias("to"))
        now = _kept(_joined(now, to, [key, "root"], "left").select(key, "id", F.coalesce("to", "root").alias("root")))


def numbered(runs: DataFrame, key: str) -> DataFrame:
    """(key, component, x, y): the pixels of labelled runs, marks counted from 1 in the order of their first pixels."""
    place = F.dense_rank().over(Window.partitionBy(key).orderBy("root"))
    return runs.withColumn("component", place).select(key, "component", F.explode(F.sequence("a", F.col("b") - 1)).alias("x"), "y")


def patches(cells: DataFrame, key: str, width: int, height: int, apart: int = 24, least: int = 64, context: float = 1.0) -> DataFrame:
    """(key, patch, x0, y0, x1, y1): boxes to work on. Marks nearer than `apart` go together; their surroundings are added, inside the page."""
    at = cells.select(key, (F.col("y") * width + F.col("x")).cast("int").alias("i"))
    near = ink.dilated(at, key, width, height, apart // 2).select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"))
    pieces = labelled(near, key).select(key, "root", "y", F.explode(F.sequence("a", F.col("b") - 1)).alias("x"))
    own = _joined(pieces, cells.select(key, "x", "y"), [key, "x", "y"])
    box = own.groupBy(key, "root").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    more = F.greatest(F.lit(least), F.rint(context * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("int"))
    edges = {"x0": F.greatest(F.lit(0), F.col("x0") - more), "y0": F.greatest(F.lit(0), F.col("y0") - more), "x1": F.least(F.lit(width), F.col("x1") + more), "y1": F.least(F.lit(height), F.col("y1") + more)}
    place = F.row_number().over(Window.partitionBy(key).orderBy("root")) - 1
    return box.select(key, place.alias("patch"), *[c.cast("int").alias(e) for e, c in edges.items()])


def slices(cells: DataFrame, regions: DataFrame, key: str, width: Column, height: Column, least: int = 3) -> DataFrame:
    """(key, ord, upright, x0, y0, x1, y1): a region's lines of ink in reading order.

    Columns from the right if the ink is higher than wide, else rows; a region without a line of `least` pixels
    is one slice. regions: every region once, with what width and height are told from.
    """
    upright = (F.max("y") - F.min("y")) > (F.max("x") - F.min("x"))
    way = cells.groupBy(key).agg(upright.alias("upright"))
    used = cells.join(way, key).select(key, "upright", F.when(F.col("upright"), F.col("x")).otherwise(F.col("y")).alias("p")).distinct()
    island = F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p"))
    lines = used.withColumn("island", island).groupBy(key, "upright", "island").agg(F.min("p").alias("a"), (F.max("p") + 1).alias("b")).where(F.col("b") - F.col("a") >= least)
    rows = regions.select(key, width.alias("w"), height.alias("h")).join(lines, key, "left")
    across = F.col("upright") & F.col("a").isNotNull()
    down = ~F.col("upright") & F.col("a").isNotNull()
    edges = {
        "x0": F.when(across, F.col("a")).otherwise(0), "y0": F.when(down, F.col("a")).otherwise(0),
        "x1": F.when(across, F.col("b")).otherwise(F.col("w")), "y1": F.when(down, F.col("b")).otherwise(F.col("h")),
    }
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("upright"), -F.col("a")).otherwise(F.col("a")))) - 1
    return rows.select(key, place.alias("ord"), F.coalesce("upright", F.lit(False)).alias("upright"), *[c.cast("int").alias(e) for e, c in edges.items()])
