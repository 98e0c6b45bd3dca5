"""Connected components by alternating large and small stars, with lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.tables import materialize


def _nearest(pairs: DataFrame) -> DataFrame:
    """u and the smallest of its neighbours and itself; written out, so that a join on a hub can be split."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) for every id in a link: root is the smallest id that can be reached.

    Links with a null end and self-links are ignored. The work per round is in proportion to the links;
    minima are taken before the shuffle, and no node's links need to meet in one task.
    """
    pairs = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    pairs = materialize(pairs, "links")
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        large = materialize(
            both.where("v > u").join(_nearest(both), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "large",
        )
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = _nearest(down)
        small = down.join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        pairs = materialize(
            small.union(least.where("u != m").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(), "small"
        )
    roots = pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return roots.union(pairs.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
