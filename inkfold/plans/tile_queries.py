"""Queries over small grey tiles and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import raster
from inkfold.operators import ink, marks, models
from inkfold.plans import fakes
from inkfold.plans.registry import query
from inkfold.sources.views import grids, tiles, with_views

SIDE = 8


def _ink():
    return F.col("grey") > 128


@query(with_views("""with g as (select vec_id, i, i - row_number() over (partition by vec_id order by i) as island from tiles where grey > 128)
select vec_id, min(i) as start, (max(i) + 1)::int as "end" from g group by vec_id, island having max(i) - min(i) >= 2""", "tiles"))
def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.runs(tiles(spark, sf_dir), "vec_id", _ink())


_BLANKS = """with g as (select vec_id, i, lead(i) over (partition by vec_id order by i) - i - 1 as length from tiles where grey > 128),
b as (select vec_id, (i + 1)::int as start, length::int as length from g where length > 0)
"""


@query(with_views(_BLANKS + "select * from b", "tiles"))
def interior_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.interior_blanks(tiles(spark, sf_dir), "vec_id", _ink())


@query(with_views(_BLANKS + "select vec_id, arg_max(start, (length, -start)) as start, max(length) as length from b group by 1", "tiles"))
def widest_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.widest_blank(ink.interior_blanks(tiles(spark, sf_dir), "vec_id", _ink()), "vec_id")


@query(with_views("select vec_id, greatest(case when count(*) < 2 then 200.0 else quantile_cont(least(grey, 200), 0.75) end, 1.0)::double as size from tiles where grey > 128 group by 1", "tiles"))
def character_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = tiles(spark, sf_dir).where(_ink()).withColumn("short", F.lit(200))
    return ink.character_size(marks, "vec_id", "grey", "short")


@query(with_views("select vec_id, coalesce(trunc(quantile_cont(grey, 0.5) filter (grey <= 128))::int, 255) as grey from tiles group by 1", "tiles"))
def background_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.background(tiles(spark, sf_dir), "vec_id", _ink(), ["grey"])


@query(with_views("select vec_id, avg((grey > 128)::int) > 0.5 as inverted from tiles where i % 8 in (0, 7) or i // 8 in (0, 7) group by 1", "tiles"))
def ink_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("i") % SIDE, F.floor(F.col("i") / SIDE)
    return ink.inverted(tiles(spark, sf_dir), "vec_id", _ink(), x.isin(0, SIDE - 1) | y.isin(0, SIDE - 1))


@query(with_views("""with h as (select vec_id, grey, count(*) as n from tiles group by 1, 2),
c as (select vec_id, grey, sum(n) over u as n0, sum(grey * n) over u as s0, sum(n) over (partition by vec_id) as n_all, sum(grey * n) over (partition by vec_id) as s_all
  from h window u as (partition by vec_id order by grey rows unbounded preceding)),
s as (select vec_id, grey, case when n0 = n_all then 0 else ((n0 * s_all - n_all * s0) * (n0 * s_all - n_all * s0))::double / (n0 * (n_all - n0))::double end as score from c)
select vec_id, grey as level from s qualify row_number() over (partition by vec_id order by score desc, grey) = 1""", "tiles"))
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.otsu(tiles(spark, sf_dir), "vec_id", "grey")


@query(with_views("select distinct a.vec_id, b.i from tiles a join tiles b on a.vec_id = b.vec_id and abs(a.i % 8 - b.i % 8) <= 1 and abs(a.i // 8 - b.i // 8) <= 1 where a.grey > 200", "tiles"))
def dilate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.dilated(tiles(spark, sf_dir).where("grey > 200").select("vec_id", "i"), "vec_id", SIDE, SIDE, 1)


@query(with_views("select vec_id, i, greatest(case when grey > 128 then grey else 0 end, case when i % 3 = 0 then 200 else 0 end)::int as grey from tiles where grey > 128 or i % 3 = 0", "tiles"))
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tiles(spark, sf_dir)
    brush = cells.where("i % 3 = 0").withColumn("grey", F.lit(200))
    return ink.united(cells.where(_ink()), brush, ["vec_id", "i"], "grey")


@query(with_views("select vec_id, i, floor((255 * (i * 4) + grey * (255 - i * 4)) / 255.0 + 0.5)::int as grey from tiles", "tiles"))
def blend_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("vec_id", "i", ink.blended(F.lit(255), F.col("grey"), F.col("i") * 4).alias("grey"))


@query(with_views("select vec_id, min(i % 8)::int as x0, min(i // 8)::int as y0, (max(i % 8) + 1)::int as x1, (max(i // 8) + 1)::int as y1 from tiles where grey > 150 group by 1", "tiles"))
def ink_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.boxes(tiles(spark, sf_dir).where("grey > 150"), ["vec_id"], SIDE)


@query(with_views("""with recursive walk(vec_id, i, root) as (
  select vec_id, i, i from tiles where grey > 150
  union
  select w.vec_id, t.i, w.root from walk w join tiles t on w.vec_id = t.vec_id and t.grey > 150 and abs(t.i % 8 - w.i % 8) <= 1 and abs(t.i // 8 - w.i // 8) <= 1)
select vec_id, i, dense_rank() over (partition by vec_id order by root)::int as component from (select vec_id, i, min(root) as root from walk group by 1, 2)""", "tiles"))
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of a batch are labelled at once, as one column of tiles with blank rows between them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = len(frame)
            stack = np.zeros((n, SIDE + 1, SIDE), np.uint8)
            stack[:, :SIDE] = np.array(frame["grey"].tolist()).reshape(n, SIDE, SIDE) > 150
            labels = raster.labelled(stack.reshape(-1, SIDE))[0].reshape(n, -1)[:, : SIDE * SIDE]
            first = np.where(labels > 0, labels, np.iinfo(np.int32).max).min(1)
            tile, at = np.nonzero(labels)
            yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[tile], "i": at.astype(np.int32), "component": labels[tile, at] - first[tile] + 1})

    return grids(spark, sf_dir).mapInPandas(run, "vec_id long, i int, component int")


@query(with_views("""with recursive near as (select distinct a.vec_id, b.i from tiles a join tiles b on a.vec_id = b.vec_id and abs(a.i % 8 - b.i % 8) <= 1 and abs(a.i // 8 - b.i // 8) <= 1 where a.grey > 200),
walk(vec_id, i, root) as (select vec_id, i, i from near
  union
  select w.vec_id, n.i, w.root from walk w join near n on w.vec_id = n.vec_id and abs(n.i % 8 - w.i % 8) <= 1 and abs(n.i // 8 - w.i // 8) <= 1),
piece as (select vec_id, i, min(root) as root from walk group by 1, 2),
mark as (select vec_id, root, min(i % 8) as x0, min(i // 8) as y0, max(i % 8) + 1 as x1, max(i // 8) + 1 as y1 from piece join tiles using (vec_id, i) where grey > 200 group by 1, 2),
more as (select *, greatest(1, round_even(0.25 * greatest(x1 - x0, y1 - y0), 0))::int as m from mark)
select vec_id, (row_number() over (partition by vec_id order by root) - 1)::int as patch, greatest(0, x0 - m)::int as x0, greatest(0, y0 - m)::int as y0, least(8, x1 + m)::int as x1, least(8, y1 + m)::int as y1 from more""", "tiles"))
def patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work patches around the marks of a tile: components on a dilated mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (vec, k, *box)
                for vec, grey in zip(frame["vec_id"], frame["grey"])
                for k, box in enumerate(raster.patches((np.reshape(grey, (SIDE, SIDE)) > 200).astype(np.uint8) * 255, apart=2, least=1, context=0.25))
            ]
            yield pd.DataFrame(rows, columns=["vec_id", "patch", "x0", "y0", "x1", "y1"])

    return grids(spark, sf_dir).mapInPandas(run, "vec_id long, patch int, x0 int, y0 int, x1 int, y1 int")


def _pixels(spark: SparkSession, sf_dir: str, over: int) -> DataFrame:
    """(vec_id, x, y) of the cells above a grey level."""
    return tiles(spark, sf_dir).where(F.col("grey") > over).select("vec_id", (F.col("i") % SIDE).alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"))


@query(with_views("""with recursive walk(vec_id, i, root) as (
  select vec_id, i, i from tiles where grey > 150
  union
  select w.vec_id, t.i, w.root from walk w join tiles t on w.vec_id = t.vec_id and t.grey > 150 and abs(t.i % 8 - w.i % 8) <= 1 and abs(t.i // 8 - w.i // 8) <= 1)
select vec_id, i, dense_rank() over (partition by vec_id order by root)::int as component from (select vec_id, i, min(root) as root from walk group by 1, 2)""", "tiles"))
def labelled_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same marks by joins of runs, as pages of any size need it."""
    found = marks.numbered(marks.labelled(_pixels(spark, sf_dir, 150), "vec_id"), "vec_id")
    return found.select("vec_id", (F.col("y") * SIDE + F.col("x")).cast("int").alias("i"), "component")


@query(with_views("""with recursive near as (select distinct a.vec_id, b.i from tiles a join tiles b on a.vec_id = b.vec_id and abs(a.i % 8 - b.i % 8) <= 1 and abs(a.i // 8 - b.i // 8) <= 1 where a.grey > 200),
walk(vec_id, i, root) as (select vec_id, i, i from near
  union
  select w.vec_id, n.i, w.root from walk w join near n on w.vec_id = n.vec_id and abs(n.i % 8 - w.i % 8) <= 1 and abs(n.i // 8 - w.i // 8) <= 1),
piece as (select vec_id, i, min(root) as root from walk group by 1, 2),
mark as (select vec_id, root, min(i % 8) as x0, min(i // 8) as y0, max(i % 8) + 1 as x1, max(i // 8) + 1 as y1 from piece join tiles using (vec_id, i) where grey > 200 group by 1, 2),
more as (select *, greatest(1, round_even(0.25 * greatest(x1 - x0, y1 - y0), 0))::int as m from mark)
select vec_id, (row_number() over (partition by vec_id order by root) - 1)::int as patch, greatest(0, x0 - m)::int as x0, greatest(0, y0 - m)::int as y0, least(8, x1 + m)::int as x1, least(8, y1 + m)::int as y1 from more""", "tiles"))
def planned_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patches by joins of runs."""
    return marks.patches(_pixels(spark, sf_dir, 200), "vec_id", SIDE, SIDE, apart=2, least=1, context=0.25)


@query(with_views("""with ink as (select vec_id, i % 8 as x, i // 8 as y from tiles where grey > 128), box as (select vec_id, max(y) - min(y) > max(x) - min(x) as upright from ink group by 1),
used as (select distinct vec_id, upright, case when upright then x else y end as p from ink join box using (vec_id)),
islands as (select *, p - row_number() over (partition by vec_id order by p) as island from used),
runs as (select vec_id, upright, min(p) as a, max(p) + 1 as b from islands group by vec_id, upright, island having count(*) >= 3),
every as (select distinct vec_id from tiles)
select e.vec_id, (row_number() over (partition by e.vec_id order by case when upright then -a else a end) - 1)::int as ord, coalesce(upright, false) as upright,
  case when a is not null and upright then a else 0 end::int as x0, case when a is not null and not upright then a else 0 end::int as y0,
  case when a is not null and upright then b else 8 end::int as x1, case when a is not null and not upright then b else 8 end::int as y1 from every e left join runs r on e.vec_id = r.vec_id""", "tiles"))
def ink_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ink in each tile, or the tile itself."""
    regions = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    return marks.slices(_pixels(spark, sf_dir, 128), regions, "vec_id", F.lit(SIDE), F.lit(SIDE))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, data): tiles as 64 bytes of grey."""
    return grids(spark, sf_dir).select(F.col("vec_id").alias("page_id"), F.unhex(F.array_join(F.transform("grey", lambda g: F.lpad(F.hex(g), 2, "0")), "")).alias("data"))


@query(with_views("""with b as (select vec_id as page_id, i % 8 as x, i // 8 as y, grey from tiles),
d as (select page_id, 1 as label, count(*) as n, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from b where grey > 215 group by 1
  union all select page_id, 0, count(*), min(x), min(y), max(x) + 1, max(y) + 1 from b where grey > 128 group by 1)
select p.page_id, case when t.n is null then null else 1 - d.label end::int as det_id, case when t.n is not null then d.label end::int as label, case when t.n is not null then d.n / 64 end as score,
  case when t.n is not null then d.x0 end::int as x0, case when t.n is not null then d.y0 end::int as y0, case when t.n is not null then d.x1 end::int as x1, case when t.n is not null then d.y1 end::int as y1, case when t.n is null then 'blank page' end as why
from (select distinct page_id from b) p left join (select * from d where label = 1) t on p.page_id = t.page_id left join d on d.page_id = p.page_id and (t.n is not null or d.label = 0)""", "tiles"))
def detect_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection by a model that looks at every pixel: bright ink and the ground around it; a page without bright ink fails."""
    return models.detected(_payloads(spark, sf_dir), fakes.pixel_detector).select("page_id", "det_id", "label", "score", "x0", "y0", "x1", "y1", "why")


@query(with_views("""with b as (select vec_id, max(i % 8) - min(i % 8) + 1 as w, max(i // 8) - min(i // 8) + 1 as h from tiles where grey > 200 group by 1)
select t.vec_id as page_id, 0 as ord, case when coalesce(any_value(w), 0) < 4 or coalesce(any_value(h), 0) < 4 then '' else 'ja ' || sum(grey) || ' ' || sum(grey * i) end as text from tiles t left join b on b.vec_id = t.vec_id group by 1""", "tiles"))
def read_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading by a model that looks at every pixel; regions whose ink is too small aren't read."""
    box = ink.boxes(tiles(spark, sf_dir).where("grey > 200"), ["vec_id"], SIDE).select(F.col("vec_id").alias("page_id"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    crops = _payloads(spark, sf_dir).join(box, "page_id", "left").select("page_id", F.lit(0).alias("ord"), F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("h", F.lit(0)).alias("h"), "data", F.lit("ja").alias("language"))
    return models.read(crops, fakes.pixel_reader)


@query(with_views("select v.vec_id as page_id, coalesce(n, 0) as ink, null as why from (select distinct vec_id from tiles) v left join (select vec_id, count(*) as n from (select distinct a.vec_id, b.i from tiles a join tiles b on a.vec_id = b.vec_id and abs(a.i % 8 - b.i % 8) <= 1 and abs(a.i // 8 - b.i // 8) <= 1 where a.grey >= 128) group by 1) g on g.vec_id = v.vec_id", "tiles"))
def segment_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation by a model that gives each pixel's brightness as its probability; the ink grows by a pixel."""
    pages = _payloads(spark, sf_dir).select("page_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), "data")
    return models.segmented(pages, fakes.pixel_segmenter, grow=1).select("page_id", "ink", "why")
