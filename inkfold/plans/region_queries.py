"""Queries over detected regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import geometry as g
from inkfold.functions.geometry import Box
from inkfold.operators import regions as r
from inkfold.operators import space
from inkfold.plans.registry import query
from inkfold.session import kept
from inkfold.sources.views import PAGE_HEIGHT, PAGE_WIDTH, detections, with_views

W, H = PAGE_WIDTH, PAGE_HEIGHT

_CLIP = f"""
clipped as (select page_id, det_id, label, score,
  least(greatest(x0, 0), {W})::int as x0, least(greatest(y0, 0), {H})::int as y0,
  least(greatest(x1, 0), {W})::int as x1, least(greatest(y1, 0), {H})::int as y1 from detections where score >= 0.35),
sure as (select * from clipped where x1 - x0 > 1 and y1 - y0 > 1)"""
_SHARED = "greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0)"
_AREA = "(({a}x1 - {a}x0) * ({a}y1 - {a}y0))"
_COVERS = f"({_SHARED.format(a='k.', b='b.')})::double / least({_AREA.format(a='k.')}, {_AREA.format(a='b.')})"


def _single(source: str) -> str:
    """Recursive duplicate suppression of `source` by page and balloon or not."""
    return f"""
grouped as (select page_id, label = 0 as is_balloon,
  list(struct_pack(det_id, label, score, x0, y0, x1, y1) order by score desc, det_id) as l from {source} group by all),
walk(page_id, is_balloon, i, l, kept) as (
  select page_id, is_balloon, 1, l, l[1:0] from grouped
  union all
  select page_id, is_balloon, i + 1, l, case when len(list_filter(kept, lambda k: {_COVERS.replace('b.', 'l[i].')} >= 0.75)) = 0
    then list_append(kept, l[i]) else kept end from walk where i <= len(l)),
single as (select page_id, is_balloon, unnest(kept, recursive := true) from walk where i = len(l) + 1)"""


def _padded(source: str, share: float) -> str:
    n = f"greatest(2, round_even({share} * least(x1 - x0, y1 - y0), 0))"
    return f"""select page_id, det_id, label, score, least(greatest(x0 - {n}, 0), {W})::int as x0, least(greatest(y0 - {n}, 0), {H})::int as y0,
  least(greatest(x1 + {n}, 0), {W})::int as x1, least(greatest(y1 + {n}, 0), {H})::int as y1 from {source}"""


_ANALYSED = f"""
with recursive {_CLIP.strip()}, {_single('sure')},
padded as ({_padded('single', 0.04)} where not is_balloon),
balloons as (select page_id, det_id as balloon_id, x0 as bx0, y0 as by0, x1 as bx1, y1 as by1 from single where is_balloon),
pairs as (select k.page_id, k.det_id, b.*exclude(page_id), row_number() over (partition by k.page_id, k.det_id order by (bx1 - bx0) * (by1 - by0), balloon_id) as n
  from padded k join balloons b on k.page_id = b.page_id
    and ({_SHARED.format(a='k.', b='b.b')})::double / {_AREA.format(a='k.')} >= 0.85),
blocks as materialized (select k.page_id, (row_number() over (partition by k.page_id order by y0, -x1, score desc, k.det_id) - 1)::int as ord, k.det_id,
  case label when 1 then 'speech' else 'free' end as kind, round(score, 3) as confidence, x0, y0, x1, y1,
  balloon_id, bx0, by0, bx1, by1
  from padded k left join (select * from pairs where n = 1) p on k.page_id = p.page_id and k.det_id = p.det_id)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.analysed(detections(spark, sf_dir), W, H)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r.on_page(r.confident(detections(spark, sf_dir)), W, H).where("label <> 0")
    return r.in_reading_order(text, True).select("page_id", "ord", "det_id", *r.EDGES)


_ORDERED = f"""with {_CLIP.strip()},
ordered as (select page_id, (row_number() over (partition by page_id order by y0, -x1, score desc, det_id) - 1)::int as ord, det_id, x0, y0, x1, y1
  from sure where label <> 0)"""


@query(with_views(f"with {_CLIP.strip()} select * from sure", "detections"))
def region_confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.on_page(r.confident(detections(spark, sf_dir)), W, H)


@query(with_views(f"with {_CLIP.strip()} select page_id, label, score, x0, y0, x1, y1 from sure", "detections"))
def confident_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes without their numbers: nothing is numbered then, so both filters run where the table is read and no row is moved."""
    return r.on_page(r.confident(detections(spark, sf_dir)), W, H).drop("det_id")


@query(with_views("select ['bubble', 'speech', 'free'][label + 1] as kind, count(*) as n, round(avg(score), 6) as confidence, count(*) filter (score < 0.8) as unsure from detections where score >= 0.35 group by 1", "detections"))
def region_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = r.confident(detections(spark, sf_dir)).withColumn("kind", r.kind(F.col("label")))
    return sure.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("confidence"), F.count_if(F.col("score") < r.UNSURE).alias("unsure"))


@query(with_views(f"""select page_id, det_id, (x1 - x0)::int as w, (y1 - y0)::int as h, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy,
  greatest(0, least(x1 + 5, 600) - greatest(x0 + 5, 200))::int as crop_w, greatest(0, least(y1 - 3, 700) - greatest(y0 - 3, 100))::int as crop_h,
  round((greatest(0, least(x1, 600) - greatest(x0, 200)) * greatest(0, least(y1, 700) - greatest(y0, 100)))::double / ((x1 - x0) * (y1 - y0)), 6) as within_window,
  round((greatest(0, least(x1, 600) - greatest(x0, 200)) * greatest(0, least(y1, 700) - greatest(y0, 100)))::double / least((x1 - x0) * (y1 - y0), 240000), 6) as covers_window,
  case when x1 - x0 > 2 * greatest(1, round_even(0.12 * least(x1 - x0, y1 - y0), 0)) and y1 - y0 > 2 * greatest(1, round_even(0.12 * least(x1 - x0, y1 - y0), 0))
    then x0 + greatest(1, round_even(0.12 * least(x1 - x0, y1 - y0), 0)) else x0 end::int as shrunk_x0 from detections""", "detections"))
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    box, window = Box.of(), Box(F.lit(200), F.lit(100), F.lit(600), F.lit(700))
    crop = box.moved(5, -3).cropped(window)
    return detections(spark, sf_dir).select(
        "page_id", "det_id", box.w.cast("int").alias("w"), box.h.cast("int").alias("h"), box.cx.alias("cx"), box.cy.alias("cy"),
        crop.w.cast("int").alias("crop_w"), crop.h.cast("int").alias("crop_h"),
        F.round(box.within(window), 6).alias("within_window"), F.round(box.covers(window), 6).alias("covers_window"), box.shrunk(0.12).x0.cast("int").alias("shrunk_x0"),
    )


@query(with_views(_padded("detections", 0.04), "detections"))
def box_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.padded(detections(spark, sf_dir), r.BLOCK_PAD, W, H)


_INSET = "greatest(1, round_even(0.12 * least(x1 - x0, y1 - y0), 0))"
_GROWN = "greatest(2, round_even(0.03 * least(x1 - x0, y1 - y0), 0))"
_FITS = f"(x1 - x0 > 2 * {_INSET} and y1 - y0 > 2 * {_INSET})"


@query(with_views(f"""select page_id, det_id, (x0 + case when {_FITS} then {_INSET} else 0 end)::int as shrunk_x0, (y0 + case when {_FITS} then {_INSET} else 0 end)::int as shrunk_y0,
  (x1 - case when {_FITS} then {_INSET} else 0 end)::int as shrunk_x1, (y1 - case when {_FITS} then {_INSET} else 0 end)::int as shrunk_y1,
  greatest(x0 - {_GROWN}, 0)::int as read_x0, greatest(y0 - {_GROWN}, 0)::int as read_y0, least(x1 + {_GROWN}, {W})::int as read_x1, least(y1 + {_GROWN}, {H})::int as read_y1,
  greatest(8, round_even((x1 - x0) * 10 * s, 0))::int as work_w, greatest(8, round_even((y1 - y0) * 10 * s, 0))::int as work_h,
  round(k, 6) as scale, (640 - round_even((x1 - x0) * k, 0))::int as pad_right, (640 - round_even((y1 - y0) * k, 0))::int as pad_bottom
from (select *, least(1.0::double, sqrt(1e6::double / ((x1 - x0) * 10 * (y1 - y0) * 10))) as s, least(640.0::double / (y1 - y0), 640.0::double / (x1 - x0)) as k from detections
  where x0 between 0 and {W} and y0 between 0 and {H} and x1 <= {W} and y1 <= {H}) sized""", "detections"))
def box_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of inset boxes and of boxes padded for reading, both working sides, and scale and pads of letterboxes."""
    box = Box.of()
    inside = detections(spark, sf_dir).where(f"x0 between 0 and {W} and y0 between 0 and {H} and x1 <= {W} and y1 <= {H}")
    inset, grown = box.shrunk(0.12), box.padded(r.READ_PAD, r.LEAST_PAD, W, H)
    scale, right, bottom = g.letterbox(box.w, box.h, 640)
    named = {f"{name}_{e}": c for name, b in (("shrunk", inset), ("read", grown)) for e, c in zip(r.EDGES, (b.x0, b.y0, b.x1, b.y1))}
    named |= dict(zip(("work_w", "work_h"), g.working_size(box.w * 10, box.h * 10))) | {"pad_right": right, "pad_bottom": bottom}
    return inside.select("page_id", "det_id", F.round(scale, 6).alias("scale"), *[c.cast("int").alias(n) for n, c in named.items()])


@query(with_views("select page_id, det_id, (score < 0.8) <> (det_id % 3 = 0 and det_id % 9 <> 0) as excluded from detections", "detections"))
def toggled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions left out by their score, some picked once, some twice, and picks of regions that aren't there."""
    d = detections(spark, sf_dir)
    picks = d.where("det_id % 3 = 0").select("page_id", "det_id")
    picks = picks.union(picks.where("det_id % 9 = 0")).union(picks.select("page_id", F.col("det_id") + 100_000))
    return r.toggled(d.select("page_id", "det_id", (F.col("score") < r.UNSURE).alias("excluded")), picks)


@query(with_views("""with c as (select *, y1 - y0 >= x1 - x0 as tall, greatest(x1 - x0, y1 - y0) as side from detections),
p as (select *, case when side < 24 then floor(side / 2 + 0.5) else least(greatest(floor(side * 0.3 + 0.5), 12), side - 12) end::int as cut from c)
select page_id, det_id,
  case when tall then x0 else x0 + cut end::int as fx0, y0::int as fy0, x1::int as fx1, case when tall then y0 + cut else y1 end::int as fy1,
  x0::int as sx0, case when tall then y0 + cut else y0 end::int as sy0, case when tall then x1 else x0 + cut end::int as sx1, y1::int as sy1 from p""", "detections"))
def box_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = Box.of().halves(0.3, r.SLIVER, True)
    return detections(spark, sf_dir).select("page_id", "det_id", *first.columns("f"), *second.columns("s"))


@query(with_views("""select page_id, det_id, round(60 * cos(radians(det_id * 7)) + 20 * sin(radians(det_id * 7)), 6) as along, round(20 * cos(radians(det_id * 7)) - 60 * sin(radians(det_id * 7)), 6) as across,
  ((x0 - y0) % 360 + 360) % 360 as angle, greatest(8, round_even((x1 - x0) * 10 * least(1.0, sqrt(1e6 / ((x1 - x0) * 10 * (y1 - y0) * 10))), 0))::int as work_w,
  round(least(640.0 / (y1 - y0), 640.0 / (x1 - x0)), 6) as scale from detections""", "detections"))
def box_turning(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Box.of()
    along, across = g.turned(F.lit(60.0), F.lit(20.0), F.col("det_id") * 7)
    return detections(spark, sf_dir).select(
        "page_id", "det_id", F.round(along, 6).alias("along"), F.round(across, 6).alias("across"), g.angle(F.col("x0") - F.col("y0")).cast("int").alias("angle"),
        g.working_size(box.w * 10, box.h * 10)[0].alias("work_w"), F.round(g.letterbox(box.w, box.h, 640)[0], 6).alias("scale"),
    )


@query(with_views("""with b as (select *, radians(det_id * 7) as a, ((x0 + x1) - (x0 + 10 + x1 + 30)) / 2 as x, ((y0 + y1) - (y0 + y1 + 16)) / 2 as y from detections)
select page_id, det_id, round(x0 + 10 + x - (x * cos(a) - y * sin(a)), 6) as x0, round(y0 + y - (x * sin(a) + y * cos(a)), 6) as y0,
  round(x1 + 30 + x - (x * cos(a) - y * sin(a)), 6) as x1, round(y1 + 16 + y - (x * sin(a) + y * cos(a)), 6) as y1 from b""", "detections"))
def box_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned boxes after a resize, with the far corner where it was drawn."""
    was = Box.of()
    now = Box(was.x0 + 10, was.y0, was.x1 + 30, was.y1 + 16)
    kept = g.anchored(was, now, F.col("det_id") * 7)
    return detections(spark, sf_dir).select("page_id", "det_id", *[F.round(c, 6).alias(e) for e, c in zip(r.EDGES, (kept.x0, kept.y0, kept.x1, kept.y1))])


@query(with_views(f"""with v as (select page_id, det_id, [case when det_id % 9 = 0 then 'x' else (x1 + 0.5)::varchar end, (y1 + 0.25)::varchar, (x0 - 0.5)::varchar, y0::varchar] as box from detections),
n as (select page_id, det_id, list_transform(box, lambda b: round_even(try_cast(b as double), 0)) as n from v)
select page_id, det_id, least(greatest(case when n[1] is not null then least(n[1], n[3]) end, 0), {W})::int as x0, least(greatest(case when n[1] is not null then least(n[2], n[4]) end, 0), {H})::int as y0,
  least(greatest(case when n[1] is not null then greatest(n[1], n[3]) end, 0), {W})::int as x1, least(greatest(case when n[1] is not null then greatest(n[2], n[4]) end, 0), {H})::int as y1 from n where n[1] is not null""", "detections"))
def boxes_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    values = F.array(
        F.when(F.col("det_id") % 9 == 0, "x").otherwise((F.col("x1") + 0.5).cast("string")), (F.col("y1") + 0.25).cast("string"), (F.col("x0") - 0.5).cast("string"), F.col("y0").cast("string")
    )
    read = d.select("page_id", "det_id", values.alias("box"))
    return read.select("page_id", "det_id", *g.box_from_values(F.col("box"), W, H).columns()).where("x0 is not null")


@query(with_views(f"with recursive {_CLIP.strip()}, {_single('sure')} select page_id, det_id, label, score, x0, y0, x1, y1 from single", "detections"))
def suppress_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = r.on_page(r.confident(detections(spark, sf_dir)), W, H).withColumn("is_balloon", F.col("label") == 0)
    return r.suppressed(sure, ["page_id", "is_balloon"]).drop("is_balloon")


@query(with_views(_ORDERED + " select page_id, ord, det_id from ordered", "detections"))
def reading_order_rtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("page_id", "ord", "det_id")


@query(with_views(_ORDERED.replace("-x1", "x0") + " select page_id, ord, det_id from ordered", "detections"))
def reading_order_ltr(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r.on_page(r.confident(detections(spark, sf_dir)), W, H).where("label <> 0")
    return r.in_reading_order(text, False).select("page_id", "ord", "det_id")


@query(with_views(_ORDERED + """, theirs as (select s.page_id, s.det_id, row_number() over (partition by s.page_id order by s.y0, -s.x1, s.score desc, s.det_id) - 1 as ord, s.y0, s.x1 from sure s where label = 1)
select m.page_id, m.det_id, coalesce(min(t.ord) filter ((t.y0, -t.x1) > (m.y0, -m.x1)), count(t.ord))::int as "at"
from sure m left join theirs t on t.page_id = m.page_id where m.label = 2 group by all""", "detections"))
def insertion_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = r.on_page(r.confident(detections(spark, sf_dir)), W, H)
    return r.insertion_points(sure.where("label = 2"), r.in_reading_order(sure.where("label = 1"), True), True)


@query(with_views(_ANALYSED + "select * from blocks", "detections"))
def assign_balloons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query(with_views(_ANALYSED + "select page_id, balloon_id, count(*) as n, min(ord) as first_ord from blocks where balloon_id is not null group by all having count(*) > 1", "detections"))
def shared_balloons(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _blocks(spark, sf_dir).where("balloon_id is not null")
    return held.groupBy("page_id", "balloon_id").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).where("n > 1")


@query(with_views(_ANALYSED + """, reach as (select page_id, balloon_id, row_number() over w as pos, x0, max(x1) over (w rows between unbounded preceding and 1 preceding) as far
  from blocks where balloon_id is not null window w as (partition by page_id, balloon_id order by x0, x1, det_id)),
gaps as (select *, x0 - far as gap from reach where far is not null)
select page_id, balloon_id, arg_max(gap, (gap, -pos))::int as gap, arg_max(pos, (gap, -pos))::int as "at", arg_max((far + x0) / 2, (gap, -pos)) as middle from gaps group by all""", "detections"))
def balloon_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.seams(_blocks(spark, sf_dir).where("balloon_id is not null"), ["page_id", "balloon_id"], "x0", "x1")


_DIVIDED = f"""
, cells(page_id, balloon_id, path, ord, det_id, x0, y0, x1, y1, bx0, by0, bx1, by1, cx0, cy0, cx1, cy1, n) as (
  select page_id, balloon_id, '', ord, det_id, x0, y0, x1, y1, bx0, by0, bx1, by1, 0, 0, {W}, {H}, count(*) over (partition by page_id, balloon_id) from blocks where balloon_id is not null
  union all
  select page_id, balloon_id, path, ord, det_id, x0, y0, x1, y1, bx0, by0, bx1, by1,
    case when on_x and not near then place else cx0 end::int, case when not on_x and not near then place else cy0 end::int,
    case when on_x and near then place else cx1 end::int, case when not on_x and near then place else cy1 end::int, count(*) over (partition by page_id, balloon_id, path)
  from (select *exclude(path), path || case when near then 'a' else 'b' end as path,
      case when on_x then least(greatest(mid, cx0 + 1), cx1 - 1) else least(greatest(mid, cy0 + 1), cy1 - 1) end as place
    from (select *, case when on_x then px < kx else py < ky end as near, max(case when on_x then case when px = kx then x0 + rx end else case when py = ky then y0 + ry end end) over g // 2 as mid
      from (select *, gx >= gy as on_x, min(case when x0 - rx = gx then px end) over g as kx, min(case when y0 - ry = gy then py end) over g as ky
        from (select *, max(x0 - rx) over g as gx, max(y0 - ry) over g as gy
          from (select *, row_number() over (partition by page_id, balloon_id, path order by x0, x1, ord) as px, row_number() over (partition by page_id, balloon_id, path order by y0, y1, ord) as py,
              max(x1) over (partition by page_id, balloon_id, path order by x0, x1, ord rows between unbounded preceding and 1 preceding) as rx,
              max(y1) over (partition by page_id, balloon_id, path order by y0, y1, ord rows between unbounded preceding and 1 preceding) as ry
            from cells where n > 1)
          window g as (partition by page_id, balloon_id, path))
        window g as (partition by page_id, balloon_id, path))
      window g as (partition by page_id, balloon_id, path)))),
kept as (select *, path <> '' as shared, case when path <> '' then greatest(bx0, cx0) else bx0 end as qx0, case when path <> '' then greatest(by0, cy0) else by0 end as qy0,
  case when path <> '' then greatest(bx0, cx0, least(bx1, cx1)) else bx1 end as qx1, case when path <> '' then greatest(by0, cy0, least(by1, cy1)) else by1 end as qy1 from cells where n = 1),
judged as (select *, not shared or (greatest(least(x1, qx1) - greatest(x0, qx0), 0) * greatest(least(y1, qy1) - greatest(y0, qy0), 0))::double / ((x1 - x0) * (y1 - y0)) >= 0.85 as holds from kept)
select page_id, ord, det_id, balloon_id, case when holds then qx0 end::int as rx0, case when holds then qy0 end::int as ry0, case when holds then qx1 end::int as rx1, case when holds then qy1 end::int as ry1 from judged"""


@query(with_views(_ANALYSED + _DIVIDED.strip(), "detections"))
def divide_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's own room cropped to its cell of the page; the balloon's box stands for the room that pixels would give."""
    own = _blocks(spark, sf_dir).select("*", *[F.col(f"b{e}").alias(f"r{e}") for e in r.EDGES])
    return space.divided(own, W, H)


@query(with_views(_ORDERED + " select page_id, case when ord = 1 then 3 when ord in (2, 3) then ord - 1 else ord end::int as ord, det_id, x0, y0, x1, y1 from ordered", "detections"))
def move_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.moved(_ordered(spark, sf_dir), F.lit(1), F.lit(3))


@query(with_views(_ORDERED + """, p as (select *, y1 - y0 >= x1 - x0 as tall, greatest(x1 - x0, y1 - y0) as side from ordered),
q as (select *, case when side < 24 then floor(side / 2 + 0.5) else least(greatest(floor(side * 0.5 + 0.5), 12), side - 12) end::int as cut from p)
select page_id, (ord + (ord > 2)::int)::int as ord, det_id, x0, y0, x1, y1 from ordered where ord <> 2
union all select page_id, 2, det_id, case when tall then x0 else x0 + cut end::int, y0, x1, case when tall then y0 + cut else y1 end::int from q where ord = 2
union all select page_id, 3, det_id, x0, case when tall then y0 + cut else y0 end::int, case when tall then x1 else x0 + cut end::int, y1 from q where ord = 2""", "detections"))
def split_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.split_at(_ordered(spark, sf_dir), F.lit(2))


@query(with_views(_ORDERED + """ select page_id, (ord + (ord >= 1)::int)::int as ord, det_id from ordered where page_id % 2 = 0
union all select page_id, ord, det_id from ordered where page_id % 2 = 1 union all select distinct page_id, 1, 0 from ordered where page_id % 2 = 0""", "detections"))
def insert_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(spark, sf_dir).select("page_id", "ord", "det_id")
    new = rows.where("page_id % 2 = 0").select("page_id", F.lit(1).alias("ord"), F.lit(0).alias("det_id")).distinct()
    return r.inserted(rows, new)


@query(with_views(_ANALYSED + "select page_id, ord, det_id, case when det_id % 2 <> 0 then balloon_id when det_id % 3 <> 0 then det_id + 1000 end::int as balloon_id from blocks", "detections"))
def update_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both sides are told from the blocks, which are analysed once
    rows = kept(_blocks(spark, sf_dir).select("page_id", "ord", "det_id", "balloon_id"), "blocks")
    news = rows.where("det_id % 2 = 0").select("page_id", "det_id", F.when(F.col("det_id") % 3 != 0, F.col("det_id") + 1000).cast("int").alias("balloon_id"))
    return r.updated(rows, news, ["page_id", "det_id"], "balloon_id")


@query(with_views("""select page_id, det_id, x0 + case when det_id % 10 = 0 then 3 when det_id % 5 = 0 then 1 else 0 end as x0, y0, x1 + case when det_id % 10 = 0 then 3 when det_id % 5 = 0 then 1 else 0 end as x1, y1,
  case when det_id % 6 = 0 then 200 + det_id when det_id % 5 = 0 then null when det_id % 2 = 0 and det_id % 3 <> 0 then 100 + det_id when det_id % 2 = 0 then null when det_id % 4 <> 0 then det_id end::int as room,
  case when page_id % 5 = 0 then null when det_id % 7 < 3 and det_id % 10 <> 0 then case when det_id % 7 = 1 then '' else 'r' || det_id end else 't' || det_id end as text,
  case when det_id % 3 = 0 then null when det_id % 4 = 1 then 'p' || det_id else 'l' || det_id end as lettered from detections""", "detections"))
def patched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box edits that clear rooms, answers asked for before and after them, pages that aren't read, slots without lettering, and regions that are gone."""
    # regions and patches are told from the detections, which are numbered once
    d = kept(detections(spark, sf_dir).select("page_id", "det_id", *r.EDGES), "detections")
    n, name = F.col("det_id"), lambda x: F.concat(F.lit(x), F.col("det_id").cast("string"))
    rows = d.select("page_id", "det_id", *r.EDGES, F.when(n % 4 != 0, n).alias("room"), F.when(F.col("page_id") % 5 != 0, name("t")).alias("text"), F.when(n % 3 != 0, name("l")).alias("lettered"))

    def patch(kind: str, seq: int, asked_at: int | None, when: Column, **sets: Column) -> Column:
        values = {e: F.col(e) for e in r.EDGES} | {"room": F.lit(None).cast("int"), "text": F.lit(None).cast("string"), "lettered": F.lit(None).cast("string")} | sets
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(seq).alias("seq"), F.lit(asked_at).cast("int").alias("asked_at"), *[v.alias(c) for c, v in values.items()]))

    def moved_by(k: int) -> dict[str, Column]:
        return {"x0": F.col("x0") + k, "x1": F.col("x1") + k}

    every = F.array(
        patch("box", 10, None, n % 5 == 0, **moved_by(1)), patch("box", 30, None, n % 10 == 0, **moved_by(3)),
        patch("room", 20, 5, n % 2 == 0, room=F.when(n % 3 != 0, n + 100)), patch("room", 40, 35, n % 6 == 0, room=n + 200),
        patch("reading", 21, 12, n % 7 < 3, text=F.when(n % 7 != 1, name("r"))), patch("lettering", 22, None, n % 4 == 1, lettered=name("p")),
    )
    patches = d.select("page_id", "det_id", F.explode(F.array_compact(every)).alias("p")).select("page_id", "det_id", "p.*")
    gone = patches.where("kind = 'room'").withColumn("det_id", F.col("det_id") + 100_000)
    return r.patched(rows, patches.unionByName(gone))


@query(with_views(_ANALYSED + "select page_id, count(*) as blocks, count(*) filter (confidence < 0.8) as excluded, count(*) filter (confidence >= 0.8 and coalesce(bx0, x0) < 400) as kept_left, to_json(list({'box': [x0, y0, x1, y1], 'kind': kind} order by ord))::varchar as regions from blocks group by 1", "detections"))
def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).withColumn("excluded", F.col("confidence") < r.UNSURE)
    room = F.coalesce("bx0", "x0")
    region = F.struct("ord", F.array(*r.EDGES).alias("box"), "kind")
    listed = F.transform(F.array_sort(F.collect_list(region)), lambda x: F.struct(x.box.alias("box"), x.kind.alias("kind")))
    return b.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded") & (room < 400)).alias("kept_left"), F.to_json(listed).alias("regions")
    )
