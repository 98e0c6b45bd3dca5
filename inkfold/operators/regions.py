"""Detected regions: thresholds, duplicate suppression, reading order, balloons and edits by ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.geometry import Box

CONFIDENCE = 0.35
DUPLICATE = 0.75
BLOCK_PAD, READ_PAD, LEAST_PAD = 0.04, 0.03, 2
INSIDE = 0.85
UNSURE = 0.8
SLIVER = 12
KINDS = {0: "bubble", 1: "speech", 2: "free"}
EDGES = ["x0", "y0", "x1", "y1"]


def kind(label: Column) -> Column:
    """The name of a class; null for classes that aren't known."""
    return F.when(label == 0, KINDS[0]).when(label == 1, KINDS[1]).when(label == 2, KINDS[2])


def confident(detections: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    return detections.where(F.col("score") >= least)


def on_page(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes clipped to the page, without those that are left a pixel wide or high at most."""
    box = Box.of().clipped(width, height)
    return boxes.withColumns(dict(zip(EDGES, box.columns()))).where("x1 - x0 > 1 and y1 - y0 > 1")


def _box(b: Column) -> Box:
    return Box(*[b[e] for e in EDGES])


def _kept(entries: Column, duplicate: float) -> Column:
    """Greedy suppression of an array that is sorted by falling score: a box stays if it covers no kept box too far."""
    return F.aggregate(
        entries,
        F.filter(entries, lambda b: F.lit(False)),
        lambda kept, b: F.when(F.exists(kept, lambda k: _box(k).covers_share(_box(b), duplicate)), kept).otherwise(F.concat(kept, F.array(b))),
    )


def suppressed(boxes: DataFrame, group: list[str], duplicate: float = DUPLICATE) -> DataFrame:
    """Greedy duplicate suppression in each group: by falling score, a box stays if it covers no kept box too far.

    A group is one detector pass over one page, a few hundred boxes at most, so it is folded as an array.
    """
    rest = [c for c in boxes.columns if c not in (*group, "score", "det_id")]
    entry = F.struct((-F.col("score")).alias("worse"), F.col("det_id"), *rest)
    gathered = boxes.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    out = gathered.select(*group, F.explode(_kept(F.col("all"), duplicate)).alias("b"))
    return out.select(*group, (-F.col("b.worse")).alias("score"), "b.det_id", *[f"b.{c}" for c in rest]).select(boxes.columns)


def padded(boxes: DataFrame, share: float, width: int, height: int) -> DataFrame:
    return boxes.withColumns(dict(zip(EDGES, Box.of().padded(share, LEAST_PAD, width, height).columns())))


def reading_key(rtl: bool) -> list[Column]:
    """Top first; on one height from the right, or from the left."""
    return [F.col("y0"), -F.col("x1") if rtl else F.col("x0")]


def in_reading_order(boxes: DataFrame, rtl: bool, page: str = "page_id") -> DataFrame:
    """Adds ord, from 0."""
    order = Window.partitionBy(page).orderBy(*reading_key(rtl), F.col("score").desc(), "det_id")
    return boxes.withColumn("ord", F.row_number().over(order) - 1)


def insertion_points(boxes: DataFrame, ordered: DataFrame, rtl: bool) -> DataFrame:
    """Where each box goes in its page's order: before the first that is strictly after it, else at the end."""
    key = F.struct(F.col("y0"), (-F.col("x1") if rtl else F.col("x0")).alias("x"))
    mine = boxes.select("page_id", "det_id", key.alias("mine"))
    theirs = ordered.select("page_id", "ord", key.alias("key"))
    n = F.count("ord")
    first = F.min(F.when(F.col("key") > F.col("mine"), F.col("ord")))
    return mine.join(theirs, "page_id", "left").groupBy("page_id", "det_id").agg(F.coalesce(first, n).cast("int").alias("at"))


def assigned(blocks: DataFrame, balloons: DataFrame, inside: float = INSIDE) -> DataFrame:
    """Adds to each block the smallest balloon that holds it (bx0..by1, balloon_id), or nulls.

    Equal page ids make this a hash join with the containment test on top.
    """
    b = balloons.select("page_id", F.col("det_id").alias("balloon_id"), *[F.col(e).alias(f"b{e}") for e in EDGES])
    holds = Box.of().within(Box.of("b")) >= inside
    found = (
        blocks.join(b, "page_id").where(holds).groupBy("page_id", "det_id")
        .agg(F.min(F.struct(Box.of("b").area.alias("area"), "balloon_id", *[f"b{e}" for e in EDGES])).alias("b"))
        .select("page_id", "det_id", "b.balloon_id", *[f"b.b{e}" for e in EDGES])
    )
    return blocks.join(found, ["page_id", "det_id"], "left")


def analysed(detections: DataFrame, width: int, height: int, rtl: bool = True) -> DataFrame:
    """From raw detector rows to text blocks in reading order, each with its balloon.

    A page is gathered once; suppression, order and balloons are folds over its two arrays, so one exchange by
    page is all there is. A page is one detector pass.
    """
    sure = on_page(confident(detections), width, height)
    entry = F.struct((-F.col("score")).alias("worse"), "det_id", "label", *EDGES)
    pages = sure.groupBy("page_id").agg(*[F.array_sort(F.collect_list(F.when(own, entry))).alias(name) for name, own in (("balloons", F.col("label") == 0), ("texts", F.col("label") != 0))])
    pages = pages.select("page_id", *[_kept(F.col(name), DUPLICATE).alias(name) for name in ("balloons", "texts")])

    def block(b: Column) -> Column:
        box = _box(b).padded(BLOCK_PAD, LEAST_PAD, width, height)
        places = dict(zip(EDGES, box.columns()))
        across = -places["x1"] if rtl else places["x0"]
        return F.struct(places["y0"].alias("top"), across.alias("across"), b.worse.alias("worse"), b.det_id.alias("det_id"), b.label.alias("label"), F.struct(*[c.alias(e) for e, c in places.items()]).alias("box"))

    def holder(b: Column) -> Column:
        holds = F.filter("balloons", lambda k: _box(b.box).within(_box(k)) >= INSIDE)
        return F.array_min(F.transform(holds, lambda k: F.struct(_box(k).area.alias("area"), k.det_id.alias("balloon_id"), *[k[e].alias(f"b{e}") for e in EDGES])))

    ordered = pages.select("page_id", "balloons", F.array_sort(F.transform("texts", block)).alias("texts"))
    blocks = ordered.select("page_id", F.posexplode(F.transform("texts", lambda b: F.struct(b.alias("b"), holder(b).alias("k")))).alias("ord", "x"))
    return blocks.select(
        "page_id", "ord", "x.b.det_id", kind(F.col("x.b.label")).alias("kind"), F.round(-F.col("x.b.worse"), 3).alias("confidence"), *[f"x.b.box.{e}" for e in EDGES], "x.k.balloon_id", *[f"x.k.b{e}" for e in EDGES]
    )


def seams(members: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """The widest gap between neighbours along one axis: gap and the place it ends, the first of equals.

    A gap is the next start less the furthest end so far, and may be negative.
    """
    order = Window.partitionBy(*group).orderBy(low, high, "det_id")
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = F.row_number().over(order)
    gaps = members.select(*group, at.alias("at"), (F.col(low) - reach).alias("gap"), reach.alias("reach"), F.col(low).alias("start")).where("gap is not null")
    best = F.max_by(F.struct("gap", "at", "reach", "start"), F.struct("gap", -F.col("at")))
    return gaps.groupBy(*group).agg(best.alias("b")).select(*group, "b.gap", "b.at", ((F.col("b.reach") + F.col("b.start")) / 2).alias("middle"))


# Edits of an ordered list of regions, for all pages at once


def moved(rows: DataFrame, source: Column, target: Column) -> DataFrame:
    """The row at `source` goes to `target`; those between close up."""
    o = F.col("ord")
    return rows.withColumn(
        "ord",
        F.when(o == source, target)
        .when((source < target) & (o > source) & (o <= target), o - 1)
        .when((source > target) & (o < source) & (o >= target), o + 1)
        .otherwise(o)
        .cast("int"),
    )


def split_at(rows: DataFrame, at: Column, share: float = 0.5, rtl: bool = True) -> DataFrame:
    """The row at `at` becomes two, halved along its longer side; the second has its other columns; later rows shift."""
    first, second = Box.of().halves(share, SLIVER, rtl)
    hit = F.col("ord") == at
    here = F.when(hit, F.array(F.struct(F.col("ord").alias("o"), *first.columns()), F.struct((F.col("ord") + 1).alias("o"), *second.columns())))
    same = F.array(F.struct((F.col("ord") + (F.col("ord") > at).cast("int")).alias("o"), *Box.of().columns()))
    parts = rows.withColumn("part", F.explode(here.otherwise(same)))
    keep = [c for c in rows.columns if c not in (*EDGES, "ord")]
    return parts.select(*keep, F.col("part.o").cast("int").alias("ord"), *[f"part.{e}" for e in EDGES]).select(rows.columns)


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """new rows (with page_id and ord) go in before the row at their ord; at most one a page."""
    at = new.select("page_id", F.col("ord").alias("at"))
    shifted = rows.join(at, "page_id", "left").withColumn("ord", F.when(F.col("ord") >= F.col("at"), F.col("ord") + 1).otherwise(F.col("ord")).cast("int"))
    return shifted.drop("at").unionByName(new.select(rows.columns))


def updated(rows: DataFrame, news: DataFrame, key: list[str], column: str) -> DataFrame:
    """column of the rows asked about is replaced, also by null; keys that aren't there are ignored."""
    n = news.select(*key, F.col(column).alias("new_value"), F.lit(True).alias("asked"))
    return rows.join(n, key, "left").withColumn(column, F.when(F.col("asked"), F.col("new_value")).otherwise(F.col(column))).select(rows.columns)


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """rows after all patches: edits by hand, and answers that may have been asked for before the last of them.

    rows: page_id, det_id, the edges, room, text (null on pages that aren't read yet) and lettered (null if there is no
    lettering), and further columns. patches: page_id, det_id, seq, kind, asked_at (the seq at which an answer was asked
    for), and the edges, room, text and lettered that a kind sets. The last of a kind counts:

    - `box` sets the edges and clears the room, which no longer fits;
    - `room` and `reading` answers from before the last box edit are stale and ignored; a null room that isn't counts,
      a null text counts as '', and pages that aren't read stay so;
    - `lettering` changes a lettering that is there;
    - patches of regions that are gone are ignored.
    """
    key = ["page_id", "det_id"]
    box_at = F.max(F.when(F.col("kind") == "box", F.col("seq"))).over(Window.partitionBy(*key))
    known = patches.withColumn("box_at", box_at).withColumn("fresh", F.col("box_at").isNull() | (F.col("asked_at") >= F.col("box_at")))
    last = lambda kind, when, *values: F.max_by(F.struct(*values), F.when((F.col("kind") == kind) & when, F.col("seq"))).alias(kind)
    every = F.lit(True)
    told = known.groupBy(*key).agg(last("box", every, *EDGES), last("room", F.col("fresh"), "room"), last("reading", F.col("fresh"), "text"), last("lettering", every, "lettered"))
    told = told.select(*key, *[F.col(c).alias(f"new_{c}") for c in ("box", "room", "reading", "lettering")])
    out = rows.join(told, key, "left")
    box, room, reading, lettering = (F.col(f"new_{c}") for c in ("box", "room", "reading", "lettering"))
    changed = {e: F.coalesce(box[e], e) for e in EDGES} | {
        "room": F.when(room.isNotNull(), room.room).when(box.isNull(), F.col("room")),
        "text": F.when(F.col("text").isNotNull() & reading.isNotNull(), F.coalesce(reading.text, F.lit(""))).otherwise(F.col("text")),
        "lettered": F.when(F.col("lettered").isNotNull() & lettering.isNotNull(), lettering.lettered).otherwise(F.col("lettered")),
    }
    return out.withColumns(changed).select(rows.columns)


def toggled(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """rows (page_id, det_id, excluded and others) with excluded turned once for each pick of a region; picks of others are ignored."""
    turns = picks.groupBy("page_id", "det_id").agg((F.count("*") % 2 == 1).alias("turn"))
    turn = F.coalesce("turn", F.lit(False))
    return rows.join(turns, ["page_id", "det_id"], "left").withColumn("excluded", F.col("excluded") != turn).select(rows.columns)
