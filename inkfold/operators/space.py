"""Dividing a page among the blocks that share a balloon, and each block's own room in its part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions import raster
from inkfold.functions.geometry import Box
from inkfold.operators.regions import INSIDE

Cell = tuple[int, int, int, int]


def _widest(spans: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(gap, how many come before it, its middle) of the widest gap among sorted spans, the first of equals; overlaps are gaps below zero."""
    best, reach = None, spans[0][1]
    for place, (low, high) in enumerate(spans[1:], 1):
        if best is None or low - reach > best[0]:
            best = (low - reach, place, (low + reach) // 2)
        reach = max(reach, high)
    return best


def divide(space: Cell, blocks: list[Cell]) -> list[Cell]:
    """A cell of the space for each block: cut at the widest gap of either axis, x on a tie, until each is alone.

    The cells are disjoint and cover the space. A cut stays a pixel inside the space at least.
    """
    cells, open_ = [space] * len(blocks), [(space, list(range(len(blocks))))]
    while open_:
        cell, ids = open_.pop()
        if len(ids) < 2:
            cells[ids[0] if ids else slice(0)] = cell
            continue
        by_axis = [sorted(ids, key=lambda i: (blocks[i][axis], blocks[i][axis + 2], i)) for axis in (0, 1)]
        gaps = [_widest([(blocks[i][axis], blocks[i][axis + 2]) for i in by_axis[axis]]) for axis in (0, 1)]
        axis = 0 if gaps[0][0] >= gaps[1][0] else 1
        _, before, middle = gaps[axis]
        at = min(max(middle, cell[axis] + 1), cell[axis + 2] - 1)
        near, far = list(cell), list(cell)
        near[axis + 2] = far[axis] = at
        open_ += [(tuple(near), by_axis[axis][:before]), (tuple(far), by_axis[axis][before:])]
    return cells


def divided(blocks: DataFrame, width: int, height: int, every: bool = False) -> DataFrame:
    """Each block's own room (columns r<edge>): as it is if the block is alone in its balloon, else cropped to the block's cell of the page.

    Null where what is left doesn't hold the block. blocks: page_id, ord, det_id, balloon_id, x0..y1, rx0..ry1. A row
    of the inner table is one balloon with its few blocks, so a batch divides many balloons. every: blocks without a room
    (nulls in rx0..ry1) have a part in the division too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            boxes = [[tuple(map(int, m["box"])) for m in members] for members in frame["members"]]
            yield frame[["page_id", "balloon_id"]].assign(cells=[divide((0, 0, width, height), b) for b in boxes], members=frame["members"])

    inner = "members: array<struct<ord: int, det_id: int, box: array<int>, room: array<int>>>"
    member = F.struct("ord", "det_id", F.array("x0", "y0", "x1", "y1").alias("box"), F.array("rx0", "ry0", "rx1", "ry1").alias("room"))
    gathered = blocks.where("balloon_id is not null" + ("" if every else " and rx0 is not null")).groupBy("page_id", "balloon_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    cells = gathered.mapInPandas(run, f"page_id long, balloon_id int, cells array<array<int>>, {inner}")
    each = cells.select("page_id", "balloon_id", (F.size("members") > 1).alias("shared"), F.explode(F.arrays_zip("cells", "members")).alias("z"))
    room, cell, block = (Box(*[F.col(f"z.{name}")[i] for i in range(4)]) for name in ("members.room", "cells", "members.box"))
    # a crop of nothing would be the cell
    own = Box(*[F.when(F.col("shared") & b.isNotNull(), a).otherwise(b) for a, b in zip(room.cropped(cell).columns(), room.columns())])
    placed = each.select("page_id", "z.members.ord", "z.members.det_id", "balloon_id", "shared", *own.columns("r"), *block.columns("b"))
    holds = ~F.col("shared") | (Box.of("b").within(Box.of("r")) >= INSIDE)
    return placed.select("page_id", "ord", "det_id", "balloon_id", *[F.when(holds, F.col(e)).alias(e) for e in ("rx0", "ry0", "rx1", "ry1")])


def room_inside(grey: np.ndarray, balloon: Cell, block: Cell, least: int = 4) -> Cell | None:
    """The room around a block on the pixels of its balloon; null if the block isn't all in it, or either is too small."""
    height, width = grey.shape
    x0, y0, x1, y1 = (min(max(v, 0), most) for v, most in zip(balloon, (width, height, width, height)))
    own = tuple(min(max(v, 0), most) - off for v, most, off in zip(block, (width, height, width, height), (x0, y0, x0, y0)))
    if min(x1 - x0, y1 - y0, own[2] - own[0], own[3] - own[1]) < least or min(own[:2]) < 0 or own[2] > x1 - x0 or own[3] > y1 - y0:
        return None
    found = raster.room(grey[y0:y1, x0:x1], own)
    return found and (found[0] + x0, found[1] + y0, found[2] + x0, found[3] + y0)


def rooms(pages: DataFrame, blocks: DataFrame, width: int, height: int) -> DataFrame:
    """blocks with the room that each goes in (columns rx0..ry1), found on the pixels of its balloon.

    pages: page_id and grey, a byte for each pixel, row by row. blocks: page_id, ord, det_id, balloon_id, x0..y1, bx0..by1. Where
    blocks share a balloon each has its own room cropped to its cell of the page. Null without a balloon, or where
    the balloon has nothing more to offer. A page meets its blocks once, as one row.
    """
    member = F.struct("ord", "det_id", "balloon_id", F.array("x0", "y0", "x1", "y1").alias("box"), F.array("bx0", "by0", "bx1", "by1").alias("balloon"))
    asked = blocks.where("balloon_id is not null").groupBy("page_id").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, data, members in zip(frame["page_id"], frame["grey"], frame["members"]):
                grey = np.frombuffer(data, np.uint8).reshape(height, width)
                for m in members:
                    box, balloon = tuple(map(int, m["box"])), tuple(map(int, m["balloon"]))
                    room = room_inside(grey, balloon, box)
                    if room:
                        out.append((page, m["ord"], m["det_id"], m["balloon_id"], *box, *room))
            yield pd.DataFrame(out, columns=["page_id", "ord", "det_id", "balloon_id", "x0", "y0", "x1", "y1", "rx0", "ry0", "rx1", "ry1"])

    kinds = "page_id long, ord int, det_id int, balloon_id int, x0 int, y0 int, x1 int, y1 int, rx0 int, ry0 int, rx1 int, ry1 int"
    found = pages.select("page_id", "grey").join(asked, "page_id").mapInPandas(run, kinds)
    # a balloon is shared by all of its blocks, those without a room of their own too
    every = blocks.where("balloon_id is not null").select("page_id", "ord", "det_id", "balloon_id", "x0", "y0", "x1", "y1")
    told = every.join(found.select("page_id", "det_id", "rx0", "ry0", "rx1", "ry1"), ["page_id", "det_id"], "left")
    own = divided(told, width, height, every=True).select("page_id", "det_id", "rx0", "ry0", "rx1", "ry1")
    return blocks.join(own, ["page_id", "det_id"], "left")
