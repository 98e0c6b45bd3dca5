"""Boxes as four columns x0, y0, x1, y1 (ends exclusive), and expressions over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("int")


def even_round(x: Column) -> Column:
    """Half to even."""
    return F.rint(x.cast("double")).cast("int")


def bounded(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if isinstance(low, int) else low), F.lit(high) if isinstance(high, int) else high)


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(f"{prefix}{n}") for n, c in zip(("x0", "y0", "x1", "y1"), (self.x0, self.y0, self.x1, self.y1))]

    @property
    def w(self) -> Column:
        return self.x1 - self.x0

    @property
    def h(self) -> Column:
        return self.y1 - self.y0

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    def clipped(self, width: int, height: int) -> Box:
        return Box(bounded(self.x0, 0, width), bounded(self.y0, 0, height), bounded(self.x1, 0, width), bounded(self.y1, 0, height))

    def moved(self, dx, dy) -> Box:
        return Box(self.x0 + dx, self.y0 + dy, self.x1 + dx, self.y1 + dy)

    def grown(self, n) -> Box:
        return Box(self.x0 - n, self.y0 - n, self.x1 + n, self.y1 + n)

    def shorter(self) -> Column:
        return F.least(self.w, self.h)

    def padded(self, share: float, least: int, width: int, height: int) -> Box:
        """Grown by a share of the shorter side, by `least` at least, inside the page."""
        return self.grown(F.greatest(F.lit(least), even_round(self.shorter() * share))).clipped(width, height)

    def shrunk(self, share: float) -> Box:
        """Inset by a share of the shorter side; a box that would vanish stays as it is."""
        n = F.greatest(F.lit(1), even_round(self.shorter() * share))
        fits = (self.w > 2 * n) & (self.h > 2 * n)
        inset = self.grown(-n)
        return Box(*[F.when(fits, a).otherwise(b) for a, b in zip((inset.x0, inset.y0, inset.x1, inset.y1), (self.x0, self.y0, self.x1, self.y1))])

    def cropped(self, to: Box) -> Box:
        """The part inside `to`; may be empty, never negative."""
        x0, y0 = F.greatest(self.x0, to.x0), F.greatest(self.y0, to.y0)
        return Box(x0, y0, F.greatest(x0, F.least(self.x1, to.x1)), F.greatest(y0, F.least(self.y1, to.y1)))

    def shared_area(self, other: Box) -> Column:
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

    def covers(self, other: Box) -> Column:
        """Shared area over the smaller area; the same both ways."""
        return F.coalesce(F.try_divide(self.shared_area(other), F.least(self.area, other.area)), F.lit(0.0))

    def covers_share(self, other: Box, share: float) -> Column:
        """covers(other) >= share, without a division."""
        shared = self.shared_area(other)
        return (shared > 0) & (shared >= share * F.least(self.area, other.area))

    def within(self, other: Box) -> Column:
        """Share of this box that lies in the other."""
        return F.coalesce(F.try_divide(self.shared_area(other), self.area), F.lit(0.0))

    def cut_place(self, share: float, away: int) -> Column:
        """Where to cut along the longer side: `away` from either end, or in the middle of a short box."""
        side = F.greatest(self.w, self.h)
        at = bounded(js_round(side * share), away, side - away)
        return F.when(side < 2 * away, js_round(side / 2)).otherwise(at)

    def halves(self, share: float, away: int, rtl: bool) -> tuple[Box, Box]:
        """Two boxes in reading order: above and below if the box is as high as wide, else beside each other."""
        at, tall = self.cut_place(share, away), self.h >= self.w
        low = Box(self.x0, self.y0, F.when(tall, self.x1).otherwise(self.x0 + at), F.when(tall, self.y0 + at).otherwise(self.y1))
        high = Box(F.when(tall, self.x0).otherwise(self.x0 + at), F.when(tall, self.y0 + at).otherwise(self.y0), self.x1, self.y1)
        if not rtl:
            return low, high
        pick = lambda a, b: Box(*[F.when(tall, x).otherwise(y) for x, y in zip((a.x0, a.y0, a.x1, a.y1), (b.x0, b.y0, b.x1, b.y1))])
        return pick(low, high), pick(high, low)


def box_from_values(values: Column, width: int, height: int) -> Box:
    """Four numbers, as strings or numbers: rounded half to even, corners in order, inside the page. Null if one isn't a number."""
    n = F.transform(values, lambda v: F.rint(v.try_cast("double")))
    xs, ys = F.array(n[0], n[2]), F.array(n[1], n[3])
    ok = (F.size(values) == 4) & ~F.exists(n, lambda v: v.isNull())
    box = Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).clipped(width, height)
    return Box(*[F.when(ok, edge).cast("int") for edge in (box.x0, box.y0, box.x1, box.y1)])


def working_size(w: Column, h: Column, most: int = 1_000_000, least: int = 8) -> tuple[Column, Column]:
    """Sides scaled down until the area is at most `most`; neither side under `least`."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (w * h)))
    return F.greatest(F.lit(least), even_round(w * scale)), F.greatest(F.lit(least), even_round(h * scale))


def letterbox(w: Column, h: Column, side: int) -> tuple[Column, Column, Column]:
    """Scale, right pad and bottom pad that fit a page into a square."""
    scale = F.least(F.lit(float(side)) / h, F.lit(float(side)) / w)
    return scale, F.lit(side) - even_round(w * scale), F.lit(side) - even_round(h * scale)


def turned(dx: Column, dy: Column, degrees: Column) -> tuple[Column, Column]:
    """A screen delta in the frame of a box turned by `degrees`."""
    a = F.radians(degrees)
    return dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a)


def anchored(was: Box, now: Box, degrees: Column) -> Box:
    """A turned box after it was resized: moved so that the corner that wasn't dragged stays where it is drawn."""
    x, y = was.cx - now.cx, was.cy - now.cy
    drawn_x, drawn_y = turned(x, y, -degrees)
    return now.moved(x - drawn_x, y - drawn_y)


def angle(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))
