"""Setting text into boxes: greedy wrapping, the largest size that fits, and where one block is really several."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.functions.raster import Box, bounds

LINE_HEIGHT = 1.15
SIZE_MIN, SIZE_MAX = 6, 200
GAP, GAP_ALONE, GAP_STAGGERED, STAGGER, DEEP, GAP_MIN = 0.8, 1.5, 0.3, 0.5, 2.5, 8


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _filled(pieces: Column, text: Callable[[Column], Column], joins: Callable[[Column, Column], Column]) -> Column:
    """Pieces set one after the other, as lines joined by line breaks; joins(used, piece): whether it goes on a line that has `used` characters.

    The state is the text and how long its last line is, so that line is never searched for.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        goes_on = (acc.used > 0) & joins(acc.used, x)
        between = F.when(acc.used == 0, "").when(goes_on, " ").otherwise("\n")
        return F.struct(F.concat(acc.text, between, text(x)).alias("text"), (F.length(text(x)) + F.when(goes_on, acc.used + 1).otherwise(0)).alias("used"))

    return F.aggregate(pieces, start, step, lambda acc: acc.text)


def wrapped(text: Column, most: Column) -> Column:
    """Lines of at most `most` characters, filled word by word and joined by line breaks; a longer word has a line of its own."""
    return _filled(words(text), lambda w: w, lambda used, w: used + 1 + F.length(w) <= most)


def hyphenated(text: Column, most: Column) -> Column:
    """Paragraphs wrapped one by one, blank ones left out; a word longer than a line is cut, with hyphens, on lines of its own."""

    def pieces(w: Column) -> Column:
        last = F.floor((F.length(w) - 1) / (most - 1)).cast("int")
        cut = lambda i: F.concat(F.substring(w, i * (most - 1) + 1, most - 1), F.when(i < last, "-").otherwise(""))
        long = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(cut(i).alias("text"), F.lit(True).alias("opens")))
        return F.when(F.length(w) > most, long).otherwise(F.array(F.struct(w.alias("text"), F.lit(False).alias("opens"))))

    joins = lambda used, x: ~x.opens & (used + 1 + F.length(x.text) <= most)
    lines = F.transform(F.split(t.strip(text), "\n"), lambda p: _filled(F.flatten(F.transform(words(p), pieces)), lambda x: x.text, joins))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def line_count(lengths: Column, most: Column, hyphens: bool = False) -> Column:
    """How many lines words of these lengths take. hyphens: longer ones are cut into lines of their own."""
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc.lines > 0) & (acc.used + 1 + n <= most)
        whole = F.struct(F.when(fits, acc.lines).otherwise(acc.lines + 1).alias("lines"), F.when(fits, acc.used + 1 + n).otherwise(n).alias("used"))
        if not hyphens:
            return whole
        parts = F.ceil(n / (most - 1)).cast("int")
        return F.when(n > most, F.struct((acc.lines + parts).alias("lines"), (n - (parts - 1) * (most - 1)).alias("used"))).otherwise(whole)

    return F.aggregate(lengths, start, step, lambda acc: acc.lines)


def largest_size(w: Column, h: Column, low: int = SIZE_MIN, high: int = SIZE_MAX, char_width: float = 0.5, hyphens: bool = False) -> Column:
    """The largest size at which no word is too wide and all lines fit; `low` if none does. The words are their lengths, in word_lengths.

    hyphens: if no size does with whole words, the largest at which words may be cut is tried. What fits at a size
    fits at every smaller one, so the sizes are searched by halves.
    """

    def fits(size: Column) -> Column:
        most = F.floor(w / (size * char_width)).cast("int")
        return (F.array_max("word_lengths") <= most) & (line_count(F.col("word_lengths"), most) * size * LINE_HEIGHT <= h)

    def fits_cut(size: Column) -> Column:
        most = F.floor(w / (size * char_width)).cast("int")
        return (most >= 2) & (line_count(F.col("word_lengths"), F.greatest(most, F.lit(2)), True) * size * LINE_HEIGHT <= h)

    def largest(f: Callable[[Column], Column]) -> Column:
        """Null if no size fits. The state holds the largest that is known to fit (low - 1 at first) and the largest that may."""

        def step(acc: Column, _: Column) -> Column:
            middle = F.floor((acc.low + acc.high + 1) / 2).cast("int")
            # each size is tried once
            tried = F.transform(F.array(middle), lambda m: F.struct(m.alias("size"), (f(m) & (acc.low < acc.high)).alias("fits")))
            halves = F.transform(tried, lambda x: F.struct(F.when(x.fits, x["size"]).otherwise(acc.low).alias("low"), F.when(x.fits | (acc.low >= acc.high), acc.high).otherwise(x["size"] - 1).alias("high")))
            return F.get(halves, 0)

        start = F.struct(F.lit(low - 1).alias("low"), F.lit(high).alias("high"))
        steps = F.sequence(F.lit(1), F.lit((high - low + 1).bit_length()))
        return F.aggregate(steps, start, step, lambda acc: F.when(acc.low >= low, acc.low))

    return F.coalesce(*[largest(f) for f in ((fits, fits_cut) if hyphens else (fits,))], F.lit(low))


def _blank_runs(used: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of blanks between used places."""
    at = np.flatnonzero(used)
    return [(int(a) + 1, int(b - a - 1)) for a, b in zip(at, at[1:]) if b - a > 1]


def _staggered(ink: np.ndarray, axis: int, start: int, end: int, em: float) -> bool:
    """Whether the two sides of a blank are set off from each other the same way at both ends."""
    one, two = (ink[:, :start], ink[:, end:]) if axis == 0 else (ink[:start], ink[end:])
    side = 1 if axis == 0 else 0
    a, b = np.flatnonzero(one.any(side)), np.flatnonzero(two.any(side))
    first, last = b[0] - a[0], b[-1] - a[-1]
    return bool(first * last > 0 and min(abs(first), abs(last)) >= STAGGER * em)


def split_blocks(ink: np.ndarray, em: float) -> list[Box]:
    """The parts of a block that wide blanks keep apart, cut at the widest first; the ink's own box if there are none.

    A blank must be 0.8 of a character wide if the block is 2.5 characters deep along it, else 1.5; 0.3 will do
    between staggered sides. Never less than 8 pixels.
    """
    box = bounds(ink)
    if box is None:
        return []
    x0, y0, x1, y1 = box
    own = ink[y0:y1, x0:x1] > 0
    choices = []
    for axis in (0, 1):
        depth = own.shape[0 if axis == 0 else 1]
        for start, length in _blank_runs(own.any(axis)):
            need = GAP if depth >= DEEP * em else GAP_ALONE
            if _staggered(own, axis, start, start + length, em):
                need = GAP_STAGGERED
            if length >= max(GAP_MIN, round(need * em)):
                choices.append((length, -axis, -start))
    if not choices:
        return [box]
    length, axis, start = max(choices)
    cut = -start + length // 2
    parts = [(own[:, :cut], 0, 0), (own[:, cut:], cut, 0)] if axis == 0 else [(own[:cut], 0, 0), (own[cut:], 0, cut)]
    return [(x0 + dx + a, y0 + dy + b, x0 + dx + c, y0 + dy + d) for part, dx, dy in parts for a, b, c, d in split_blocks(part, em)]


def strokes(shape: tuple[int, int], points: list[tuple[float, float]], radius: float) -> np.ndarray:
    """A brush mask: a dot at each point and a band between neighbours."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] or points):
        dx, dy = bx - ax, by - ay
        long = dx * dx + dy * dy
        t = np.clip(((xs - ax) * dx + (ys - ay) * dy) / long, 0, 1) if long else np.zeros(shape)
        out |= (xs - ax - t * dx) ** 2 + (ys - ay - t * dy) ** 2 <= radius * radius
    return np.where(out, 255, 0).astype(np.uint8)
