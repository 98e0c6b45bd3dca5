"""Whole masks and pages as numpy arrays, for use inside tasks.

Definitions are this library's own and deterministic; they make no claim to equal any imaging library's
rounding or interpolation.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

Box = tuple[int, int, int, int]


def rasterised(shape: tuple[int, int], boxes: list[Box], brush: np.ndarray | None = None) -> np.ndarray:
    """255 inside the boxes (ends exclusive), with a brush mask laid over."""
    out = np.zeros(shape, np.uint8)
    for x0, y0, x1, y1 in boxes:
        out[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)] = 255
    return out if brush is None else np.maximum(out, brush)


def dilated(mask: np.ndarray, n: int, round_: bool = False) -> np.ndarray:
    """The maximum over all places at most n rows and columns away, or in a disc of radius n."""
    if n <= 0:
        return mask.copy()
    padded = np.pad(mask, n)
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy in range(-n, n + 1):
        for dx in range(-n, n + 1):
            if not round_ or dx * dx + dy * dy <= n * n:
                np.maximum(out, padded[n + dy : n + dy + h, n + dx : n + dx + w], out=out)
    return out


def labelled(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in order of their first pixel, 0 elsewhere. corners: also joined diagonally."""
    h, w = mask.shape
    on = mask > 0
    label = np.where(on, np.arange(h * w).reshape(h, w), h * w)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    while True:
        before = label.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
            both = on[a] & on[b]
            low = np.minimum(label[a], label[b])
            label[a] = np.where(both, low, label[a])
            label[b] = np.where(both, np.minimum(low, label[b]), label[b])
        flat = np.append(label.ravel(), h * w)
        label = np.where(on, flat[label], h * w)
        if (label == before).all():
            break
    roots = np.unique(label[on])
    out = np.zeros((h, w), np.int32)
    out[on] = np.searchsorted(roots, label[on]) + 1
    return out, len(roots)


def bounds(mask: np.ndarray) -> Box | None:
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None


def solid(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes filled: all that can't be reached from outside."""
    ground, _ = labelled((np.pad(mask, 1) == 0).astype(np.uint8), corners=False)
    return np.where(ground[1:-1, 1:-1] != ground[0, 0], 255, 0).astype(np.uint8)


def joined(ground: np.ndarray, seed: Box) -> np.ndarray:
    """The seed box with all pieces of ground that it overlaps or borders on, without holes."""
    x0, y0, x1, y1 = seed
    pieces, _ = labelled(ground, corners=False)
    beside = (pieces[max(y0 - 1, 0) : y1 + 1, x0:x1], pieces[y0:y1, max(x0 - 1, 0) : x1 + 1])
    own = np.setdiff1d(np.concatenate([x.ravel() for x in beside]), [0])
    return solid(rasterised(ground.shape, [seed], np.where(np.isin(pieces, own), 255, 0).astype(np.uint8)))


def _run(values: np.ndarray) -> int:
    """How many of the first values hold."""
    return len(values) if values.all() else int(np.argmin(values))


def _largest(on: np.ndarray, block: Box) -> Box | None:
    x0, y0, x1, y1 = block
    if x1 <= x0 or y1 <= y0 or not on[y0:y1, x0:x1].all():
        return None
    # how far each row reaches left and right of the block, and how many whole rows there are above and below it
    left = np.where(on[:, :x0].all(1), x0, np.argmin(on[:, :x0][:, ::-1], 1) if x0 else 0)
    right = np.where(on[:, x1:].all(1), on.shape[1] - x1, np.argmin(on[:, x1:], 1) if x1 < on.shape[1] else 0)
    full = on[:, x0:x1].all(1)
    above, below = _run(full[:y0][::-1]), _run(full[y1:])

    def reach(side: np.ndarray) -> np.ndarray:
        """Of the rows from each top to each end, the least reach."""
        band = side[y0:y1].min()
        tops = np.minimum.accumulate(np.append(band, side[y0 - above : y0][::-1]))[::-1]
        ends = np.minimum.accumulate(np.append(band, side[y1 : y1 + below]))
        return np.minimum(tops[:, None], ends)

    l, r = reach(left), reach(right)
    height = (y1 - y0) + np.arange(above, -1, -1)[:, None] + np.arange(below + 1)
    top, end = np.unravel_index(np.argmax((l + r + x1 - x0) * height), l.shape)
    return (int(x0 - l[top, end]), int(y0 - above + top), int(x1 + r[top, end]), int(y1 + end))


def holding(mask: np.ndarray, block: Box, grid: int = 128) -> Box | None:
    """The largest rectangle of set pixels that holds the block; the first in reading order of equals; null if a pixel of the block isn't set.

    A mask with more than `grid` pixels to a side is searched in coarse cells: set ones are set all over, and the
    block takes all that it touches. Where the block isn't whole in them, pixels are searched.
    """
    on, size = mask > 0, -(-max(mask.shape) // grid)
    if size > 1:
        high, wide = (-(-n // size) for n in on.shape)
        # what is beyond the page doesn't hinder the cells at its edge
        whole = np.ones((high * size, wide * size), bool)
        whole[: on.shape[0], : on.shape[1]] = on
        coarse = whole.reshape(high, size, wide, size).all((1, 3))
        x0, y0, x1, y1 = block
        found = _largest(coarse, (x0 // size, y0 // size, -(-x1 // size), -(-y1 // size))) if x1 > x0 and y1 > y0 else None
        if found:
            return (found[0] * size, found[1] * size, min(found[2] * size, on.shape[1]), min(found[3] * size, on.shape[0]))
    return _largest(on, block)


def otsu(grey: np.ndarray) -> int:
    n = np.bincount(grey.ravel(), minlength=256)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    below = n0 * (n0[-1] - n0)
    apart = (n0 * s0[-1] - n0[-1] * s0).astype(float) ** 2
    return int(np.argmax(np.divide(apart, below, out=np.zeros(256), where=below > 0)))


def room(grey: np.ndarray, block: Box, cover: float = 0.85, inset: float = 0.06) -> Box | None:
    """The room around a block on light ground, else on dark: the largest rectangle in its piece of ground, or null if it gains nothing."""
    level = otsu(grey)
    x0, y0, x1, y1 = block
    for ground in (grey > level, grey <= level):
        piece = joined(np.where(ground, 255, 0).astype(np.uint8), block)
        if (piece[y0:y1, x0:x1] > 0).mean() < cover:
            continue
        n = int(np.rint(inset * min(x1 - x0, y1 - y0)))
        for mask in (255 - dilated(255 - np.pad(piece, 1), n)[1:-1, 1:-1] if n else piece, piece):
            found = holding(mask, block)
            if found and found != block:
                return found
    return None


def patches(mask: np.ndarray, apart: int = 24, least: int = 64, context: float = 1.0) -> list[Box]:
    """Boxes to work on: marks nearer than `apart` together, with their surroundings, inside the page."""
    h, w = mask.shape
    near, n = labelled(dilated(mask, apart // 2))
    out = []
    for k in range(1, n + 1):
        x0, y0, x1, y1 = bounds((near == k) & (mask > 0))
        more = max(least, int(np.rint(context * max(x1 - x0, y1 - y0))))
        out.append((max(0, x0 - more), max(0, y0 - more), min(w, x1 + more), min(h, y1 + more)))
    return out


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sampled at pixel centres."""
    h, w = a.shape[:2]
    ys = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    xs = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y, x = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y).reshape(-1, 1), (xs - x).reshape(1, -1)
    y1, x1 = np.minimum(y + 1, h - 1), np.minimum(x + 1, w - 1)
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    top = a[y][:, x] * (1 - fx) + a[y][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x] * (1 - fx) + a[y1][:, x1] * fx) * fy


def page_mask(probability: np.ndarray, height: int, width: int, grow: int = 4, threshold: float = 0.5) -> np.ndarray:
    """A letterboxed map of probabilities as a mask of the page; grow counts in the map's pixels."""
    side = probability.shape[0]
    scale = min(side / height, side / width)
    own = probability[: max(1, round(height * scale)), : max(1, round(width * scale))]
    mask = np.where(resized(own, height, width) > threshold, 255, 0).astype(np.uint8)
    return dilated(mask, round(grow * max(height, width) / side))


def slices(ink: np.ndarray, least: int = 3) -> list[Box]:
    """A region's lines: rows of text, or columns from the right if the ink is higher than wide; the whole box if there are none."""
    box = bounds(ink)
    h, w = ink.shape
    if box is None:
        return [(0, 0, w, h)]
    upright = box[3] - box[1] > box[2] - box[0]
    used = np.concatenate([[0], (ink > 0).any(0 if upright else 1).astype(int), [0]])
    starts, ends = np.flatnonzero(np.diff(used) == 1), np.flatnonzero(np.diff(used) == -1)
    runs = [(int(a), int(b)) for a, b in zip(starts, ends) if b - a >= least]
    if not runs:
        return [(0, 0, w, h)]
    return [(a, 0, b, h) for a, b in reversed(runs)] if upright else [(0, a, w, b) for a, b in runs]


def cells(column: np.ndarray, least: int = 3) -> list[Box]:
    """The characters of a column, from the top: its inked runs, those over one and a half widths cut evenly into squares; the whole column if it has one only."""
    h, w = column.shape
    used = np.concatenate([[0], (column > 0).any(1).astype(int), [0]])
    out = []
    for a, b in zip(np.flatnonzero(np.diff(used) == 1), np.flatnonzero(np.diff(used) == -1)):
        if b - a < least:
            continue
        n = max(1, round((b - a) / w)) if b - a > 1.5 * w else 1
        cuts = np.linspace(a, b, n + 1).round().astype(int)
        out += [(0, int(x), w, int(y)) for x, y in zip(cuts, cuts[1:])]
    return out if len(out) > 1 else [(0, 0, w, h)]


def white_filled(page: np.ndarray, mask: np.ndarray) -> np.ndarray:
    m = mask[..., None].astype(float) / 255
    return np.floor(255 * m + page * (1 - m) + 0.5).astype(np.uint8)


def art_filled(page: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Marked pixels take the mean of their neighbours, from the edge inwards; a page that is all marked turns white."""
    marked = mask > 0
    if marked.all():
        return np.full_like(page, 255)
    out, open_ = page.astype(float), marked.copy()
    while open_.any():  # each round fills what borders on something known, however deep the mask is
        known = np.pad((~open_).astype(float), 1)
        colour = np.pad(out * (~open_)[..., None], ((1, 1), (1, 1), (0, 0)))
        h, w = marked.shape
        at = [(dy, dx) for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)]
        n = sum(known[dy : dy + h, dx : dx + w] for dy, dx in at)
        total = sum(colour[dy : dy + h, dx : dx + w] for dy, dx in at)
        ready = open_ & (n > 0)
        out[ready] = total[ready] / n[ready][:, None]
        open_ &= ~ready
    m = mask[..., None].astype(float) / 255
    return np.floor(out * m + page * (1 - m) + 0.5).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """8-bit grey, RGB or RGBA as PNG bytes."""
    kinds = {1: 0, 3: 2, 4: 6}
    depth = 1 if image.ndim == 2 else image.shape[2]
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, kinds[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def mask_of(image: np.ndarray) -> np.ndarray:
    """A mask's grey: its alpha unless that is opaque all over, else its brightness."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 4 and (image[..., 3] < 255).any():
        return image[..., 3]
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
