"""Histogram gradient-boosted trees, grown level by level and flattened into arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2; leaves are numbered after the nodes."""

    depth: int
    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray  # trees x nodes; a value above the cut goes right
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


FIXED = float(1 << 32)
#: (features, cut places and leaves of the finished trees, feature and cut place of the nodes so far, level) to the gradient and
#: curvature sums of the level: nodes x features x bins each.
Sums = Callable[[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def quantiles(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Cuts of each feature into up to `bins` bins of about equally many rows."""
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each entry; the sums need no more of a row than this, its label and its margin."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.uint8).T


def walked(codes: np.ndarray, feature: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches after `depth` levels, numbered within its level."""
    n, flat = len(codes), codes.T.ravel()
    rows, at = np.arange(n), np.zeros(n, np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + (flat.take(feature.take(at) * n + rows) > place.take(at))
    return at - (2**depth - 1)


def added(margin: np.ndarray, codes: np.ndarray, finished: list[tuple[np.ndarray, ...]], depth: int) -> np.ndarray:
    """margin with what the finished trees add to it."""
    for feature, place, leaf in finished:
        margin = margin + leaf[walked(codes, feature, place, depth)]
    return margin


def sums_of(codes: np.ndarray, y: np.ndarray, margin: np.ndarray, feature: np.ndarray, place: np.ndarray, level: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a level over some rows, in whole FIXED parts, so that neither order nor partitioning changes them."""
    p = 1 / (1 + np.exp(-margin))
    g, h = np.rint((p - y) * FIXED), np.rint(p * (1 - p) * FIXED)
    width, count = codes.shape[1], 2**level
    here = walked(codes, feature, place, level) * bins
    out = np.empty((2, width, count * bins))
    for f in range(width):
        cell = here + codes[:, f]
        out[0, f], out[1, f] = np.bincount(cell, g, count * bins), np.bincount(cell, h, count * bins)
    gs, hs = out.reshape(2, width, count, bins).transpose(0, 2, 1, 3)
    return gs, hs


def start_of(n: int, positive: float) -> float:
    """The margin of the smoothed mean label."""
    share = (positive + 1) / (n + 2)
    return float(np.log(share / (1 - share)))


def grown(sums: Sums, base: float, cuts: list[np.ndarray], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Trees from sums alone, wherever the rows are; without cuts there are none."""
    nodes, leaves = 2**depth - 1, 2**depth
    finished: list[tuple[np.ndarray, ...]] = []
    thresholds = []
    usable = np.arange(bins) < np.array([len(c) for c in cuts], int).reshape(-1, 1)
    for _ in range(trees if usable.any() else 0):
        feature, place, cut = np.zeros(nodes, np.int64), np.full(nodes, bins), np.full(nodes, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gs, hs = (x.cumsum(2) / FIXED for x in sums(finished, feature, place, level))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least) | ~usable] = -1
            best = gain.reshape(count, -1).argmax(1)
            f, k = np.divmod(best, bins)
            for i in np.flatnonzero(gain.reshape(count, -1)[np.arange(count), best] > 1e-6):
                feature[first + i], place[first + i], cut[first + i] = f[i], k[i], cuts[f[i]][k[i]]
        # the last level's sums tell the leaves: what goes left of a node is its sum up to the cut
        own = slice(2 ** (depth - 1) - 1, nodes)
        at = np.arange(leaves // 2), feature[own], np.minimum(place[own], bins - 1)
        left_g, left_h = gs[at], hs[at]
        all_g, all_h = gs[at[0], at[1], -1], hs[at[0], at[1], -1]
        leaf = -rate * np.stack([left_g / (left_h + ridge), (all_g - left_g) / (all_h - left_h + ridge)], 1).ravel()
        finished.append((feature, place, leaf))
        thresholds.append(cut)
    if not finished:
        return Trees(depth, base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)))
    return Trees(depth, base, np.array([t[0] for t in finished]), np.array(thresholds), np.array([t[2] for t in finished]))


def fit(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray] | None = None, **how) -> Trees:
    """Logistic loss over binned features of rows at hand. Without rows of both labels the score is their smoothed mean."""
    bins, depth = how.get("bins", 64), how.get("depth", 4)
    base = start_of(len(y), y.sum())
    if not len(y) or y.min() == y.max():
        return grown(None, base, [], **how)
    cuts = quantiles(x, bins) if cuts is None else cuts
    codes, margin, done = coded(x, cuts), np.full(len(y), base), 0

    def sums(finished: list[tuple[np.ndarray, ...]], feature: np.ndarray, place: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal margin, done
        margin, done = added(margin, codes, finished[done:], depth), len(finished)
        return sums_of(codes, y, margin, feature, place, level, bins)

    return grown(sums, base, cuts, **how)
