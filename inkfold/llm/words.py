"""Vectorised words and word hashes over Arrow text buffers.

Words are runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Everything works on the
UTF-8 bytes of whole texts; a chunk holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_EXACT = np.random.RandomState(977).randint(1, 2**63 - 1, 256).astype(np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[0], _powers[1] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[0], _powers[1]


def spans(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `gaps`, and each document's first run.

    offsets: the documents' bounds in buf, from 0 to len(buf). cuts: places inside a run where a new one begins.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gaps[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """A 64-bit hash of each span; A-Z count as a-z unless exact."""
    table = _EXACT if exact else _TABLE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + (1 << 18), "right")))
        part = buf[base : ends[j - 1]]
        up, down = _grow(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def runs_of(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive entries."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n].copy()
    for k in range(1, width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(total)


@dataclass
class Chunk:
    """Some consecutive rows of a batch: their bytes and their words."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about `size` bytes of whole texts; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        j = min(j, len(texts))
        buf, offsets = data[bounds[i] : bounds[j]], (bounds[i : j + 1] - bounds[i]).astype(np.int64)
        yield Chunk(i, buf, offsets, *spans(buf, offsets, SPACES))
        i = j
