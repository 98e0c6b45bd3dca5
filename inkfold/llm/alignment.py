"""Whether the surroundings of two equal shingles hold passages with a shingle similarity of 0.8.

A row of codes has 16 bits for each of the SIDE shingles before and after a place; 0 is outside the document.
Shingles are aligned from the place to both sides, with gaps: a matched one counts 1, one left over in either
text -4, so a span scores 0 or more just where its shingles have a Jaccard similarity of 0.8.
"""

from __future__ import annotations

import numpy as np

from inkfold.llm.words import mix

LEAST = 46
SIDE = 48
SHIFT = 8
RUN, NEAR = 17, 4
#: So many rows of an entry meet all others, which joins copies; where more are left, entries are cut by what their rows share.
FEW = 32
_NEVER, _FAR = np.int16(-8000), np.int16(8192)
_GAP, _ONE = np.int16(4), np.int16(1)


def _extended(a: np.ndarray, b: np.ndarray, shift: int = SHIFT) -> np.ndarray:
    """For each k up to the width, the best score of aligned starts of the rows of a and b, the shorter of k shingles."""
    n, width = a.shape
    there = np.minimum((a != 0).sum(1), (b != 0).sum(1))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    out = np.full((width + 1, n), _NEVER, np.int16)
    out[0] = 0
    same, other = np.empty(n, bool), np.empty(n, np.int16)
    free = [np.empty(n, np.int16) for _ in range(4 * shift + 4)]
    above: dict[int, np.ndarray] = {}
    for i in range(width + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - shift), min(width, i + shift) + 1):
            best = free.pop()
            if j - 1 in above:
                np.equal(a[i - 1], b[j - 1], out=same)
                np.subtract(same.view(np.int8), 1, out=other, dtype=np.int16)
                np.bitwise_and(other, _FAR, out=other)
                np.subtract(above[j - 1], other, out=best)
                np.add(best, _ONE, out=best)
            else:
                best.fill(_NEVER if i or j else 0)
            for before in (above.get(j), row.get(j - 1)):
                if before is not None:
                    np.subtract(before, _GAP, out=other)
                    np.maximum(best, other, out=best)
            row[j] = np.maximum(best, _NEVER, out=best)
            np.maximum(out[min(i, j)], best, out=out[min(i, j)])
        free += above.values()
        above = row
    # a path outside a document never beats the one that ends with it, but its length isn't real
    out[np.arange(width + 1)[:, None] > there] = _NEVER
    return out


def _spans(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Whether a part of `left` and a part of `right` of `least` shingles in all score 0 or more; rows are lengths."""
    right = np.maximum.accumulate(right[::-1])[::-1]
    need = np.maximum(0, least - 1 - np.arange(SIDE + 1))
    fits = need <= SIDE
    return (left[fits].astype(np.int32) + right[need[fits]] + 1 >= 0).any(0)


def _aligned(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    return _spans(_extended(a[:, :SIDE][:, ::-1], b[:, :SIDE][:, ::-1]), _extended(a[:, SIDE:], b[:, SIDE:]), least)


def _possible(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """False only where no span can agree: each shingle counts as matched that has an equal one within SHIFT.

    Of starts of i and j shingles with m matched the score is 9 m - 4 (i + j), and m is at most what either could match.
    """
    hits = [np.zeros(x.shape, bool) for x in (a, b)]
    for half in (slice(0, SIDE), slice(SIDE, 2 * SIDE)):
        x, y, hit_x, hit_y = a[:, half], b[:, half], hits[0][:, half], hits[1][:, half]
        for s in range(-SHIFT, SHIFT + 1):
            i, j = slice(max(0, -s), SIDE - max(0, s)), slice(max(0, s), SIDE - max(0, -s))
            same = x[:, i] == y[:, j]
            hit_x[:, i] |= same
            hit_y[:, j] |= same
    start, length = np.zeros((1, len(a)), np.int16), np.arange(SIDE + 1)
    both = []
    for way in (slice(SIDE - 1, None, -1), slice(SIDE, None)):
        x, y = (np.concatenate([start, np.cumsum((hit & (codes != 0)).T[way], 0, dtype=np.int16)]) for hit, codes in zip(hits, (a, b)))
        most = np.minimum(x, y) * np.int16(9)
        for further, cost in ((2, 4), (SHIFT, 12)):  # one start is longer, by 1 or 2 or by 3 or more
            on = np.minimum(length + further, SIDE)
            np.maximum(most, np.maximum(np.minimum(x, y[on]), np.minimum(x[on], y)) * np.int16(9) - np.int16(cost), out=most)
        both.append(most - (8 * length).astype(np.int16)[:, None])
    return _spans(*both, least)


def agree(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether spans around the places of two rows of codes, of `least` shingles or more, have a similarity of 0.8.

    Equal runs are seen at once and hopeless rows put aside; only the others are aligned.
    """
    yes = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 13):
        x, y = a[k : k + (1 << 13)], b[k : k + (1 << 13)]
        same, end = (x == y) & (x != 0), np.zeros((len(x), 1), bool)
        run = 1 + sum(np.argmin(np.concatenate([half, end], 1), 1) for half in (same[:, :SIDE][:, ::-1], same[:, SIDE:]))
        got = run >= least
        open_ = np.flatnonzero(~got)
        open_ = open_[_possible(x[open_], y[open_], least)]
        if len(open_):
            got[open_] = _aligned(x[open_], y[open_], least)
        yes[k : k + (1 << 13)] = got
    return yes


def anchors(key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry): runs of RUN codes, the place's own among them, of which any NEAR neighbours have one at least."""
    n = len(key)
    whole = np.concatenate([code[:, :SIDE], np.full((n, 1), 1, np.uint16), code[:, SIDE:]], 1)
    wide = whole.astype(np.uint64)
    size = wide.shape[1] - RUN + 1
    run, there = wide[:, :size].copy(), whole[:, :size] != 0
    for k in range(1, RUN):
        run = run * np.uint64(0xD6E8FEB86659FD93) + wide[:, k : k + size]
        there &= whole[:, k : k + size] != 0
    run = np.where(there, mix(run), np.uint64(2**64 - 1))
    least = np.minimum.reduce([run[:, k : size - NEAR + 1 + k] for k in range(NEAR)])
    chosen = np.zeros(run.shape, bool)
    for k in range(NEAR):
        chosen[:, k : size - NEAR + 1 + k] |= run[:, k : size - NEAR + 1 + k] == least
    row, at = np.nonzero(chosen & there)
    entry = mix(key.view(np.uint64)[row] + run[row, at])
    # a text that repeats itself has an anchor at many places
    order = np.lexsort((row, entry))
    row, entry = row[order], entry[order]
    once = np.concatenate([[True], (row[1:] != row[:-1]) | (entry[1:] != entry[:-1])])[: len(row)]
    return row[once], entry[once]


def _enough(codes: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Whether rows could agree with another by common codes alone: a span of `least` that scores 0 or more."""
    worth = np.where(common[codes], _ONE, -_GAP).T
    start = np.zeros((1, len(codes)), np.int16)
    left, right = (np.concatenate([start, np.cumsum(part, 0, dtype=np.int16)]) for part in (worth[:SIDE][::-1], worth[SIDE:]))
    return _spans(left, right, least)


def _groups(row: np.ndarray, entry: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row and entry sorted by both, and the first of each entry. Of entries with the same rows one stays, of those that links have joined none."""
    order = np.lexsort((row, entry))
    row, entry = row[order], entry[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (entry[1:] != entry[:-1])
    row, entry = row[once], entry[once]
    heads = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])[: len(row)])
    if not len(row):
        return row, entry, heads
    sizes = np.diff(np.append(heads, len(row)))
    open_ = np.minimum.reduceat(label[row], heads) != np.maximum.reduceat(label[row], heads)
    alike = np.stack([np.add.reduceat(mix(row.astype(np.uint64) + np.uint64(1)), heads), sizes.astype(np.uint64)])
    first = np.zeros(len(heads), bool)
    first[np.unique(alike, axis=1, return_index=True)[1]] = True
    go = np.repeat(first & open_, sizes)
    row, entry = row[go], entry[go]
    return row, entry, np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])[: len(row)])


def _parts(members: np.ndarray, entry: np.uint64, code: np.ndarray, label: np.ndarray, least: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which members can agree by what all of them share, and the parts of those that share more: a pair of neighbours that isn't all in it."""
    own = code[members]
    ordered = np.sort(own, 1)
    once = np.ones(own.shape, bool)
    once[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    common = np.bincount(ordered[once], minlength=1 << 16) == len(members)
    common[0] = False
    x, y = own[:, :-1], own[:, 1:]
    which, at = np.nonzero((x != 0) & (y != 0) & ~(common[x] & common[y]))
    more = mix(entry + (x[which, at].astype(np.uint64) << np.uint64(16) | y[which, at]))
    return _enough(own, common, least), _groups(members[which], more, label)


def refined(row: np.ndarray, entry: np.ndarray, code: np.ndarray, label: np.ndarray, least: int = LEAST, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) to the same links, where entries of more than `few` rows hold rows that can agree by what all of them share.

    Where very many rows share a line that isn't enough by itself, two of them can only agree if they share more
    than it. So the rows that have enough meet as before, and all meet again in parts that share more, which are
    cut in turn. A part never costs more than the whole: where parts wouldn't have half the pairs, the whole stays.
    """
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    todo = [_groups(row, entry, label)]
    while todo:
        row, entry, heads = todo.pop()
        sizes = np.diff(np.append(heads, len(row)))
        small = np.repeat(sizes <= few, sizes)
        kept.append((row[small], entry[small]))
        for a, n in zip(heads[sizes > few].tolist(), sizes[sizes > few].tolist()):
            members = row[a : a + n]
            enough, parts = _parts(members, entry[a], code, label, least)
            pairs = int((np.diff(np.append(parts[2], len(parts[0]))) ** 2).sum()) + int(enough.sum()) ** 2
            if enough.all() or 2 * pairs > n * n:
                kept.append((members, np.full(n, entry[a])))
                continue
            kept.append((members[enough], np.full(enough.sum(), entry[a])))
            todo.append(parts)
    return _groups(*(np.concatenate(x) for x in zip(*kept)), label)[:2]


def match(key: np.ndarray, code: np.ndarray, doc: np.ndarray | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier row) links that join all rows of one key that agree and share an anchor, and more than what all rows of it share.

    Rows of one key and doc count as joined from the start.
    """
    n, label = len(key), np.arange(len(key))
    if doc is not None and n:
        order = np.lexsort((label, doc, key))
        opens = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
        label[order] = order[np.maximum.accumulate(np.where(opens, np.arange(n), 0))]
    row, entry = anchors(key, code)
    found, rounds, cut = [np.zeros(0, np.int64)], 0, False
    while len(row) > 1:
        if rounds >= FEW and not cut:
            cut = True
            row, entry = refined(row, entry, code, label, least)
            if not len(row):
                break
        heads = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        sizes = np.diff(np.append(heads, len(row)))
        within = np.arange(len(row)) - np.repeat(heads, sizes)
        # several leaders at a time where few rows are left
        leaders = max(1, min(64, (1 << 14) // len(row)))
        met = []
        for k in range(leaders):
            later = np.flatnonzero(within > k)
            leader = row[later - within[later] + k]
            apart = (label[row[later]] != label[leader]) & (key[row[later]] == key[leader])
            met.append(row[later[apart]] * n + leader[apart])
        pairs = np.unique(np.concatenate(met))
        a, b = pairs // n, pairs % n
        yes = agree(code[a], code[b], least)
        found.append(pairs[yes])
        a, b = a[yes], b[yes]
        while (label[a] != label[b]).any():
            parent = np.arange(n)
            np.minimum.at(parent, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
        row, entry = row[within >= leaders], entry[within >= leaders]
        rounds += leaders
        if len(row):
            # runs that links have joined are done
            heads = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            own = label[row]
            many = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
            go = np.repeat(many, np.diff(np.append(heads, len(row))))
            row, entry = row[go], entry[go]
    both = np.unique(np.concatenate(found))
    return both // n, both % n
