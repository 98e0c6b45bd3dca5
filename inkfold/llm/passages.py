"""Substring dedup: near-duplicate passages through compact windows over min-hashes.

A text is the sequence of its five-word shingles. For each of several hash functions, the subsequences of
at least `least` shingles whose smallest hash is at position c are one compact window (l, c, r): all that
start in [l, c] and end in [c, r]. These are the wide nodes of the Cartesian tree over the hashes; they
are found with sliding minima, and their bounds with a stack. Windows with the same function and smallest
hash, in any two documents, hold subsequences that share a signature.

Windows with the same hash and c are candidates only; of those in a periodic stretch the ends suffice. Copies
whose surroundings of c (48 shingles on either side, told apart by a 64-bit hash) are equal are linked first,
inside each map task and again for each hash; one of them goes on. Where different surroundings are left,
their shingles are read from the texts and aligned from c to both sides, with gaps (see alignment.py). Two
windows are linked if a span with a shingle similarity of 0.8 has `least` shingles in both. It then holds a
run of 20 equal shingles, so windows are only compared with those of the same hash that share an anchor: a
run of 17, chosen as the smallest of 4 neighbours. Every window meets all others of its anchors unless links
have joined the two already. A link stays if windows of `enough` hash functions that overlap it in the
document are linked too.

Defined cases: null and empty texts, and texts of fewer than `least` shingles, have no windows and are
their own class; a null doc_id keeps its row, without a class, and links nothing; rows with one doc_id are
one document; passages that repeat inside one document don't count; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.alignment import LEAST, SIDE, agree, anchors, match  # noqa: F401
from inkfold.llm.components import connected_components
from inkfold.llm.tables import materialize
from inkfold.llm.simhash import _whole_groups
from inkfold.llm.words import _BASE, Chunk, _grow, chunks, mix, runs_of

SHINGLE = 5
HASHES = 4
ENOUGH = 2
HELD = 400_000
HOT = 1 << 17
FIELDS = ["kind", "key", "doc", "c", "l", "r", "b0", "rep", "rep_c"]
#: kind: 1 a link, 0 a window; b0: the hash of what surrounds c.
SCHEMA = "kind int, key long, doc long, c int, l int, r int, b0 long, rep long, rep_c int"
LINK = "key long, doc long, c int, l int, r int, rep long, rep_c int"


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of.reduce over each run of `width` entries, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = of(out[:-step], out[step:])
        done += step
    return out


def _bounds(h: np.ndarray, doc: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position in `at`, how far its hash stays the smallest to the left (ties end it) and to the right."""
    left, right = first[doc[at]].copy(), last[doc[at]].copy()
    stack: list[int] = []
    hs, ds, ps = h[at].tolist(), doc[at].tolist(), at.tolist()
    for i in range(len(ps)):
        while stack and ds[stack[-1]] != ds[i]:
            stack.pop()
        while stack and hs[stack[-1]] > hs[i]:
            right[stack.pop()] = ps[i] - 1
        if stack:
            left[i] = ps[stack[-1]] + 1
        stack.append(i)
    return left, right


def _shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the chunk, the row of each, and each row's first and last one."""
    doc_of_word = np.repeat(np.arange(c.rows), np.diff(c.docs))
    every = runs_of(c.hashes(), SHINGLE)
    inside = doc_of_word[: len(every)] == doc_of_word[SHINGLE - 1 :][: len(every)]
    doc = doc_of_word[: len(every)][inside]
    rows = np.arange(c.rows)
    return every[inside], doc, np.searchsorted(doc, rows), np.searchsorted(doc, rows, "right") - 1


def surroundings(shingles: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the shingles up to SIDE before and after each place, inside its document."""
    up, down = _grow(len(shingles) + 1)
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles) * up[: len(shingles)], out=sums[1:])
    a, b = np.maximum(first, at - SIDE), np.minimum(last, at + SIDE) + 1
    span = (sums[b] - sums[a]) * down[a]
    return mix(span + mix((at - a).astype(np.uint64) * np.uint64(_BASE) + (b - a).astype(np.uint64))).view(np.int64)


def codes(shingles: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """16 bits of each shingle up to SIDE before and after each place; 0 outside its document."""
    places = at[:, None] + np.concatenate([np.arange(-SIDE, 0), np.arange(1, SIDE + 1)])
    there = (places >= first[:, None]) & (places <= last[:, None])
    short = (shingles % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return np.where(there, short[np.clip(places, 0, len(shingles) - 1)], np.uint16(0))


def repeats(shingles: np.ndarray, at: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a window lies inside a periodic stretch: its neighbours of the same hash are as far to either side, after equal text."""
    up, down = _grow(len(shingles) + 1)
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles) * up[: len(shingles)], out=sums[1:])
    order = np.lexsort((at, key, row))
    place, step = at[order], np.diff(at[order])
    tied = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    inner = np.zeros(len(at), bool)
    mid = np.flatnonzero(tied[:-1] & tied[1:] & (step[:-1] == step[1:])) + 1
    a, b, c = place[mid - 1], place[mid], place[mid + 1]
    inner[order[mid]] = (sums[b] - sums[a]) * down[a] == (sums[c] - sums[b]) * down[b]
    return inner


def windows(c: Chunk, least: int = LEAST, hashes: int = HASHES, ends: bool = False) -> tuple[np.ndarray, ...]:
    """Row in the chunk, key, c, l, r (in the document's shingles) and the hash of its surroundings for each compact window.

    ends: of the windows of a periodic stretch keep the first and the last, from which either side is aligned as well.
    """
    shingles, doc, first, last = _shingles(c)
    none = np.zeros(0, np.int64)
    if len(shingles) < least:
        return none, none, none, none, none, none
    valid = doc[: len(doc) - least + 1] == doc[least - 1 :]
    found = []
    for f in range(hashes):
        h = mix(shingles + np.uint64((f + 1) * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)
        smallest = np.where(valid, _sliding(h, least, np.minimum), np.uint64(0))
        padding = np.zeros(least - 1, np.uint64)
        over = _sliding(np.concatenate([padding, smallest, padding]), least, np.maximum)
        at = np.flatnonzero(h == over)
        l, r = _bounds(h, doc, at, first, last)
        wide = r - l + 1 >= least
        at, l, r = at[wide], l[wide], r[wide]
        key = (h[at] >> np.uint64(2) << np.uint64(2)) | np.uint64(f & 3)
        found.append((at, key.view(np.int64), l, r))
    at, key, l, r = (np.concatenate(x) for x in zip(*found))
    if ends:
        kept = ~repeats(shingles, at, key, doc[at])
        at, key, l, r = at[kept], key[kept], l[kept], r[kept]
    row = doc[at]
    return row, key, at - first[row], l - first[row], r - first[row], surroundings(shingles, at, first[row], last[row])


def _links(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    apart = rows["doc"][a] != rows["doc"][b]
    a, b = a[apart], b[apart]
    return pd.DataFrame({k: rows[k][a] for k in ("key", "doc", "c", "l", "r")} | {"rep": rows["doc"][b], "rep_c": rows["c"][b]})


def _resolve(rows: dict[str, np.ndarray]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Links from windows to the first with their hash and surroundings, and the rows that are the first."""
    order = np.lexsort((rows["c"], rows["doc"], rows["b0"], rows["key"]))
    rows = {k: v[order] for k, v in rows.items()}
    key, near = rows["key"], rows["b0"]
    leads = np.ones(len(key), bool)
    leads[1:] = (key[1:] != key[:-1]) | (near[1:] != near[:-1])
    first = np.maximum.accumulate(np.where(leads, np.arange(len(key)), 0))
    a = np.flatnonzero(~leads)
    return _links(rows, a, first[a]), pd.DataFrame({k: v[leads] for k, v in rows.items()})


def _frame(kind: int, part: pd.DataFrame) -> pd.DataFrame:
    part = part.assign(kind=kind, **{c: 0 for c in FIELDS if c != "kind" and c not in part.columns})[FIELDS]
    return part.astype({"kind": "int32", "c": "int32", "l": "int32", "r": "int32", "rep_c": "int32"})


def window_links(docs: DataFrame, least: int = LEAST, hashes: int = HASHES, hot: int = HOT) -> DataFrame:
    """Verified links: key, doc, c, l, r, rep, rep_c. rep is another document with the passage around c.

    Windows of a hash that has more than `hot` of them with surroundings of their own meet by anchor instead.
    """

    def shared_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()
            links, leads = _resolve(rows)
            for kind, part in ((1, links), (0, leads)):
                yield pa.RecordBatch.from_pandas(_frame(kind, part), preserve_index=False)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in chunks(batch.column(1)):
                row, key, at, l, r, near = windows(c, least, hashes, ends=True)
                held.append({"key": key, "doc": ids[c.first + row], "c": at, "l": l, "r": r, "b0": near})
                if sum(len(h["key"]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    def shared_by_key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ready() -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[frame["kind"] == 0]
                done.append(frame[frame["kind"] == 1])

        done: list[pd.DataFrame] = []
        for part in _whole_groups(ready(), "key", HELD):
            links, leads = _resolve({k: part[k].to_numpy() for k in FIELDS[1:7]})
            yield _frame(1, links)
            # windows of a hash with one surrounding only, or of one document, meet no other
            by = leads.groupby("key")["doc"]
            yield _frame(0, leads[by.transform("min") != by.transform("max")])
            yield from done
            done.clear()
        yield from done

    def read_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            offsets, fields = wanted.offsets.to_numpy(), wanted.values
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                shingles, _, first, last = _shingles(c)
                bounds = offsets[c.first : c.first + c.rows + 1]
                part = {k: fields.field(k).slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False) for k in ("key", "c", "l", "r", "b0", "hot")}
                row = np.repeat(np.arange(c.rows), np.diff(bounds))
                at = first[row] + part["c"]
                # another text under the same id may have the window
                own = np.flatnonzero(at <= last[row])
                own = own[surroundings(shingles, at[own], first[row[own]], last[row[own]]) == part["b0"][own]]
                key, hot = part["key"][own], np.flatnonzero(part["hot"][own])
                near = codes(shingles, at[own], first[row[own]], last[row[own]])
                if len(hot):
                    # windows of a hot hash are dealt by anchor; the key keeps the number of the hash function
                    of, entry = anchors(key[hot], near[hot])
                    dealt_key = entry >> np.uint64(2) << np.uint64(2) | key[hot][of].view(np.uint64) & np.uint64(3)
                    of = np.concatenate([np.setdiff1d(np.arange(len(own)), hot), hot[of]])
                    key = np.concatenate([np.delete(key, hot), dealt_key.view(np.int64)])
                    own, near = own[of], near[of]
                out = [pa.array(key), pa.array(ids[c.first + row[own]].astype(np.int64)), *(pa.array(part[k][own].astype(np.int32)) for k in ("c", "l", "r"))]
                yield pa.RecordBatch.from_arrays([*out, pa.array([x.tobytes() for x in near], pa.binary())], ["key", "doc", "c", "l", "r", "near"])

    def near_by_key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_groups(frames, "key"):
            rows = {k: part[k].to_numpy() for k in ("key", "doc", "c", "l", "r")}
            code = np.frombuffer(b"".join(part["near"]), np.uint16).reshape(-1, 2 * SIDE)
            yield _links(rows, *match(rows["key"], code, rows["doc"], least))

    texts = docs.where("doc_id is not null").select("doc_id", "text")
    local = texts.mapInArrow(shared_in_task, SCHEMA)
    # finished links are spread; they don't need to meet
    spread = F.when(F.col("kind") == 1, F.xxhash64("doc", "c", "key")).otherwise(F.col("key"))
    dealt = local.repartition(spread).sortWithinPartitions("kind", "key")
    met = materialize(dealt.mapInPandas(shared_by_key, SCHEMA), "met")
    open_ = met.where("kind = 0").select("key", "doc", "c", "l", "r", "b0")
    many = open_.groupBy("key").agg((F.count("*") > hot).alias("hot")).where("hot")
    wanted = open_.join(many, "key", "left").withColumn("hot", F.col("hot").isNotNull())
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "c", "l", "r", "b0", "hot")).alias("wanted"))
    asked = texts.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "wanted").mapInArrow(read_codes, "key long, doc long, c int, l int, r int, near binary")
    near = asked.repartition("key").sortWithinPartitions("key", "doc", "c").mapInPandas(near_by_key, LINK)
    return met.where("kind = 1").select(near.columns).union(near)


def supported(links: DataFrame, enough: int = ENOUGH, reach: int = LEAST - 1) -> DataFrame:
    """The links that overlap, in their document, with links of `enough` hash functions in all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) > HELD:
                whole = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(whole["doc"].to_numpy(), whole["doc"].iloc[-1], "left"))
                held = [whole.iloc[cut:]]
                if cut:
                    yield keep(whole.iloc[:cut])
        if held:
            yield keep(pd.concat(held, ignore_index=True))

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        doc = np.unique(part["doc"].to_numpy(), return_inverse=True)[1].astype(np.int64) << 32
        c, f = part["c"].to_numpy().astype(np.int64), part["key"].to_numpy() & 3
        start = doc + np.maximum(part["l"].to_numpy(), c - reach)
        end = doc + np.minimum(part["r"].to_numpy(), c + reach)
        votes = np.zeros(len(part), np.int64)
        for other in range(4):
            own = np.flatnonzero(f == other)
            if not len(own):
                continue
            s = start[own]
            order = np.argsort(s, kind="stable")
            ends = np.maximum.accumulate(end[own][order])
            k = np.searchsorted(s[order], end, "right") - 1
            votes += (k >= 0) & (ends[np.maximum(k, 0)] >= start)
        return part.loc[votes >= enough, ["doc", "c", "rep", "rep_c"]]

    return links.repartition("doc").sortWithinPartitions("doc").mapInPandas(run, "doc long, c int, rep long, rep_c int")


def passage_classes(docs: DataFrame, least: int = LEAST, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """doc_id, class_id, n_links, first_word and last_word for every row of docs.

    class_id: the smallest doc_id reached through shared passages, the document's own if it shares none.
    n_links: the representatives that it is linked with, either way. The words bound the places of the hits.
    """
    links = materialize(supported(window_links(docs, least, hashes), enough), "passages")
    places = links.select(F.col("doc").alias("id"), F.col("rep").alias("other"), "c").union(links.select("rep", "doc", "rep_c"))
    spans = places.groupBy("id").agg(
        F.count_distinct("other").alias("n_links"), F.min("c").alias("first_word"), (F.max("c") + SHINGLE - 1).alias("last_word")
    )
    classes = materialize(connected_components(links, "doc", "rep").join(spans, "id"), "classes")
    return docs.select("doc_id").join(classes, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id",
        F.coalesce("root", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "first_word",
        "last_word",
    )
