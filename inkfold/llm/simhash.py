"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most k bits agree on m - k of m bit blocks, whatever m, so a fingerprint goes
to one cell for each choice of m - k blocks. m is k + 1, or more where the table is so large that cells would
be: each step makes cells smaller by about a block's bits, and finds the same links. In a cell the fingerprints are sorted by Gray rank; neighbours then share many
bits. Nodes over runs of neighbours hold the bits that all of the run share (mask and pattern); two
nodes whose shared bits already differ in more than k places are pruned with all that is below them.
Cells above a size are cut into Gray runs, and only pairs of runs that the nodes can't prune are compared.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; texts with fewer words than a shingle are one shingle; repeated texts share a fingerprint and are
one entry of the index; a null doc_id keeps its row and never names a component (where one of each group is
kept, rows without an id have groups too); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.components import connected_components
from inkfold.llm.tables import free_name, materialize
from inkfold.llm.words import chunks

FAN = 16
CELL = 4096
_ROW = "struct<doc_id: long, text_hash: long, row: long>"


def fingerprint(words: list[bytes], width: int, seed: int) -> int:
    """Majority bits of the XXH64 of each shingle of `width` words."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(text[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_type: str = "long") -> DataFrame:
    """(doc_id, fp) for every row of docs; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for c in chunks(batch.column(1)):
                raw = c.buf.tobytes().lower()
                for i, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())):
                    out[c.first + i] = fingerprint(raw[a:b].split(), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of fp, read as an unsigned Gray code word, in Gray order; comparable as a signed long."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def blocks(bits: int = 64, parts: int = 5) -> list[tuple[int, int]]:
    """(shift, width) of `parts` blocks that cover all bits."""
    sizes = [bits // parts + (i < bits % parts) for i in range(parts)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def block_masks(most: int, entries: int, cell: int) -> list[int]:
    """Bit masks of the choices of blocks that name cells, of the fewest blocks that give `entries` in cells of about `cell`."""
    parts = most + 1
    while True:
        by_block = [((1 << width) - 1) << shift for shift, width in blocks(64, parts)]
        masks = [sum(choice) for choice in combinations(by_block, parts - most)]
        narrowest = min(m.bit_count() for m in masks)
        if entries <= cell << narrowest or parts == most + 5:
            return masks
        parts += 1


class GrayIndex:
    """Nodes over fingerprints sorted by (group, Gray rank); a node never spans two groups."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every, any_ = fps, fps
        while True:
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            sizes = np.diff(np.append(starts, len(groups)))
            self.levels.append((~(every ^ any_), every, np.append(starts, len(groups))))
            if sizes.max() == 1:
                self.roots = np.arange(len(groups))
                break
            within = np.arange(len(groups)) - np.repeat(starts, sizes)
            heads = np.flatnonzero(within % FAN == 0)
            self.levels[-1] += (np.append(heads, len(groups)),)
            every, any_ = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(any_, heads)
            groups = groups[heads]

    def pairs(self, most: int, sides: np.ndarray | None = None, step: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries of a group that differ in at most `most` bits, in portions.

        sides: if given, 0 or 1 for each entry; only pairs across the sides come out.
        """
        stack = [(len(self.levels) - 1, self.roots, self.roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > step:
                stack += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
                continue
            mask, pattern = self.levels[level][:2]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
            a, b = a[near], b[near]
            if level == 0:
                keep = a < b if sides is None else (sides[a] != sides[b]) & (a < b)
                if keep.any():
                    yield a[keep], b[keep]
                continue
            bounds = self.levels[level - 1][3]
            first_a, n_a, first_b, n_b = bounds[a], bounds[a + 1] - bounds[a], bounds[b], bounds[b + 1] - bounds[b]
            count = n_a * n_b
            if not count.sum():
                continue
            which = np.repeat(np.arange(len(a)), count)
            k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            left, right = first_a[which] + k // n_b[which], first_b[which] + k % n_b[which]
            keep = left <= right
            stack.append((level - 1, left[keep], right[keep]))


def forest(n: int, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: enough of them to join all that they join."""
    label, out_a, out_b = np.arange(n), [], []
    for a, b in portions:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            hi, lo = np.maximum(la, lb), np.minimum(la, lb)
            hooked, at = np.unique(hi, return_index=True)
            out_a.append(a[at])
            out_b.append(b[at])
            parent = np.arange(n)
            parent[hooked] = lo[at]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _whole_groups(frames: Iterator[pd.DataFrame], key: str, least: int = 1 << 15) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, regrouped so that none ends inside a key."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        if sum(map(len, held)) < least:
            continue
        whole = pd.concat(held, ignore_index=True)
        cut = int(np.searchsorted(whole[key].to_numpy(), whole[key].iloc[-1], "left"))
        held = [whole.iloc[cut:]]
        if cut:
            yield whole.iloc[:cut]
    if held:
        yield pd.concat(held, ignore_index=True)


def _links(cells: DataFrame, most: int, sided: bool) -> DataFrame:
    """Forest links of each cell. cells: cell, rank, fp, rep and, if sided, side."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_groups(frames, "cell"):
            fps, rep = part["fp"].to_numpy().view(np.uint64), part["rep"].to_numpy()
            index = GrayIndex(fps, part["cell"].to_numpy())
            a, b = forest(len(part), index.pairs(most, part["side"].to_numpy() if sided else None))
            yield pd.DataFrame({"a": rep[a], "b": rep[b]})

    return cells.repartition("cell").sortWithinPartitions("cell", "rank").mapInPandas(run, "a long, b long")


def fingerprint_links(entries: DataFrame, most: int = 4, cell: int = CELL) -> DataFrame:
    """(a, b): links that join all entries whose fingerprints differ in at most `most` bits.

    entries: distinct fp with an id rep. A cell of more than `cell` entries is cut into runs by Gray
    rank; each task compares two runs, of about `cell` entries.
    """
    masks = block_masks(most, entries.count(), cell)
    # cells whose hashes clash are one cell with more to compare
    at = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)), F.lit(i)) for i, m in enumerate(masks)])
    cells = entries.withColumn("rank", gray_rank(F.col("fp"))).select("fp", "rep", "rank", F.explode(at).alias("cell"))
    large = materialize(cells.groupBy("cell").count().where(F.col("count") > cell), "cells")
    most_in_cell = large.agg(F.max("count")).first()[0]
    if not most_in_cell:
        return _links(cells, most, False)
    quantiles = -(-most_in_cell // cell)
    cuts = large.join(cells, "cell").groupBy("cell").agg(
        F.percentile_approx("rank", [i / quantiles for i in range(1, quantiles)], 10_000).alias("cuts")
    )
    cuts = materialize(cuts, "cuts")
    in_runs = materialize(
        cells.join(cuts, "cell").withColumn("run", F.size(F.filter("cuts", lambda x: x < F.col("rank")))).drop("cuts"), "runs"
    )
    nodes = in_runs.groupBy("cell", "run").agg(F.bit_and("fp").alias("pattern"), F.bit_or("fp").alias("any"))
    nodes = materialize(nodes.select("cell", "run", "pattern", F.bitwise_not(F.col("pattern").bitwiseXOR(F.col("any"))).alias("mask")), "nodes")
    x, y = nodes.alias("x"), nodes.alias("y")
    differ = F.bit_count(
        F.col("x.pattern").bitwiseXOR(F.col("y.pattern")).bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask"))
    )
    run_pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.run") < F.col("y.run")) & (differ <= most))
    run_pairs = run_pairs.select(
        F.col("x.cell").alias("cell"), F.array(F.struct(F.col("x.run").alias("run"), F.lit(0).alias("side")), F.struct(F.col("y.run").alias("run"), F.lit(1).alias("side"))).alias("ends"),
        F.xxhash64("x.cell", "x.run", "y.run").alias("pair"),
    ).select("cell", "pair", F.explode("ends").alias("end")).select("cell", "pair", "end.run", "end.side")
    across = in_runs.join(run_pairs, ["cell", "run"]).select(F.col("pair").alias("cell"), "rank", "fp", "rep", "side")
    inside = in_runs.select(F.xxhash64("cell", "run").alias("cell"), "rank", "fp", "rep")
    rest = cells.join(large, "cell", "left_anti").select(F.xxhash64("cell").alias("cell"), "rank", "fp", "rep")
    return _links(inside.union(rest), most, False).union(_links(across, most, True))


def near_groups(docs: DataFrame, most: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of docs."""
    prints = materialize(fingerprints(docs, width, seed), "prints")
    entries = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "entries")
    roots = connected_components(fingerprint_links(entries, most), "a", "b")
    named = materialize(
        entries.join(roots, entries.rep == roots.id, "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "named"
    )
    return prints.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, most: int = 4) -> DataFrame:
    """One row of docs for each group of near copies; rows without an id belong to groups like any other.

    It is the first by (doc_id, nulls last; text hash; hash of the whole row), and one of those equal in all
    three. The rows kept grow with docs, so they are dealt with the texts at every size and never broadcast.
    """
    row, order = F.xxhash64(*docs.columns), ["no_id", "doc_id", "text_hash", "row"]
    name = free_name(docs, "row")
    # fingerprints carry the row's hash as their id
    prints = fingerprints(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), row.alias("row")).alias("doc_id"), "text"), id_type=_ROW)
    prints = materialize(prints.select("doc_id.*", "fp").withColumn("no_id", F.col("doc_id").isNull()).groupBy("fp", *order).agg(F.count("*").alias("n")), "prints")
    entries = materialize(prints.select("fp", F.col("fp").alias("rep")).distinct(), "entries")
    roots = connected_components(fingerprint_links(entries, most), "a", "b")
    firsts = prints.groupBy("fp").agg(F.min(F.struct(*order, "n")).alias("first"))
    kept = firsts.join(roots, firsts.fp == roots.id, "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.row").alias(name), F.col("first.n").alias("n")), "kept")
    rows = docs.withColumn(name, row).join(kept.select(name).hint("shuffle_hash"), name, "left_semi")
    if not kept.where("n > 1").isEmpty():
        rows = rows.dropDuplicates([name])
    return rows.select(docs.columns)
