"""Hard negatives for stated anchors: rows of another label whose score is just below a positive's.

A score is the integer inner product with the anchor; higher scores come first, ties by smaller id. Anchors
are searched in blocks of `BLOCK` (bounded, so a block is broadcast), each in two passes over all rows. The
first finds every anchor's best rows of its own label. The second takes the rows of a task in runs: all scores
of an anchor within a run are sorted by score and id, each positive's upper limit is found by binary
search, and from there the first rows of other labels down to its lower limit are read. Both passes keep the
best few of each anchor (and positive) in the task and merge them across tasks by a window, so what leaves
a task doesn't grow with its rows.

Scores are computed in the narrowest type that holds every partial sum exactly, up to 64-bit integers.

Defined cases: rows without an id, a label or a vector, or with a component that is null or not finite, take
no part. Vectors of different length count as ending in zeros. An id that occurs in several rows is an anchor
once (its smallest label, then vector); all of its rows are positives and negatives of other anchors, and none is
its own positive. Fewer candidates than asked for give fewer rows; an anchor without a positive, and an
empty table, none. A score that doesn't fit 64 bits raises OverflowError. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.tables import materialize, shared_dir
from inkfold.llm.vectors import matrix, usable, whole

#: Anchors searched at once, rows scored at once, and anchors whose scores of such a run are held at once.
BLOCK, RUN, HELD = 8192, 4096, 512
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as int64, exactly."""
    most = lambda m: int(np.abs(m).max(initial=0))
    bound = anchors.shape[1] * most(anchors) * most(rows)
    if bound >= 2**63:
        raise OverflowError("a score doesn't fit 64 bits")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def best(slots: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each slot, by falling score and then by id."""
    order = np.lexsort((ids, -score, slots))
    slots, score, ids = slots[order], score[order], ids[order]
    opens = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, np.int64)
    rank = np.arange(len(slots)) - np.repeat(opens, np.diff(np.r_[opens, len(slots)]))
    return slots[rank < k], score[rank < k], ids[rank < k]


class Kept:
    """The best k entries of each slot so far."""

    def __init__(self, k: int):
        self.k, self.held = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if found:
            self.held = best(*(np.concatenate(c) for c in zip(self.held, *found)), self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if len(self.held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.held], ["slot", "score", "other"])


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of RUN rows at most, by rising id."""
    for batch in batches:
        for k in range(0, batch.num_rows, RUN):
            part = batch.slice(k, RUN)
            ids = part.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column("label").to_numpy()[order], matrix(part.column("x"), width)[order]


class Anchors:
    """A block of anchors, by label."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids, self.labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        column = table.column("x")
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
        self.width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
        self.x = matrix(column, self.width)
        order = np.argsort(self.labels, kind="stable")
        self.ids, self.labels, self.x = self.ids[order], self.labels[order], self.x[order]

    def positives(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, score, id) of each anchor's best k rows of its label among these, its own id left out."""
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            low, high = np.searchsorted(self.labels, label, "left"), np.searchsorted(self.labels, label, "right")
            for at in range(low, high, HELD):
                some = slice(at, min(at + HELD, high))
                s = scores(self.x[some], x[mine])
                own = self.ids[some][:, None] == ids[mine][None]
                # rows stand by id, so a stable sort of the scores is the sort by score and id
                order = np.argsort(np.where(own, np.iinfo(np.int64).max, -s), axis=1, kind="stable")[:, :k]
                there = np.take_along_axis(~own, order, 1)
                rows, columns = np.nonzero(there)
                hit = order[rows, columns]
                yield at + rows, s[rows, hit], ids[mine][hit]

    def negatives(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, limits: list[list[tuple[int, int, int]]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(slot, score, id) of the first k rows of another label between the limits of each of an anchor's positives."""
        for at in range(0, len(self.ids), HELD):
            all_scores = scores(self.x[at : at + HELD], x)
            for a, s in enumerate(all_scores, at):
                if not limits[a]:
                    continue
                order = np.argsort(-s, kind="stable")
                falling, other = -s[order], np.flatnonzero(labels[order] != self.labels[a])
                for slot, upper, lower in limits[a]:
                    start, end = np.searchsorted(falling, -upper, "left"), np.searchsorted(falling, -lower, "right")
                    near = other[np.searchsorted(other, start) :][:k]
                    hit = order[near[near < end]]
                    if len(hit):
                        yield np.full(len(hit), slot), s[hit], ids[hit]


def _first(found: DataFrame, k: int) -> DataFrame:
    """Across tasks: the first k of each slot, with their rank."""
    by = Window.partitionBy("slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    table: vec_id, label (whole numbers) and embedding. A negative's score lies from `low` to `high` per cent
    of its positive's. block: how many anchors are broadcast and searched at once.
    """
    spark = table.sparkSession
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    prepared = table.where(known).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding")).alias("x"))
    rows = materialize(prepared, "vectors")
    once = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v"))
    anchors = materialize(once.select("vec_id", "v.label", "v.x"), "anchors")
    blocks = math.ceil(anchors.count() / block)
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for b in range(blocks):
        # ids are dealt to blocks by hash, so a block has about `block` anchors
        own = spark.sparkContext.broadcast(Anchors(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()))

        def near(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            kept, a = Kept(positives), own.value
            for run in runs(batches, a.width):
                kept.add(list(a.positives(*run, positives)))
            yield from kept.batches()

        hits = _first(rows.mapInArrow(near, "slot long, score long, other long"), positives).toArrow().to_pylist()
        limits: list[list[tuple[int, int, int]]] = [[] for _ in own.value.ids]
        pairs = sorted((h["slot"], h["rank"], h["other"], h["score"]) for h in hits)
        for slot, (a, _, _, score) in enumerate(pairs):
            limits[a].append((slot, high * score // 100, -(-low * score // 100)))
        told = spark.sparkContext.broadcast((limits, [(int(own.value.ids[a]), other, score) for a, _, other, score in pairs]))

        def below(batches: Iterator[pa.RecordBatch], own=own, told=told) -> Iterator[pa.RecordBatch]:
            kept, a = Kept(negatives), own.value
            for run in runs(batches, a.width):
                kept.add(list(a.negatives(*run, told.value[0], negatives)))
            yield from kept.batches()

        def named(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                anchor, positive, score = zip(*(told.value[1][s] for s in batch.column("slot").to_pylist())) if batch.num_rows else ((), (), ())
                columns = [pa.array(anchor, pa.int64()), pa.array(positive, pa.int64()), batch.column("rank"), batch.column("other"), pa.array(score, pa.int64()), batch.column("score")]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        found = _first(rows.mapInArrow(below, "slot long, score long, other long"), negatives)
        found.mapInArrow(named, OUT).write.parquet(f"{folder}/block={b}")
        own.unpersist()
        told.unpersist()
    if not blocks:
        return spark.createDataFrame([], OUT)
    return spark.read.schema(OUT).parquet(*(f"{folder}/block={b}" for b in range(blocks)))
