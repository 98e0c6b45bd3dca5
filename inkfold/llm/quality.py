"""Quality classifier: boosted trees over whole-text statistics.

Trees are fitted to all labelled rows outside the held-out remainder; every document is scored from statistics of its
whole text. The cuts are quantiles of all these rows, told to eleven binary places. Up to
LOCAL rows are fitted on the driver; of more only the sums of a level leave the tasks, and the trees are the same. A
row is one byte for each statistic, its label and its margin there, and a batch of rows is one record, dealt so that a task
has about PART rows: a level is a job, so what a job costs besides its rows counts.

Defined cases: null and empty texts have zero statistics and are scored like any other; a null doc_id is
scored and never held out; without labels of both kinds the score is the smoothed mean of the labels;
repeated rows are scored alike; an empty table gives an empty result; extra columns are kept by
keep_good and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.boosting import Trees, added, coded, fit, grown, start_of, sums_of
from inkfold.llm.tables import free_name, id_crc, labelled, materialize
from inkfold.llm.words import NEWLINE, Chunk, chunks, runs_of, span_hashes, spans

LOCAL = 20_000
BINS, DROPPED = 64, 12
#: Trees after which the margins of the rows are written anew.
REFRESH = 10
#: Rows of a task of the distributed fit.
PART = 1 << 16
HELD_OUT = (4, 2)
KEEP = 0.7

KINDS = ["a-z", "A-Z", "0-9", " \t\r\x0b\x0c", "\n", ".,;:'\"-", "!?", "#*$%&|<>", "()[]{}", "@/\\^_`~+="]
_KIND = np.full(256, len(KINDS), np.int64)
for _i, _chars in enumerate(KINDS):
    _KIND[list(range(ord(_chars[0]), ord(_chars[2]) + 1)) if _i < 3 else [ord(c) for c in _chars]] = _i
WIDTH = len(KINDS) + 1 + 10


def _same(sorted_hashes: np.ndarray) -> tuple[int, int]:
    """How many distinct values, and how often the commonest occurs."""
    if not len(sorted_hashes):
        return 0, 0
    heads = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))
    return len(heads), int(np.diff(np.append(heads, len(sorted_hashes))).max())


def chunk_stats(c: Chunk) -> np.ndarray:
    """WIDTH statistics for each document of the chunk."""
    sizes = np.diff(c.offsets)
    kinds = len(KINDS) + 1
    by_kind = np.bincount(np.repeat(np.arange(c.rows) * kinds, sizes) + _KIND[c.buf], minlength=c.rows * kinds).reshape(c.rows, kinds)
    words = np.diff(c.docs)
    h = c.hashes()
    lengths = (c.ends - c.starts).astype(float)
    at, to, first_line = spans(c.buf, c.offsets, NEWLINE)
    lines = span_hashes(c.buf, at, to, exact=True)
    out = np.zeros((c.rows, WIDTH))
    out[:, :kinds] = by_kind / np.maximum(sizes, 1)[:, None]
    for i in range(c.rows):
        a, b = c.docs[i], c.docs[i + 1]
        n, x = b - a, first_line[i + 1] - first_line[i]
        distinct, commonest = _same(np.sort(h[a:b]))
        five = runs_of(h[a:b], 5)
        unlike = _same(np.sort(five))[0]
        unlike_lines = _same(np.sort(lines[first_line[i] : first_line[i + 1]]))[0]
        mean = lengths[a:b].mean() if n else 0.0
        out[i, kinds:] = (
            np.log1p(n), np.log1p(sizes[i]), mean, lengths[a:b].std() if n else 0.0, distinct / max(n, 1), commonest / max(n, 1),
            1 - unlike / max(len(five), 1) if len(five) else 0.0, np.log1p(x), n / max(x, 1), 1 - unlike_lines / max(x, 1) if x else 0.0,
        )
    return out


def batch_stats(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, WIDTH)), *map(chunk_stats, chunks(texts))])


def _labelled_stats(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int]) -> DataFrame:
    """(label, stats) of every labelled document; statistics, not texts, are shuffled to the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(batch_stats(batch.column("text")).astype(np.float32).ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * WIDTH), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])

    mod, rem = held_out
    # other documents have no label to learn
    own = docs.where(F.col("doc_id").isNotNull() & (id_crc() % mod != rem)).select("doc_id", "text")
    return own.mapInArrow(run, "doc_id long, stats array<float>").join(labelled(labels, "quality", held_out), "doc_id").select("label", "stats")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, WIDTH)


def _cuts(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Quantiles of each statistic: values are counted by all but the last DROPPED bits of a 32-bit float, so a cut is the top of such a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bits of floats that aren't negative are in their order
            place = np.maximum(_matrix(batch.column("stats")), 0).view(np.int32).astype(np.int64) >> DROPPED
            key, count = np.unique(place + (np.arange(WIDTH) << 32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "n"])

    counts = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    key, count = counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    out = []
    for f in range(WIDTH) if n else ():
        own = key >> 32 == f
        reached = np.searchsorted(count[own].cumsum(), np.ceil(np.linspace(0, 1, BINS + 1)[1:-1] * n))
        top = (np.unique(key[own][reached]) - (f << 32) << DROPPED) | ((1 << DROPPED) - 1)
        out.append(top.astype(np.int32).view(np.float32).astype(np.float64))
    return out


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = HELD_OUT, local: int = LOCAL, depth: int = 4, **how) -> Trees:
    """Trees from all labelled documents. Up to `local` rows of statistics reach the driver, of more only sums."""
    rows = materialize(_labelled_stats(docs, labels, held_out), "stats")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    cuts = _cuts(rows, n)
    how |= {"depth": depth, "bins": BINS}
    if n <= local:
        held = rows.toPandas()
        return fit(np.array(held["stats"].tolist(), np.float64).reshape(-1, WIDTH), held["label"].to_numpy(np.float64), cuts, **how)
    base = start_of(n, positive)
    if positive in (0, n):
        return grown(None, base, [], **how)

    def block(label: np.ndarray, codes: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
        # statistic by statistic, as the sums read them
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (label.astype(np.int8), codes.T, margin)], ["label", "codes", "margin"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for label, codes, margin in zip(*(c.to_pylist() for c in batch.columns)):
                yield np.frombuffer(label, np.int8), np.frombuffer(codes, np.uint8).reshape(WIDTH, -1).T, np.frombuffer(margin)

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = coded(_matrix(batch.column("stats")).astype(np.float64), cuts)
            yield block(batch.column("label").to_numpy(), codes, np.full(batch.num_rows, base))

    kind = "label binary, codes binary, margin binary"
    table, done = materialize(rows.repartition(-(-n // PART)).mapInArrow(to_codes, kind), "codes"), 0

    def sums(finished: list[tuple[np.ndarray, ...]], feature: np.ndarray, place: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal table, done
        if len(finished) - done >= REFRESH:
            news = finished[done:]

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for label, codes, margin in blocks(batches):
                    yield block(label, codes, added(margin, codes, news, depth))

            table, done = materialize(table.mapInArrow(moved, kind), "codes"), len(finished)
        news = finished[done:]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2**level, WIDTH, BINS))
            for label, codes, margin in blocks(batches):
                total += sums_of(codes, label, added(margin, codes, news, depth), feature, place, level, BINS)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

        # one array a task, of at most 344 kB
        parts = [np.frombuffer(r.sums).reshape(2, 2**level, WIDTH, BINS) for r in table.mapInArrow(run, "sums binary").collect()]
        return tuple(np.sum(parts, 0))

    return grown(sums, base, cuts, **how)


def scored(docs: DataFrame, trees: Trees, columns: list[str], keep: float | None = None) -> DataFrame:
    """The columns of docs with score; with keep, only the rows whose score reaches it."""
    held = docs.sparkSession.sparkContext.broadcast(trees)
    name = free_name(docs, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the statistics are fitted as 32-bit floats
            score = held.value.score(batch_stats(batch.column("text")).astype(np.float32).astype(np.float64))
            out = batch.select(columns)
            out = pa.RecordBatch.from_arrays([*out.columns, pa.array(score)], [*out.schema.names, name])
            yield out if keep is None else out.filter(pa.array(score >= keep))

    taken = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema)
    return taken.mapInArrow(run, f"{kinds}, `{name}` double").withColumnRenamed(name, "score" if keep is None else name)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, held_out: tuple[int, int] = HELD_OUT, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, held_out=held_out, **how), ["doc_id"])
    mod, rem = held_out
    return out.select(
        "doc_id",
        F.coalesce(id_crc() % mod == rem, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= keep).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **how) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs."""
    return scored(docs, train(docs, labels, **how), docs.columns, keep).select(docs.columns)
