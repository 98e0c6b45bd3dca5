"""Topics from content: clusters of hashed TF-IDF vectors, by which every document is named.

Word weights come from the document frequencies of the whole table. Spherical k-means starts from centres that
are drawn and moved on the driver over a bounded sample (SAMPLE documents, by id hash); all else is told by all
documents: two rounds move each centre to the mean of what is nearest to it, and after the first centres with less
than LEAST of all documents with words are given up. Sums are whole numbers, so that the partitioning changes nothing.

Defined cases: a text without words has the topic NONE; without documents to start from every topic is NONE; rows
without an id take no part in the sample but in all else; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.tables import hash_sample
from inkfold.llm.words import Chunk, chunks

TOPICS = 12
LEAST = 0.02
SAMPLE = 2048
BUCKETS = 2048
NONE = "none"
ROWS = 1024
_FIXED = 1 << 20


def counts_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x BUCKETS word counts) of portions of texts."""
    for c in chunks(texts):
        bucket = (c.hashes() % np.uint64(BUCKETS)).astype(np.int64)
        for k in range(0, c.rows, ROWS):
            yield c.first + k, _table(c, bucket, k, min(k + ROWS, c.rows))


def _table(c: Chunk, bucket: np.ndarray, first: int, last: int) -> np.ndarray:
    words = slice(c.docs[first], c.docs[last])
    row = np.repeat(np.arange(last - first), np.diff(c.docs[first : last + 1]))
    return np.bincount(row * BUCKETS + bucket[words], minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Topics:
    idf: np.ndarray
    centres: np.ndarray  # topics x BUCKETS, unit length

    def nearest(self, counts: np.ndarray) -> np.ndarray:
        """The topic of each row; -1 for rows without words."""
        if not len(self.centres):
            return np.full(len(counts), -1)
        return np.where(counts.any(1), np.argmax(unit(counts, self.idf) @ self.centres.T, 1), -1)

    def of(self, text: Column) -> Column:
        """The name of each text's topic; texts go to Python once and only names come back."""
        model = self

        @F.arrow_udf("string")
        def name(texts: pa.Array) -> pa.Array:
            out = np.full(len(texts), -1)
            for first, counts in counts_of(texts):
                out[first : first + len(counts)] = model.nearest(counts)
            return pa.array([f"topic{t:02d}" if t >= 0 else NONE for t in out.tolist()])

        return name(text)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit rows; starts are spread out, each drawn by its distance to those before it."""
    rng = np.random.RandomState(seed)
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        far = np.maximum(1 - (x @ centres.T).max(1).astype(np.float64), 0)
        if far.sum() <= 1e-6:
            break
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=far / far.sum())]]])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[own == t].sum(0) for t in range(len(centres))])
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return centres


def fit(docs: DataFrame, k: int = TOPICS, sample: int = SAMPLE) -> Topics:
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, counts in counts_of(batch.column(0)):
                total[:-1] += (counts > 0).sum(0)
                total[-1] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["at", "n"])

    seen = np.zeros(BUCKETS + 1)
    for r in docs.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[r["at"]] = r["n"]
    idf = (np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1e-3).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts in counts_of(batch.column(1)):
                ids = batch.column(0).slice(first, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in unit(counts, idf)])], ["doc_id", "x"])

    chosen = hash_sample(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.x) for r in rows.mapInArrow(vectors, "doc_id long, x binary").collect())
    start = np.stack([np.frombuffer(x, np.float32) for _, x in got]) if got else np.zeros((0, BUCKETS), np.float32)
    start = start[(start != 0).any(1)]
    model = Topics(idf, cluster(start, k) if len(start) else start)
    centres, sizes = _moved(docs, model)
    # a handful of odd documents is no topic: their centres are given up, and they go to the next
    model = Topics(idf, centres[sizes >= LEAST * sizes.sum()])
    return Topics(idf, _moved(docs, model)[0])


def _moved(docs: DataFrame, model: Topics) -> tuple[np.ndarray, np.ndarray]:
    """Each centre moved to the mean of all documents that are nearest to it, and how many there are."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(model.centres.shape, np.int64), np.zeros(len(model.centres), np.int64)
        for batch in batches:
            for _, counts in counts_of(batch.column(0)):
                x, own = np.rint(unit(counts, model.idf) * _FIXED).astype(np.int64), model.nearest(counts)
                for t in np.unique(own[own >= 0]):
                    total[t] += x[own == t].sum(0)
                sizes += np.bincount(own[own >= 0], minlength=len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([x.tobytes() for x in total], pa.binary()), pa.array(sizes)], ["topic", "x", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for t, x, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total[t], size[t] = total.get(t, 0) + np.frombuffer(x, np.int64), size.get(t, 0) + n
        columns = [pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array(list(size.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["topic", "x", "n"])

    kind = "topic long, x binary, n long"
    centres, sizes = model.centres.copy(), np.zeros(len(model.centres), np.int64)
    for r in docs.select("text").mapInArrow(sums, kind).repartition("topic").mapInArrow(added, kind).collect() if len(centres) else []:
        x, sizes[r.topic] = np.frombuffer(r.x, np.int64).astype(np.float64), r.n
        if x.any():
            centres[r.topic] = x / np.sqrt((x * x).sum())
    return centres, sizes
