"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashed words, word pairs and pairs with one word left out between them,
each counted once. Words are runs of letters, digits and bytes from 0x80; A-Z count as a-z. Each
coordinate has its own learning rate, and L1 sets most weights to zero, so the model is a short list.

Training is online, over all labelled documents outside the held-out remainder. They are dealt by id hash to as many
learners as make about LEARNER documents for each, one task a learner, which takes its own in the order of their id hashes
(ties: by features and label); the model is the mean of the learners' weights. Every document is scored from its whole text.

Defined cases: a null or empty text has no feature but the bias; a null doc_id is scored and never held
out; without labels the score is one half; repeated rows score alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.tables import id_crc, labelled
from inkfold.llm.words import Chunk, chunks, mix, span_hashes, spans

LEARNER = 16_384
#: Labelled rows up to which they are sent to the documents instead of both being shuffled.
SENT = 500_000
HELD_OUT = (5, 0)
BUCKETS = 1 << 20
_NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def chunk_features(c: Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of the chunk; bucket 0 is kept for the bias."""
    starts, ends, first = spans(c.buf, c.offsets, _NO_WORD)
    h = span_hashes(c.buf, starts, ends)
    doc = np.repeat(np.arange(c.rows), np.diff(first))
    found, at = [h], [doc]
    for gap, seed in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = doc[:-gap] == doc[gap:]
        found.append(mix(h[:-gap] * np.uint64(seed) + h[gap:])[same])
        at.append(doc[:-gap][same])
    return np.concatenate(at), (np.concatenate(found) % np.uint64(buckets - 1)).astype(np.int64) + 1


class Ftrl:
    """Per-coordinate FTRL-proximal state for features that are there or not."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, learner: int = LEARNER, held_out: tuple[int, int] = HELD_OUT, epochs: int = 4, **how) -> pd.DataFrame:
    """(bucket, weight) of the weights that aren't zero."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # features go to a file of this task, so texts of any length are learnt in bounded memory
        with tempfile.TemporaryFile() as spool:
            rows, at = [], 0
            for batch in frames:
                ids, labels = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
                for c in chunks(batch.column("text")):
                    doc, bucket = chunk_features(c)
                    keys = np.unique(doc * BUCKETS + bucket)
                    bounds = np.searchsorted(keys, np.arange(c.rows + 1) * BUCKETS)
                    for i in range(c.rows):
                        features = np.append(np.int32(0), (keys[bounds[i] : bounds[i + 1]] % BUCKETS).astype(np.int32))
                        order = mix(np.array([ids[c.first + i]], np.int64).view(np.uint64))[0]
                        spool.write(features.tobytes())
                        rows.append((order, len(features), zlib.crc32(features.tobytes()), labels[c.first + i], at))
                        at += len(features)
            rows.sort()
            spool.flush()
            features = np.memmap(spool, np.int32, "r") if at else np.zeros(0, np.int32)
            model = Ftrl(**how)
            for _ in range(epochs):
                for _, n, _, label, first in rows:
                    model.learn(features[first : first + n], label)
            w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(w[kept])], ["bucket", "weight"])

    own = labelled(labels, "toxic", held_out)
    n = own.count()
    learners = max(1, round(n / learner))
    # other documents have no label to learn
    texts = docs.where(F.col("doc_id").isNotNull() & (id_crc() % held_out[0] != held_out[1])).select("doc_id", "text")
    if n <= SENT:
        dealt = texts.join(F.broadcast(own), "doc_id").repartition(learners, "doc_id")
    else:
        dealt = texts.repartition(learners, "doc_id").join(own.hint("shuffle_hash"), "doc_id")
    # whole parts of a weight, so that the order of learners changes nothing
    part = F.round(F.col("weight") * (1 << 40)).cast("long")
    found = dealt.mapInArrow(run, "bucket long, weight double")
    return found.groupBy("bucket").agg((F.sum(part) / F.lit(float(learners << 40))).alias("weight")).where("weight <> 0").toPandas()


def score(docs: DataFrame, weights: pd.DataFrame) -> DataFrame:
    """doc_id and score for every row of docs. weights: at most BUCKETS rows, sent to all executors."""
    held = docs.sparkSession.sparkContext.broadcast((weights["bucket"].to_numpy(), weights["weight"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS)
        table[held.value[0]] = held.value[1]
        for batch in batches:
            out = np.full(batch.num_rows, table[0])
            for c in chunks(batch.column("text")):
                doc, bucket = chunk_features(c)
                hit = np.flatnonzero(table[bucket])
                keys = np.unique(doc[hit] * BUCKETS + bucket[hit])
                out[c.first : c.first + c.rows] += np.bincount(keys // BUCKETS, table[keys % BUCKETS], c.rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, toxic: float = 0.5, held_out: tuple[int, int] = HELD_OUT, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    mod, rem = held_out
    return score(docs, train(docs, labels, held_out=held_out, **how)).select(
        "doc_id",
        F.coalesce(id_crc() % mod == rem, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxic).cast("int").alias("predicted"),
    )
