"""Language-model scoring: corpus counts for a smoothed unigram base, a GRU for the model's own score.

Tokens are the words of the whole text and one end token. Every training document counts towards the word
counts, which Spark sums by 64-bit word hash (words are told apart by that hash). The GRU predicts the
head words (the commonest; the end token is one) and one class for all others, inside which words have
their smoothed share of the remaining counts; the head grows with the vocabulary. The GRU learns every
segment of every training document in each round. Each partition trains on its own documents from the same
start; Spark averages the parameters, weighted by tokens, and the next round starts there. Whole documents are scored with the state carried from window to window.

What is broadcast is bounded: the model, and a table of LOOKUP slots with the commonest words' counts.
Words outside it are counted by a shuffled join.

Defined cases: a null text is empty and has the end token alone; a null doc_id counts as training;
repeated rows count and are scored each; without training documents every count is zero and only the
smoothing is left; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import gru
from inkfold.llm.tables import id_crc, materialize
from inkfold.llm.words import chunks, mix

HELD_OUT = (7, 2)
BLOCK = 32
LOOKUP = 1 << 20
COMMON = 1 << 18
END = np.uint64(1)
SEGMENT = 64
SLICE = 4096
PORTION = 3_000_000


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, offsets) of each chunk; every text ends with END."""
    for c in chunks(texts):
        sizes = np.diff(c.docs) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(offsets[-1], np.uint64)
        ends = np.zeros(offsets[-1], bool)
        ends[offsets[1:] - 1] = True
        out[ends], out[~ends] = END, c.hashes()
        yield c.first, out, offsets


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): occurrences of each token in docs, as counts of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, tokens, _ in tokens_of(batch.column(0)):
                held.append(tokens)
                if sum(map(len, held)) > 1 << 21:
                    yield summed(held)
                    held = []
        if held:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that `most` words reach at most: a histogram of counts is summed instead of sorting."""
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    histogram = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 20, 0
    for at, n in histogram:
        total += n
        if total > most:
            break
        least = at
    if histogram and least == 1 << 20:
        # more words than `most` are tied at the top: a share of them, by hash
        at, n = histogram[0]
        return counts.where((step == at) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int((1 << 20) * 0.9 * most / n)))
    return counts.where(step >= least)


class Words:
    """A direct-mapped table of common words; of two words for a slot the commoner has it."""

    def __init__(self, h: np.ndarray, c: np.ndarray, head: int):
        slot = (mix(h) >> np.uint64(44)).astype(np.int64)
        first = np.zeros(len(h), bool)
        first[np.unique(slot, return_index=True)[1]] = True
        self.key, self.count, self.rank = np.zeros(LOOKUP, np.uint64), np.zeros(LOOKUP, np.int64), np.full(LOOKUP, head, np.int32)
        self.key[slot[first]], self.count[slot[first]] = h[first], c[first]
        kept = np.flatnonzero(first)[:head]
        self.rank[slot[kept]] = np.arange(len(kept))
        self.head_counts = np.zeros(head)
        self.head_counts[: len(kept)] = c[kept]
        self.head_words = len(kept)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, rank) of each token: count 0 for a token outside the table, rank `head` for one outside the head."""
        slot = (mix(h) >> np.uint64(44)).astype(np.int64)
        known = self.key[slot] == h
        return np.where(known, self.count[slot], 0), np.where(known, self.rank[slot], len(self.head_counts))


def head_shape(distinct: int) -> tuple[int, int]:
    """Head words and words in a block for a vocabulary of `distinct` words.

    A class has two blocks (rare words need no look inside a class, so it may be wide), and there are as many
    classes as words in a block: both sides of the softmax grow with the fourth root of the vocabulary and
    the head with its square root, 2,048 words up to 2**20, then about twice the root.
    """
    block = max(BLOCK, int(np.ceil(distinct**0.25)))
    return 2 * block * block, block


def segments_of(rank: np.ndarray, opening: int) -> Iterator[np.ndarray]:
    """All segments of a text: the token before each (`opening` for the first), then its own."""
    padded = np.concatenate([np.array([opening], rank.dtype), rank])
    for k in range(0, len(rank), SEGMENT):
        yield padded[k : k + SEGMENT + 1]


def train(docs: DataFrame, words: Words, start: gru.Params, rounds: int = 2) -> gru.Params:
    """GRU parameters from every segment of docs in each round, averaged over partitions after it."""
    size = len(gru.flatten(start))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for batch in batches:
            for at, value, weight in zip(*(c.to_pylist() for c in batch.columns)):
                sums[at] = sums.get(at, 0) + np.frombuffer(value)
                weights[at] = weights.get(at, 0.0) + weight
        for at, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / weights[at]).tobytes()])], ["slice", "value"])

    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast((words, start))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table, p = held.value
            opening = len(p["input"]) - 1

            def segments() -> Iterator[np.ndarray]:
                for batch in batches:
                    for _, tokens, offsets in tokens_of(batch.column(0)):
                        rank = table.look_up(tokens)[1]
                        for i in range(len(offsets) - 1):
                            yield from segments_of(rank[offsets[i] : offsets[i + 1]], opening)

            p, seen = gru.train(p, segments())
            if seen:
                flat = gru.flatten(p).astype(np.float64) * seen
                for k in range(0, size, SLICE):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k // SLICE], pa.int32()), pa.array([flat[k : k + SLICE].tobytes()]), pa.array([float(seen)])], ["slice", "value", "weight"]
                    )

        parts = docs.select("text").mapInArrow(run, "slice int, value binary, weight double").repartition("slice")
        rows = sorted(parts.mapInArrow(mean, "slice int, value binary").collect())
        if rows:
            start = gru.unflatten(np.concatenate([np.frombuffer(r.value) for r in rows]), start)
    return start


def score(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, head: int | None = None, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    head: the GRU's words, a multiple of twice BLOCK; unless given, it grows with the vocabulary.
    """
    mod, rem = held_out
    is_held_out = F.coalesce(id_crc() % mod == rem, F.lit(False))
    training = docs.where(~is_held_out)
    counts = materialize(word_counts(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = commonest(counts, COMMON).toPandas().sort_values(["c", "h"], ascending=[False, True])
    head, block = (head, BLOCK) if head else head_shape(distinct)
    words = Words(common["h"].to_numpy(np.int64).view(np.uint64), common["c"].to_numpy(np.int64), head)
    rare_total, rare_distinct = total - int(words.head_counts.sum()), distinct - words.head_words
    model = train(training, words, gru.initial(words.head_counts, rare_total, block=2 * block), rounds)
    held = docs.sparkSession.sparkContext.broadcast((words, model))
    rare_norm, base_norm = np.log10(rare_total + rare_distinct + 1), np.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            held_tokens: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            done = 0
            for first, tokens, bounds in tokens_of(batch.column(1)):
                held_tokens.append(tokens)
                sizes.append(np.diff(bounds))
                at = first + len(bounds) - 1
                if sum(map(len, held_tokens)) > PORTION or at == batch.num_rows:
                    yield scored(batch.column(0).slice(done, at - done), np.concatenate(held_tokens), np.concatenate(sizes), part + row + done)
                    held_tokens, sizes, done = [], [], at
            row += batch.num_rows

    def scored(ids: pa.Array, tokens: np.ndarray, sizes: np.ndarray, row: int) -> pa.RecordBatch:
        table, p = held.value
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        count, rank = table.look_up(tokens)
        lost = np.flatnonzero(count == 0)
        logs = np.log10(count + 1.0)
        over = lambda x: np.add.reduceat(x.astype(np.float64), offsets[:-1])  # noqa: E731  every text has a token
        model_score = gru.score(p, rank, offsets) / np.log(10) + over(np.where(rank == head, logs - rare_norm, 0.0))
        bounds = np.searchsorted(lost, offsets).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(row + np.arange(len(sizes))),
                pa.array(sizes),
                pa.array(over(count > 0).astype(np.int64)),
                pa.array(over(logs) - base_norm * sizes),
                pa.array(model_score),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens[lost].view(np.int64))),
            ],
            ["doc_id", "row", "n_tokens", "n_known", "base", "model", "rest"],
        )

    seen = materialize(
        docs.select("doc_id", "text").mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, model double, rest array<long>"),
        "scored",
    )
    found = (
        seen.select("row", F.explode("rest").alias("h"))
        .join(counts, "h")
        .groupBy("row")
        .agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    )
    return seen.join(found, "row", "left").select(
        "doc_id",
        is_held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
