"""Token counts of whole texts, exactly as the tokenizers library gives them, in bounded memory.

A text of up to `CHUNK` characters is the sum of its pieces between spaces and line breaks, and each
distinct piece is encoded once per worker. That needs a vocabulary that drops white space (`by_pieces`
asks the tokenizer); with another one such texts are encoded whole.

A longer text is encoded in overlapping chunks with offsets, one after the other. Two neighbours are
spliced where that is proven to give the tokens of the whole text: at a place in their overlap where
both start a word (a match of the pre-tokenizer, or an added token), in front of a character that
normalisation never joins to what stands before it, and so far before the end of the first chunk that no
added token is cut. Up to there the first chunk is right, by induction from the start of the text; from
there on a pre-tokenizer that never looks back sees what it sees in the whole text. Where the overlap has
no such place (a word longer than the overlap, say) it is widened, and once it reaches back to the last
splice the first chunk is lengthened, at the worst to the end of the text.

Defined cases: a null text counts as empty and has no tokens; rows without an id and repeated rows are
counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 65_536, 256
#: What a worker remembers: so many pieces, none longer than this.
MEMORY, LONGEST = 800_000, 48


@cache
def joinable() -> frozenset[str]:
    """The characters that canonical composition may join to one before them, by the Unicode tables of this Python."""
    second = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul syllables
    for c in map(chr, range(sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    return frozenset(second)


def starts_afresh(c: str) -> bool:
    """Whether normalisation never joins the character to what stands before it, nor moves it there."""
    first = unicodedata.normalize("NFD", c)[0]
    return c.isascii() or (unicodedata.combining(first) == 0 and first not in joinable())


class Counter:
    """Counts and ids of texts by one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Characters that have to follow a splice inside the first chunk.
        self.margin = max(map(len, added), default=0) + 8
        self.by_pieces = self._drops_spaces(added)
        self.memory: dict[str, int] = {"": 0}
        self.widened = 0

    def _drops_spaces(self, added: list[str]) -> bool:
        """Whether a space or line break always parts words and is no part of a token."""
        lone = self.tokenizer.encode_batch([" ", "\n", "\n \n"], add_special_tokens=False)
        pairs = [("a", "a"), (".", "."), ("1", "1"), ("'", "s"), ("é", "́"), ("文", "字"), ("<|", "|>")]
        size = lambda x: len(self.tokenizer.encode(x, add_special_tokens=False).ids)
        return not any(e.ids for e in lone) and not any(" " in t or "\n" in t for t in added) and all(size(a + s + b) == size(a) + size(b) for a, b in pairs for s in " \n")

    def _encode(self, text: str) -> tuple[list[int], list[tuple[int, int]], list[int | None]]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets, e.word_ids

    @staticmethod
    def _word_starts(text: str, at: int, low: int, high: int, offsets: list, words: list) -> dict[int, int]:
        """Places of the text in [low, high) where a word of the chunk at `at` starts afresh, and the token there."""
        found = {}
        for i, (a, _) in enumerate(offsets):
            if low <= at + a < high and (i == 0 or words[i] != words[i - 1]) and starts_afresh(text[at + a]):
                found.setdefault(at + a, i)
        return found

    def long_ids(self, text: str) -> Iterator[list[int]]:
        """The ids of a long text, in runs that end where chunks are spliced."""
        start, end, good, overlap = 0, self.chunk, 0, self.overlap
        ids, offsets, words = self._encode(text[:end])
        first = 0  # the token from which this chunk counts; it stands at `good`
        while end < len(text):
            begin = end - overlap
            if begin <= good:  # nothing is left to look back to: this chunk has to be longer
                end = start + 2 * (end - start)
                ids, offsets, words = self._encode(text[start:end])
                overlap = self.overlap
                continue
            reach = begin + max(self.chunk, 2 * overlap)
            more = self._encode(text[begin:reach])
            here = self._word_starts(text, start, begin + 1, end - self.margin, offsets, words)
            there = self._word_starts(text, begin, begin + 1, end - self.margin, more[1], more[2])
            common = [p for p in here if p in there and p > good]
            if not common:
                overlap *= 4
                self.widened += 1
                continue
            good = max(common)
            yield ids[first : here[good]]
            (ids, offsets, words), first = more, there[good]
            start, end, overlap = begin, reach, self.overlap
        yield ids[first:]

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of the pieces that aren't remembered; those that are met first, and so are frequent, stay in memory."""
        fresh = list(pieces.difference(self.memory))
        found: dict[str, int] = {}
        for k in range(0, len(fresh), 4096):
            some = fresh[k : k + 4096]
            found.update(zip(some, (len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        if len(self.memory) + len(found) <= MEMORY:
            self.memory.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
        return found

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        short = []
        for i, text in enumerate(texts):
            if text and len(text) > self.chunk:
                out[i] = sum(map(len, self.long_ids(text)))
            elif text:
                short.append(i)
        if not self.by_pieces:
            for i, e in zip(short, self.tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
                out[i] = len(e.ids)
            return out
        cut = [(i, texts[i].replace("\n", " ").split(" ")) for i in short]
        fresh: set[str] = set()
        for _, pieces in cut:
            fresh.update(pieces)
        found = self._learn(fresh)
        known = self.memory.__getitem__
        if not self.memory.keys() >= found.keys():
            known = lambda p: found[p] if p in found else self.memory[p]
        for i, pieces in cut:
            out[i] = sum(map(known, pieces))
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter for the vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counted(docs: DataFrame, vocabulary: str, limit: int, group: int = 256) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every text.

    vocabulary: path of a tokenizers file on every executor. Texts are worked on in groups of `group` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            n = [x for k in range(0, batch.num_rows, group) for x in own.counts(texts.slice(k, group).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", size, "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
