"""Token ids in flat binary files that are memory-mapped when read.

A shard holds three flat files without headers, little-endian: `.ids` (unsigned 16 bits if the vocabulary
fits, else 32), `.off` (64-bit offsets of the documents in .ids, one more than there are documents) and
`.doc` (64-bit doc_ids). Documents are dealt to shards by ranges of doc_id, so shards in order give
documents in order; a shard's base is the prefix sum of the tokens before it. A task writes files named
by partition and attempt and hands their name to the manifest, so a repeated or lost attempt leaves
files that nothing names.

Special strings inside a text are ordinary text. A text is cut only where the tokenizer's own
pre-tokenizer always cuts (between a non-space and a single space before a non-space, on both sides of a
single line break, and in front of the marks that end a word), and a worker remembers the ids of the
first distinct pieces that it meets.

Defined cases: a null or empty text has the end id alone; rows with a null doc_id come first and are
written as the smallest 64-bit integer; equal doc_ids are ordered by text; an empty table gives an empty
manifest; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.tables import materialize

NULL_ID = -(2**63)
END_ID = 0
#: What a worker remembers: so many pieces, none longer than this; and the pieces that are encoded in one text.
CACHE, LONGEST, GROUP = 400_000, 48, 32
#: Characters known not to be white space for the pre-tokenizer: printable ASCII and Latin letters.
_PLAIN = "!-~À-ɏ"
_ASCII = bytes(range(ord(" "), ord("~") + 1)) + b"\n"
_LATIN = re.compile(rb"(?:[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])*")
_CUT = re.compile(f"(?<=[{_PLAIN}])(?= [{_PLAIN}])")
_PIECE = re.compile(f"\n?[{_PLAIN}]+")
_MARKS = "".join(c for c in map(chr, range(ord("!"), ord("~") + 1)) if not c.isalnum())


def _sure(text: str) -> bool:
    """Whether text is plain characters with single spaces or single line breaks between them."""
    if text[0] in " \n" or text[-1] in " \n" or any(run in text for run in ("  ", " \n", "\n ", "\n\n")):
        return False
    return _LATIN.fullmatch(text.encode().translate(None, _ASCII)) is not None


class Encoder:
    """Ids of texts as bytes; remembers the ids of pieces that it has met.

    A piece is what follows a space, without it, or what follows a line break, with it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # pieces are encoded as plain text; texts that hold a token's name go to the other one whole
        self.tokenizer, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.names = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.end = np.array([END_ID], self.kind).tobytes()
        self.line_break = self.tokenizer.token_to_id("Ċ")
        self.memory: dict[str, bytes] = {}

    def _ids(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the memory hasn't; what is met first, and so is frequent, stays in it."""
        memory, odd = self.memory, [p for p in pieces if not _PIECE.fullmatch(p)]
        found = dict(zip(odd, self._encode([" " + p for p in odd])))
        # marks that end a word are apart from it for the pre-tokenizer, and stand as after a line break
        fresh: dict[str, None] = {}
        marked = []
        for piece in pieces.difference(odd) if odd else pieces:
            stem = piece.rstrip(_MARKS)
            if len(stem) < len(piece) and stem[-1:].isalnum():
                marked.append(piece)
                fresh[stem] = fresh["\n" + piece[len(stem) :]] = None
            else:
                fresh[piece] = None
        parts = {p: memory[p] for p in fresh if p in memory}
        found.update(self._encode_plain([p for p in fresh if p not in parts]))
        parts |= found
        for piece in marked:
            stem = piece.rstrip(_MARKS)
            found[piece] = parts[stem] + parts["\n" + piece[len(stem) :]][self.width :]
        if len(memory) < CACHE:
            memory.update(islice((x for x in found.items() if len(x[0]) <= LONGEST), CACHE - len(memory)))
        return found

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each piece. Many go in one text: the pre-tokenizer makes each line break between them a token."""
        groups, width = [pieces[k : k + GROUP] for k in range(0, len(pieces), GROUP)], self.width
        texts = ["".join(p if p[0] == "\n" else "\n " + p for p in group) for group in groups]
        for group, raw in zip(groups, self._encode(texts)):
            at = (np.flatnonzero(np.frombuffer(raw, self.kind) == self.line_break) * width).tolist()
            for piece, a, b in zip(group, at, [*at[1:], len(raw)], strict=True):
                yield piece, raw[a:b] if piece[0] == "\n" else raw[a + width : b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id."""
        named = {i: text for i, text in enumerate(texts) if text and any(name in text for name in self.names)}
        if named:
            own = dict(zip(named, self.whole.encode_batch_fast(list(named.values()), add_special_tokens=False)))
            rest = iter(self.encode([text for i, text in enumerate(texts) if i not in named]))
            return [np.array(own[i].ids, self.kind).tobytes() + self.end if i in own else next(rest) for i in range(len(texts))]
        cut, heads, known = [], {}, self.memory.get
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                pieces = []
            elif _sure(text):
                # a text begins like a line
                pieces = text.replace("\n", " \n").split(" ")
                pieces[0] = "\n" + pieces[0]
            else:
                heads[i], *pieces = _CUT.split(text)
                pieces = [p[1:] for p in pieces]
            ids = list(map(known, pieces))
            gaps = [k for k, x in enumerate(ids) if x is None]
            fresh.update([pieces[k] for k in gaps])
            cut.append((pieces, ids, gaps))
        found, before, out = self._ids(fresh), dict(zip(heads, self._encode(list(heads.values())))), []
        for i, (pieces, ids, gaps) in enumerate(cut):
            for k in gaps:
                ids[k] = found[pieces[k]]
            whole = b"".join(ids)
            out.append((before[i] + whole if i in before else whole[self.width :]) + self.end)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _flat(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped where the folder is mounted, else read."""
    fs, path = _open(uri)
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def write(docs: DataFrame, vocabulary: str, folder: str, group: int = 64) -> DataFrame:
    """Write the shards below `folder` and return the manifest: one row per shard, in order, with its base.

    vocabulary: path of a tokenizers file on every executor. folder: a URI that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, name = task.partitionId(), f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        enc, offsets, ids = encoder(vocabulary), [np.zeros(1, np.int64)], []
        total, out = 0, None
        for batch in batches:
            texts = batch.column("text")
            if out is None:
                fs, path = _open(f"{name}.ids")
                fs.create_dir(os.path.dirname(path), recursive=True)
                out = fs.open_output_stream(path)
            for k in range(0, batch.num_rows, group):
                parts = enc.encode(texts.slice(k, group).to_pylist())
                offsets.append(total + np.cumsum([len(p) for p in parts]) // np.dtype(enc.kind).itemsize)
                total = int(offsets[-1][-1])
                out.write(b"".join(parts))
            ids.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        for ending, array in (("off", np.concatenate(offsets).astype("<i8")), ("doc", np.concatenate(ids).astype("<i8"))):
            with fs.open_output_stream(_open(f"{name}.{ending}")[1]) as f:
                f.write(array.tobytes())
        row = {"shard": [shard], "name": [name], "kind": [enc.kind], "n_docs": [sum(map(len, ids))], "n_tokens": [total]}
        yield pa.RecordBatch.from_pydict(row)

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialize(ranged.mapInArrow(run, "shard long, name string, kind string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; one task for each shard at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = (_flat(f"{row['name']}.{e}", k) for e, k in (("ids", row["kind"]), ("off", "<i8"), ("doc", "<i8")))
                for k in range(0, len(docs), 4096):
                    at = offsets[k : k + 4097].tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]
                    own = np.array(docs[k : k + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == NULL_ID),
                            pa.array(np.array(at[:-1], np.int64) + row["base"]),
                            pa.array(np.diff(np.array(at, np.int64))),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
