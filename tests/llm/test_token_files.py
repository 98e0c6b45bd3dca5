import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkfold.llm import token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_files_round_trip(spark, tmp_path):
    texts = [None, "", " a  b ", "one two\nthree", "日本 語　x", "x <|endoftext|> y", "<|endoftext|>", "w " * 3000, "tab\tand\r\n line", "one two\nthree"]
    rows = [(i * 7 - 3, t, "z") for i, t in enumerate(texts)] + [(None, "null id", "z"), (-3, "same id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = token_files.read(token_files.write(docs, VOCABULARY, f"file://{tmp_path}/t")).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    at, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(docs, VOCABULARY, f"file://{tmp_path}/e")).collect() == []


def test_pieces_of_one_word_are_encoded_once():
    encoder, sent = token_files.Encoder(VOCABULARY), []

    class Counted:
        def encode_batch_fast(self, texts, real=encoder.tokenizer, **more):
            sent.extend(texts)
            return real.encode_batch_fast(texts, **more)

    words = [f"bubble{i}" for i in range(200)]
    encoder.tokenizer = Counted()
    encoder.encode([" ".join(w + mark for w in words for mark in ("", ".", ",", "!!")), "\n".join(w + "." for w in words)])
    assert sum(t.count("bubble") for t in sent) <= 2 * len(words)  # after a space and after a line break
    encoder.encode([" ".join(w + "?" for w in words), "\n".join(words)])
    assert sum(t.count("bubble") for t in sent) <= 2 * len(words)


def test_ids_are_those_of_the_plain_call(monkeypatch):
    plain, rng = Tokenizer.from_file(VOCABULARY), random.Random(5)
    parts = ["a", "Zé", "it's", "'s", "'", "re", "×", "ß÷", "12", "3.5", "don't.", ",", "...", "##", "\t", "\x00", "\xa0", "\u3000", "日本", "\u200b", "e\u0301", "x" * 60, "<|endoftext|>", "Ċ", "Ġ"]
    texts = ["x a\t", "y b\t\nc", "y b ", "\n", " ", "a\n", "\na", "a\nb\nc", "a\n\nb", "a \nb", "a\n b", "a\r\nb", "'s 's", "a's\n's", "a,'s b.'s"]
    for cache in (400_000, 3, 0):
        monkeypatch.setattr(token_files, "CACHE", cache)
        encoder = token_files.Encoder(VOCABULARY)
        for _ in range(60):
            some = texts + ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " ", "\n", "  ", "\n\n", ".\n"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
            rng.shuffle(some)
            want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in some]
            assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(some)] == want
        assert len(encoder.memory) <= cache and all(len(p) <= 48 for p in encoder.memory)
