"""Counts against the plain library call, spliced ids against whole ones, and the defined cases."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from inkfold.llm import token_counts
from inkfold.llm.tables import read

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def spliced(counter, text):
    return [x for run in counter.long_ids(text) for x in run]


PARTS = ["word", " ", "\n", "\t", " ", "　", "e", "́", "é", "Å", "Å", "ᄀ", "ᅡ", "ᆨ", "한", "文字", "が", "İ", "don't", "'", "'s", "...", "1234", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", "\U0001f600", "क्ष", "\x1c", "\x00", "x" * 40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_pieces_and_splices_equal_the_plain_call(text):
    counter = token_counts.counter(PATH)
    plain = counter.tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.by_pieces and counter.counts([text]) == [len(plain)]
    small = small_counter(48, 8)
    assert spliced(small, text) == plain


_small = {}


def small_counter(chunk, overlap):
    if (chunk, overlap) not in _small:
        _small[chunk, overlap] = token_counts.Counter(PATH, chunk, overlap)
    return _small[chunk, overlap]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (256, 32), (1000, 40)])
def test_long_texts_of_many_kinds(plain, chunk, overlap):
    rng = random.Random(5)
    counter = small_counter(chunk, overlap)
    for parts in (PARTS, [" ", "x" * 40], ["か", "゙", "文"], ["<|endoftext|>", "<|endof"], ["e", "́"], ["1"], ["."]):
        text = "".join(rng.choice(parts) for _ in range(3000))
        assert spliced(counter, text) == plain(text)


def test_an_overlap_without_a_word_start_is_widened(plain):
    counter = token_counts.Counter(PATH, 400, 16)
    text = ("b" * 90 + " ") * 100
    assert spliced(counter, text) == plain(text)
    assert counter.widened > 0
    one = "c" * 9000  # a single word: the chunk grows to the whole text
    assert spliced(counter, one + " end") == plain(one + " end")


def test_memory_is_bounded_and_long_pieces_are_not_kept(plain, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 5)
    counter = token_counts.Counter(PATH)
    texts = [" ".join(f"w{i}" for i in range(50)), "y" * 500 + " w1 w49", "w3"]
    assert counter.counts(texts) == [len(plain(x)) for x in texts]
    assert counter.counts(texts) == [len(plain(x)) for x in texts]
    assert len(counter.memory) <= 5 and not any(len(p) > token_counts.LONGEST for p in counter.memory)


def test_a_vocabulary_with_spaces_is_encoded_whole():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert not counter.by_pieces
    texts = ["a b  c\n d", "", None, "Hello world"]
    assert counter.counts(texts) == [len(counter.tokenizer.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_defined_cases(spark, plain):
    long = "Some <|endoftext|> words, here. " * 3000
    rows = [(1, "A b\nc", "x"), (1, "A b\nc", "x"), (2, None, "x"), (3, "", None), (None, "café", "y"), (4, long, "z"), (5, "あ" * 40000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.counted(docs, PATH, 2048).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(plain(t or "")), n > 2048) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.counted(docs.limit(0), PATH, 2048).count() == 0


def test_query_equals_the_plain_call_on_every_row(spark, plain):
    from inkfold.llm.queries import QUERIES

    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    want = {}
    for r in read(spark, SF, "documents").select("doc_id", "text").collect():
        n = len(plain(r.text or ""))
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 2048)
    assert got == want
