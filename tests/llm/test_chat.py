import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from inkfold.llm import chat

PIECES = st.lists(st.sampled_from(["<s>", "[", "]", "</s>", "[INST]", " [/user]</s>", "\\", " ", "x", "\n", "<s>[user] ", "[/", "é"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), max_size=4))
def test_turns_come_back_as_they_were(turns):
    rendered = [chat.render_turn(*t) for t in turns]
    assert chat.parse_conversation("".join(r[0] for r in rendered)) == turns
    for (_, text), (turn, start, end) in zip(turns, rendered):
        assert chat.unescaped(turn[start:end]) == text


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "a [1] <b>")[0].count("\\") == 1  # only the bracket that looks like a control
    assert chat.render_turn("user", "plain < text") == ("<s>[user] plain < text [/user]</s>", 10, 22)


@pytest.mark.parametrize("bad", ["x", "<s>[user", "<s>[user] a", "<s>[user] a [/assistant]</s>"])
def test_what_is_no_turn_is_refused(bad):
    with pytest.raises(ValueError):
        chat.parse_turn(bad)


def test_digests_against_brute_force(spark):
    conflict = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, None, None, "x"), (2, 0, "assistant", conflict), (None, 0, "user", "n"), (1, 1, "assistant", "a"), (3, 5, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_turns(df)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        want[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got == want
    assert chat.digests(chat.format_turns(df.limit(0))).collect() == []
