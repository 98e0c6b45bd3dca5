r"""Chat formatting with a grammar round trip.

A conversation is rendered as

    <s>[ROLE] text [/ROLE]</s>        for every role but assistant
    <s>[ROLE] text [/ROLE]</s>        with its text under the loss mask for assistant

Grammar: turn := "<s>[" role "] " body " [/" role "]</s>". A body may hold anything but an unescaped
"<" or "["; a backslash makes the next character plain. The renderer first writes a body as it is and
parses the turn back. If the parser doesn't recover the same role and text (the text holds control
strings or backslashes), only the conflicting characters are escaped and the turn is parsed again, until
source and parse are identical. Every conversation is reparsed and compared; a difference that is left raises.

Defined cases: a null text or role is empty; turns are ordered by turn, ties by role and text, null turns
first; repeated rows are repeated turns; rows without conv_id are one conversation with a null id; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[", "]</s>"
MASKED = "assistant"
CONTROL = re.compile(r"<s>\[|</s>|\[/?[^\[\]<>]*\]")
SCHEMA = "conv_id long, turn_no long, formatted string, loss_start long, loss_end long"


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int]:
    """(role, text, end) of the turn that starts at `at`; ValueError if there is none."""
    if not text.startswith(OPEN, at):
        raise ValueError(f"no turn at {at}")
    role, at = _body(text, at + len(OPEN), "] ")
    body, at = _body(text, at, f" [/{_escaped(role, every=True)}{CLOSE}")
    return role, body, at


def _body(text: str, at: int, closing: str) -> tuple[str, int]:
    """Unescaped text from `at` to the first unescaped `closing`, and the place after it."""
    out = []
    start = at
    while True:
        end = text.find(closing, at)
        if end < 0:
            raise ValueError("a turn doesn't end")
        slash = text.find("\\", at, end)
        if slash < 0:
            out.append(text[start:end])
            return "".join(out), end + len(closing)
        out.append(text[start:slash])
        out.append(text[slash + 1 : slash + 2])
        start = at = slash + 2


def _escaped(text: str, every: bool = False) -> str:
    """Backslashes before backslashes and before the first character of control strings, or of all brackets."""
    text = text.replace("\\", "\\\\")
    if every:
        return re.sub(r"[<\[\] ]", lambda m: "\\" + m[0], text)
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(body: str) -> str:
    return re.sub(r"\\(.)", r"\1", body, flags=re.S)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as rendered, and where its body starts and ends in it."""
    head = f"{OPEN}{_escaped(role, every=True)}] "
    tail = f" [/{_escaped(role, every=True)}{CLOSE}"
    for body in (text, _escaped(text), re.sub(r"[<\[\\ ]", lambda m: "\\" + m[0], text)):
        if (CONTROL.search(body) and body is text) or (body.endswith("\\") and body is text):
            continue
        turn = head + body + tail
        try:
            if parse_turn(turn) == (role, text, len(turn)):
                return turn, len(head), len(head) + len(body)
        except ValueError:
            continue
    raise ValueError("a turn can't be told from its control strings")


def parse_conversation(text: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation, in order."""
    turns, at = [], 0
    while at < len(text):
        role, body, at = parse_turn(text, at)
        turns.append((role, body))
    return turns


def ordered(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation in one partition and in order; they are streamed, never gathered."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order within its conversation: the rendered turn and its loss span."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = object(), 0
        for frame in frames:
            out = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                conv = None if pd.isna(conv) else int(conv)
                n = n + 1 if conv == last else 0
                last = conv
                turn, start, end = render_turn(role, text)
                out.append((conv, n, turn, *((start, end) if role == MASKED else (None, None))))
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "formatted", "loss_start", "loss_end"]).astype(
                {"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"}
            )

    return ordered(conversations).mapInPandas(run, SCHEMA)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from the rendered turns alone: what a parser reads back, as counts and hashes.

    Turns must come as format_turns gives them. A conversation is streamed through running hashes, so
    its length doesn't matter to memory.
    """
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    class Running:
        def __init__(self, conv):
            self.conv, self.n, self.loss_n, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted, start, end):
            for role, text in parse_conversation(formatted):
                self.n += 1
                self.all.update(f"{role}\n{text}\n".encode())
            if not pd.isna(start):
                under = unescaped(formatted[int(start) : int(end)])
                self.loss_n += len(under)
                self.loss.update(under.encode())
            self.chars += len(formatted)

        def row(self):
            return self.conv, self.n, self.all.hexdigest(), self.loss_n, self.loss.hexdigest(), self.chars

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for frame in frames:
            done = []
            for conv, formatted, start, end in zip(frame["conv_id"], frame["formatted"], frame["loss_start"], frame["loss_end"]):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = Running(conv)
                now.add(formatted, start, end)
            yield pd.DataFrame(done, columns=fields).astype({"conv_id": "Int64"})
        if now:
            yield pd.DataFrame([now.row()], columns=fields).astype({"conv_id": "Int64"})

    return turns.mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
