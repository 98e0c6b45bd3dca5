"""Deterministic stand-ins for models, for the queries and tests alone: what they answer can be told in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from inkfold.operators.models import Asker, Detector, Reader


def fake_asker() -> Asker:
    """Answers each line in angle brackets. It drops a line of requests of 3, 6, 9... lines until told, and of 10, 20... lines always.

    A first request of an even number of lines gets a term, a complaint another, each with a scene.
    """

    def ask(request: dict) -> str:
        if "pages" in request:
            return json.dumps({"beats": [f"beat {i}" for i in range(request["count"])], "synopsis": request["synopsis"] + "."})
        lines = [f"<{x}>" for x in request["lines"]]
        n = len(lines)
        short = n > 1 and (n % 10 == 0 or (n % 3 == 0 and "complaint" not in request))
        told = "again" if "complaint" in request else "first" if n % 2 == 0 else ""
        more = {"terms": [{"source": told, "target": "t"}], "story": {"scene": f" {told} "}} if told else {}
        return "Sure: " + json.dumps({"translations": lines[: n - 1] if short else lines} | more)

    return ask


def fake_detector() -> Detector:
    """A block at a place that depends on the page's length; empty pages fail."""

    def detect(page: bytes) -> list[tuple[int, float, int, int, int, int]]:
        if not page:
            raise ValueError("empty page")
        n = len(page) % 100
        return [(1, 0.9, n, n, n + 40, n + 60), (0, 0.8, max(0, n - 10), max(0, n - 10), n + 60, n + 80)]

    return detect


def fake_reader() -> Reader:
    return lambda crop, language: f"{language} {len(crop)}"


def fake_slice_reader(language: str) -> Callable[[np.ndarray], str]:
    """Tells the language and the size of what it was given."""
    return lambda image: f" {language}{image.shape[1]}x{image.shape[0]} "


def fake_segmenter(side: int = 64) -> Callable[[bytes], list[np.ndarray]]:
    """Ink in the upper quarter of the map for pages of even length, else none; empty pages give no map."""

    def segment(page: bytes) -> list[np.ndarray]:
        box = np.zeros((1, 5), np.float32)
        if not page:
            return [box]
        found = np.zeros((1, 1, side, side), np.float32)
        found[..., : side // 4, :] = 0.9 if len(page) % 2 == 0 else 0.1
        return [box, found]

    return segment


def fake_term_asker() -> Asker:
    """Answers in angle brackets; gives a line's first character as a term and, for lines of even length, its last as the scene."""

    def ask(request: dict) -> str:
        line = request["lines"][0]
        return json.dumps({"translations": [f"<{line}>"], "terms": [{"source": line[:1], "target": "t"}], "story": {"scene": line[-1:] if len(line) % 2 == 0 else " "}})

    return ask


def pixel_detector() -> Detector:
    """The box of the pixels over 215 of an 8 by 8 page, then that of those over 128, each scored by how many there are."""

    def detect(page: bytes) -> list[tuple[int, float, int, int, int, int]]:
        grey, found = np.frombuffer(page, np.uint8).reshape(8, 8), []
        for label, over in ((1, 215), (0, 128)):
            ys, xs = np.nonzero(grey > over)
            if not len(ys):
                raise ValueError("blank page")
            found.append((label, len(ys) / 64, int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1))
        return found

    return detect


def pixel_reader() -> Reader:
    """Tells the sum of all pixels, and their sum by place."""
    return lambda crop, language: f"{language} {sum(crop)} {sum(i * g for i, g in enumerate(crop))}"


def pixel_segmenter() -> Callable[[bytes], list[np.ndarray]]:
    """Each pixel's brightness as the probability of ink, among outputs of other shapes."""
    return lambda page: [np.zeros((1, 5), np.float32), np.frombuffer(page, np.uint8).reshape(1, 1, 8, 8) / 255]
