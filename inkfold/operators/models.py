"""Stages that call a model: detection, reading, translation and surveys, with the model passed in.

A model is a function that makes one (called once per Python worker and task), so weights load where they
run. No model is part of this library.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions import raster

Reply = dict


class Detector(Protocol):
    def __call__(self, page: bytes) -> list[tuple[int, float, int, int, int, int]]: ...


class Reader(Protocol):
    def __call__(self, crop: bytes, language: str) -> str: ...


class Asker(Protocol):
    def __call__(self, request: dict) -> str: ...


def detected(pages: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """(page_id, det_id, label, score, x0..y1, why): a page that fails gives one row with the reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for page_id, data in zip(frame["page_id"], frame["data"]):
                try:
                    rows += [(page_id, i, *found, None) for i, found in enumerate(model(bytes(data)))]
                except Exception as e:  # noqa: BLE001  the reason is the result
                    rows.append((page_id, None, None, None, None, None, None, None, str(e)[:200]))
            out = pd.DataFrame(rows, columns=["page_id", "det_id", "label", "score", "x0", "y0", "x1", "y1", "why"])
            yield out.astype({c: "Int32" for c in ("det_id", "label", "x0", "y0", "x1", "y1")})

    return pages.select("page_id", "data").mapInPandas(run, "page_id long, det_id int, label int, score double, x0 int, y0 int, x1 int, y1 int, why string")


def read(crops: DataFrame, make: Callable[[], Reader], least: int = 4) -> DataFrame:
    """Adds text to crops (w, h, data, language): '' for those too small to read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            texts = [
                "" if w < least or h < least else model(bytes(data), language)
                for w, h, data, language in zip(frame["w"], frame["h"], frame["data"], frame["language"])
            ]
            yield frame[["page_id", "ord"]].assign(text=texts)

    return crops.select("page_id", "ord", "w", "h", "data", "language").mapInPandas(run, "page_id long, ord int, text string")


def read_slices(crops: DataFrame, make: Callable[[str], Callable[[np.ndarray], str]], whole: tuple[str, ...], unspaced: tuple[str, ...]) -> DataFrame:
    """(page_id, ord, text): crops (grey, ink: arrays of h rows of w) read line by line.

    Languages in `whole` are read in one piece, others slice by slice, joined by blanks unless in `unspaced`. A task
    makes a language's model when it first meets it, once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Callable[[np.ndarray], str]] = {}
        for frame in frames:
            texts = []
            for w, h, grey, ink, language in zip(frame["w"], frame["h"], frame["grey"], frame["ink"], frame["language"]):
                if language not in models:
                    models[language] = make(language)
                image = np.reshape(grey, (h, w))
                parts = [(0, 0, w, h)] if language in whole else raster.slices(np.reshape(ink, (h, w)))
                read_parts = [models[language](image[y0:y1, x0:x1]).strip() for x0, y0, x1, y1 in parts]
                texts.append(("" if language in unspaced else " ").join(x for x in read_parts if x))
            yield frame[["page_id", "ord"]].assign(text=texts)

    return crops.select("page_id", "ord", "w", "h", "grey", "ink", "language").mapInPandas(run, "page_id long, ord int, text string")


def segmented(pages: DataFrame, make: Callable[[], Callable[[bytes], list[np.ndarray]]], grow: int = 4) -> DataFrame:
    """(page_id, mask, ink, why): the ink of pages (page_id, width, height, data) as PNG masks and how many pixels it has.

    Of a model's outputs the one shaped like a square map of one value a pixel is the map of probabilities, over the
    page with its longer side to the map's. A page that fails gives the reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for page_id, w, h, data in zip(frame["page_id"], frame["width"], frame["height"], frame["data"]):
                try:
                    maps = [x.squeeze() for x in model(bytes(data))]
                    chosen = [x for x in maps if x.ndim == 2 and x.shape[0] == x.shape[1] > 1]
                    if not chosen:
                        raise ValueError("no map")
                    mask = raster.page_mask(chosen[0], int(h), int(w), grow)
                    rows.append((page_id, raster.png(mask), int((mask > 0).sum()), None))
                except Exception as e:  # noqa: BLE001  the reason is the result
                    rows.append((page_id, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["page_id", "mask", "ink", "why"]).astype({"ink": "Int64"})

    return pages.select("page_id", "width", "height", "data").mapInPandas(run, "page_id long, mask binary, ink long, why string")


def _list(reply: str, key: str, wanted: int) -> list[str] | None:
    try:
        found = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])[key]
    except (ValueError, KeyError, TypeError):
        return None
    return [str(x) for x in found] if isinstance(found, list) and len(found) == wanted else None


def _asked(lines: list[str], ask: Asker) -> tuple[list[str], list[str]]:
    """A text for each line and all replies: asked once, once more with its reply and a complaint, then line by line."""
    request, replies = {"lines": lines}, []

    def told(more: dict, wanted: int) -> list[str] | None:
        replies.append(ask(request | more))
        return _list(replies[-1], "translations", wanted)

    got = told({}, len(lines))
    if got is None:
        got = told({"before": replies[-1], "complaint": f"{len(lines)} are wanted"}, len(lines))
    if got is None:
        got = [(told({"lines": [line]}, 1) or [""])[0] for line in lines]
    return got, replies


def answers(lines: list[str], ask: Asker) -> tuple[list[str], int]:
    """A text for each line and how often the model was asked."""
    got, replies = _asked(lines, ask)
    return got, len(replies)


def translated(asked: DataFrame, make: Callable[[], Asker]) -> DataFrame:
    """(page_id, n, answer, asks, terms, scene) for lines as asked_once gives them: (page_id, n, text).

    A request is one page's distinct lines. A task makes its model once and takes one page after the other.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, held, out = make(), [], []
        for frame in frames:
            for row in zip(frame["page_id"].tolist(), frame["n"].tolist(), frame["text"].tolist()):
                if held and held[0][0] != row[0]:
                    out += told(held, ask)
                    held = []
                held.append(row)
            if out:
                yield table(out)
                out = []
        if held:
            yield table(told(held, ask))

    def told(page: list[tuple], ask: Asker) -> list[tuple]:
        texts, replies = _asked([text for _, _, text in page], ask)
        # terms and scene are those of the first reply that had any
        terms, scene = next(filter(None, map(_terms, replies)), []), next(filter(None, map(_scene, replies)), "")
        sources = json.dumps([source for source, _ in terms], ensure_ascii=False)
        return [(page_id, n, text, len(replies), sources, scene) for (page_id, n, _), text in zip(page, texts)]

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["page_id", "n", "answer", "asks", "terms", "scene"])

    pages = asked.select("page_id", "n", "text").repartition("page_id").sortWithinPartitions("page_id", "n")
    return pages.mapInPandas(run, "page_id long, n int, answer string, asks int, terms string, scene string")


def surveyed(windows: DataFrame, make: Callable[[], Asker]) -> DataFrame:
    """(chapter, page_no, beat): windows in order, each told what came before; the chapter ends at the first that fails.

    A window whose beats don't fit its pages gives none. windows: (chapter, window, first, pages, text). A
    task makes its model once; of a chapter it holds what was told so far, not the windows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, chapter, synopsis, failed = make(), None, "", False
        for frame in frames:
            out = []
            for w in frame.itertuples(index=False):
                if w.chapter != chapter:
                    chapter, synopsis, failed = w.chapter, "", False
                if failed:
                    continue
                try:
                    reply = ask({"pages": w.text, "count": int(w.pages), "synopsis": synopsis})
                except Exception:  # noqa: BLE001  what was told so far stands
                    failed = True
                    continue
                try:
                    synopsis = json.loads(reply).get("synopsis") or synopsis
                except ValueError:
                    pass
                beats = _list(reply, "beats", int(w.pages)) or []
                out += [(chapter, int(w.first) + i, b) for i, b in enumerate(beats)]
            yield pd.DataFrame(out, columns=["chapter", "page_no", "beat"])

    ordered = windows.repartition("chapter").sortWithinPartitions("chapter", "window")
    return ordered.mapInPandas(run, "chapter string, page_no int, beat string")


def carried(pages: DataFrame, make: Callable[[], Asker], most: int = 40) -> DataFrame:
    """(chapter, page_no, answer, known, scene): pages in order, each told the terms and the scene that earlier pages gave.

    The first of a term wins, `most` at most; a blank scene keeps the held one. pages: (chapter, page_no, text).
    A task makes its model once; of a chapter it holds the terms and the scene only. known and scene: what the
    page was told.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, chapter, terms, scene = make(), None, {}, ""
        for frame in frames:
            out = []
            for page in frame.itertuples(index=False):
                if page.chapter != chapter:
                    chapter, terms, scene = page.chapter, {}, ""
                reply = ask({"lines": [page.text], "terms": dict(terms), "scene": scene})
                got = _list(reply, "translations", 1)
                out.append((chapter, page.page_no, got[0] if got else "", len(terms), scene))
                for source, target in _terms(reply):
                    if source not in terms and len(terms) < most:
                        terms[source] = target
                scene = _scene(reply) or scene
            yield pd.DataFrame(out, columns=["chapter", "page_no", "answer", "known", "scene"])

    ordered = pages.select("chapter", "page_no", "text").repartition("chapter").sortWithinPartitions("chapter", "page_no")
    return ordered.mapInPandas(run, "chapter string, page_no int, answer string, known int, scene string")


def _object(reply: str) -> dict:
    try:
        return json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
    except ValueError:
        return {}


def _scene(reply: str) -> str:
    story = _object(reply).get("story")
    scene = story.get("scene") if isinstance(story, dict) else ""
    return scene.strip() if isinstance(scene, str) else ""


def _terms(reply: str) -> list[tuple[str, str]]:
    found = _object(reply).get("terms") or []
    return [(t["source"], t["target"]) for t in found if isinstance(t, dict) and t.get("source") and t.get("target")]


def catalogue(answers: DataFrame, field: str) -> DataFrame:
    """(model): the named models of a server's answers, by name."""
    read = F.from_json(field, "models array<struct<name:string>>")
    return answers.select(F.explode(read["models"]["name"]).alias("model")).where("model <> ''").distinct().orderBy("model")
