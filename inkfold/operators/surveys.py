"""Surveys of chapters as a table of what they found, and translation that starts from it.

A chapter's windows are read in order, each told what the windows before it found. What a chapter ends with is
rows of (chapter, part, place, name, value, note): its synopsis, register, beats, cast and terms, and, if a window
failed, why, with the window as place. `seeds` turns that into what a translation knows before its first page.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.context import BEAT, CAST_NOTE, NOTE, REGISTER, SURVEY_PAGES, SYNOPSIS
from inkfold.operators.folds import CAST, GLOSSARY
from inkfold.operators.models import Asker, _list, _object, _scene, _terms

FOUND = "chapter string, part string, place int, name string, value string, note string"


def page_windows(pages: DataFrame, size: int = SURVEY_PAGES) -> DataFrame:
    """(chapter, first, texts): the texts of `size` pages at a time, in order. pages: (chapter, page_no, text)."""
    window = F.floor(F.col("page_no") / size)
    gathered = pages.groupBy("chapter", window.alias("window")).agg(F.min("page_no").alias("first"), F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("listed"))
    return gathered.select("chapter", "first", F.transform("listed", lambda x: F.coalesce(x.text, F.lit(""))).alias("texts"))


def _said(found: dict, key: str, most: int) -> str:
    value = found.get(key)
    return value.strip()[:most] if isinstance(value, str) else ""


@dataclass
class Found:
    """What a chapter's windows have found so far."""

    synopsis: str = ""
    register: str = ""
    beats: list[str] = field(default_factory=list)
    cast: dict[str, tuple[str, str]] = field(default_factory=dict)
    terms: dict[str, tuple[str, str]] = field(default_factory=dict)

    def learn(self, reply: str, first: int, pages: int) -> None:
        """Beats go to their pages, or none do if they aren't one a page; of terms the last holds, in place; of people what was said last."""
        found = _object(reply)
        self.synopsis = _said(found, "synopsis", SYNOPSIS) or self.synopsis
        self.register = _said(found, "register", REGISTER) or self.register
        beats = _list(reply, "beats", pages) or []
        self.beats += [""] * (first - len(self.beats))
        self.beats[first : first + len(beats)] = [b.strip()[:BEAT] for b in beats]
        for term in found.get("terms") or []:
            if isinstance(term, dict) and (source := _said(term, "source", 10**6)) and (target := _said(term, "target", 10**6)):
                if source in self.terms or len(self.terms) < GLOSSARY:
                    self.terms[source] = (target, _said(term, "note", NOTE))
        for person in found.get("cast") or []:
            if isinstance(person, dict) and (name := _said(person, "name", 10**6)):
                if name not in self.cast and len(self.cast) >= CAST:
                    continue
                gender, note = self.cast.get(name, ("unknown", ""))
                told = person.get("gender")
                self.cast[name] = (told if told in ("male", "female") else gender, _said(person, "note", CAST_NOTE) or note)

    def told(self) -> dict:
        return {"synopsis": self.synopsis, "register": self.register, "beats": self.beats, "cast": [{"name": n, "gender": g, "note": note} for n, (g, note) in self.cast.items()], "terms": [{"source": s, "target": t, "note": n} for s, (t, n) in self.terms.items()]}

    def rows(self, chapter: str) -> Iterator[tuple]:
        for part, text in (("synopsis", self.synopsis), ("register", self.register)):
            if text:
                yield chapter, part, 0, None, text, None
        yield from ((chapter, "beat", i, None, b, None) for i, b in enumerate(self.beats))
        yield from ((chapter, "person", i, name, gender, note) for i, (name, (gender, note)) in enumerate(self.cast.items()))
        yield from ((chapter, "term", i, source, target, note) for i, (source, (target, note)) in enumerate(self.terms.items()))


def surveyed(windows: DataFrame, make: Callable[[], Asker]) -> DataFrame:
    """What each chapter's windows find, as FOUND. A chapter ends at the first window that fails; what was found before stands.

    windows: as page_windows gives them. A task makes its model once and holds what one chapter has found so far.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, chapter, found, why = make(), None, Found(), None

        def end() -> list[tuple]:
            return [] if chapter is None else [*found.rows(chapter), *([why] if why else [])]

        for frame in frames:
            out: list[tuple] = []
            for w in frame.itertuples(index=False):
                if w.chapter != chapter:
                    out += end()
                    chapter, found, why = w.chapter, Found(), None
                if why:
                    continue
                try:
                    found.learn(ask({"pages": list(w.texts), "first": int(w.first), "chapter": found.told()}), int(w.first), len(w.texts))
                except Exception as e:  # noqa: BLE001  the reason is a result
                    why = (chapter, "why", int(w.first), None, str(e)[:200], None)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
        yield pd.DataFrame(end(), columns=[c.split()[0] for c in FOUND.split(", ")])

    ordered = windows.select("chapter", "first", "texts").repartition("chapter").sortWithinPartitions("chapter", "first")
    return ordered.mapInPandas(run, FOUND)


def seeds(found: DataFrame) -> DataFrame:
    """(chapter, terms, people): what a translation is told before its first page, each in order."""
    entry = F.struct("place", "name", "value", "note")
    parts = found.where("part in ('term', 'person')").groupBy("chapter").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == part, entry))).alias(name) for part, name in (("term", "terms"), ("person", "people"))]
    )
    return parts.select("chapter", *[F.transform(c, lambda x: F.struct(x["name"].alias("name"), x.value.alias("value"))).alias(c) for c in ("terms", "people")])


def translated(pages: DataFrame, found: DataFrame, make: Callable[[], Asker], most: int = GLOSSARY) -> DataFrame:
    """(chapter, page_no, answer, known, people, scene): pages in order, from what the survey found and what earlier pages taught.

    The first of a term wins, so surveyed ones stand; `most` at most. pages: (chapter, page_no, text); found: FOUND. known:
    how many terms a page was told; people: who. A chapter without a survey starts from nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, chapter, terms, people, scene = make(), None, {}, [], ""
        for frame in frames:
            out = []
            for page in frame.itertuples(index=False):
                if page.chapter != chapter:
                    seeded = json.loads(page.seed) if page.seed else {}
                    chapter, scene = page.chapter, ""
                    terms = {t["name"]: t["value"] for t in seeded.get("terms") or []}
                    people = [p["name"] for p in seeded.get("people") or []]
                reply = ask({"lines": [page.text], "terms": dict(terms), "people": list(people), "scene": scene})
                got = _list(reply, "translations", 1)
                out.append((chapter, page.page_no, got[0] if got else "", len(terms), ", ".join(people), scene))
                for source, target in _terms(reply):
                    if source not in terms and len(terms) < most:
                        terms[source] = target
                scene = _scene(reply) or scene
            yield pd.DataFrame(out, columns=["chapter", "page_no", "answer", "known", "people", "scene"])

    told = seeds(found).select("chapter", F.to_json(F.struct("terms", "people")).alias("seed"))
    # the seed goes with the first page only
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("page_no"))
    rows = pages.select("chapter", "page_no", F.coalesce("text", F.lit("")).alias("text")).join(told, "chapter", "left").select("chapter", "page_no", "text", F.when(place == 1, F.col("seed")).alias("seed"))
    ordered = rows.repartition("chapter").sortWithinPartitions("chapter", "page_no")
    return ordered.mapInPandas(run, "chapter string, page_no int, answer string, known int, people string, scene string")
