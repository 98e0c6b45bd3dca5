"""Strict reading of whole requests: a nested shape over VARIANT gives the first fault and its place, or the values.

A shape has `fault(v, path)`, the first thing wrong with a VARIANT as `path: reason` (null if nothing is), and
`value(v)`, what it holds once it is sound. Both are expressions. Where replies of a model are read leniently (see
jsonx), a caller's request is refused whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.functions.jsonx import GENDERS
from inkfold.operators.context import BEAT, CAST_NOTE, NOTE, REGISTER, SCENE, SYNOPSIS
from inkfold.operators.folds import BEATS, CAST, GLOSSARY

KINDS = ("speech", "free")
FACTS = ("gender", "note")
FILLS = ("art", "white")


_KINDS_OF_JSON = {"OBJECT": "object", "ARRAY": "list", "STRING": "text", "BOOLEAN": "boolean", "VOID": "nothing"}


def kind_of(v: Column) -> Column:
    """What a VARIANT is: `object`, `list`, `text`, `number`, `boolean`, or `nothing` if it is null or missing."""
    # the schema is told once; it grows with all that v holds
    said = F.substring_index(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "<", 1)
    names = F.create_map(*[F.lit(x) for pair in _KINDS_OF_JSON.items() for x in pair])
    return F.coalesce(F.try_element_at(names, said), F.lit("number"))


def _text(v: Column) -> Column:
    """A text stripped, anything else as JSON; '' if there is nothing, or it is 0, false or empty."""
    empty = (kind_of(v) == "number") & (F.try_variant_get(v, "$", "double") == 0) | F.coalesce(F.to_json(v).isin("false", "{}", "[]"), F.lit(False))
    said = t.strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
    return F.when(kind_of(v) == "text", said).when(empty, "").otherwise(said)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _at(path: Column, reason: str) -> Column:
    return F.concat(path, F.lit(f": {reason}"))


class Shape:
    """Base of all shapes."""

    def fault(self, v: Column, path: Column) -> Column:
        raise NotImplementedError

    def value(self, v: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Shape):
    """A text of at most `most` characters once stripped; longer ones are cut.

    needed: it mustn't be blank. only: nothing but a text will do. else_blank: what is no text counts as ''.
    """

    most: int | None = None
    needed: str | None = None
    only: str | None = None
    else_blank: bool = False

    def fault(self, v: Column, path: Column) -> Column:
        out = F.lit(None).cast("string")
        if self.needed:
            out = F.when(_text(v) == "", _at(path, self.needed)).otherwise(out)
        return F.when(kind_of(v) != "text", _at(path, self.only)).otherwise(out) if self.only else out

    def value(self, v: Column) -> Column:
        said = F.when(kind_of(v) == "text", _text(v)).otherwise("") if self.else_blank else _text(v)
        return F.substring(said, 1, self.most) if self.most else said


@dataclass(frozen=True)
class Line(Shape):
    """Any scalar as text, as it stands."""

    def fault(self, v: Column, path: Column) -> Column:
        return F.lit(None).cast("string")

    def value(self, v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


@dataclass(frozen=True)
class OneOf(Shape):
    """One of a closed set; `blank` stands for nothing or '', where that is allowed."""

    values: tuple[str, ...]
    blank: str | None = None

    def fault(self, v: Column, path: Column) -> Column:
        said = F.try_variant_get(v, "$", "string")
        fits = (kind_of(v) == "text") & said.isin(*self.values)
        if self.blank is not None:
            fits = fits | (kind_of(v) == "nothing") | ((kind_of(v) == "text") & (said == ""))
        return F.when(~F.coalesce(fits, F.lit(False)), _at(path, f"none of {', '.join(self.values)}"))

    def value(self, v: Column) -> Column:
        said = F.try_variant_get(v, "$", "string")
        return said if self.blank is None else F.coalesce(F.nullif(said, F.lit("")), F.lit(self.blank))


@dataclass(frozen=True)
class Whole(Shape):
    """A whole number, also as text; a number is cut to one, what is below `least` becomes it."""

    least: int = 0

    def _number(self, v: Column) -> Column:
        told = F.try_variant_get(v, "$", "string")
        text = F.regexp_extract(t.strip(told), r"^([+-]?\d+)$", 1)
        wide = F.try_variant_get(v, "$", "double")
        number = F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).otherwise((F.floor(F.abs(wide)) * F.signum(wide)).try_cast("bigint"))
        return F.when(kind_of(v) == "text", F.nullif(text, F.lit("")).try_cast("bigint")).when(kind_of(v) == "number", number).when(kind_of(v) == "boolean", F.try_variant_get(v, "$", "boolean").cast("bigint"))

    def fault(self, v: Column, path: Column) -> Column:
        return F.when(self._number(v).isNull(), _at(path, "not a whole number"))

    def value(self, v: Column) -> Column:
        return F.greatest(F.lit(self.least).cast("bigint"), self._number(v))


@dataclass(frozen=True)
class ListOf(Shape):
    """A list; its first bad element is the fault.

    most: how many are taken. kept: which values stay, the others are passed over. read: how many are looked at at all.
    absent: nothing, or anything empty, counts as an empty list.
    """

    each: Shape
    reason: str = "not a list"
    most: int | None = None
    kept: Callable[[Column], Column] | None = None
    read: int | None = None
    absent: bool = False

    def _items(self, v: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.slice(items, 1, self.read) if self.read else items

    def _empty(self, v: Column) -> Column:
        """What has no value: nothing, '', 0, false, {} and []."""
        return (kind_of(v) == "nothing") | F.coalesce(F.to_json(v).isin('""', "0", "false", "{}", "[]"), F.lit(False))

    def fault(self, v: Column, path: Column) -> Column:
        inside = F.transform(self._items(v), lambda e, i: self.each.fault(e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        first = F.get(F.filter(inside, lambda f: f.isNotNull()), 0)
        wrong = _at(path, self.reason)
        # an empty list has no fault inside, so lists needn't be told from it
        return F.when(kind_of(v) != "list", F.when(~self._empty(v), wrong) if self.absent else wrong).otherwise(first)

    def value(self, v: Column) -> Column:
        found = F.transform(self._items(v), self.each.value)
        found = F.filter(found, self.kept) if self.kept else found
        found = F.slice(found, 1, self.most) if self.most else found
        return F.coalesce(found, F.filter(F.transform(F.array(v), self.each.value), lambda x: F.lit(False))) if self.absent else found


@dataclass(frozen=True)
class Obj(Shape):
    """An object with members of given shapes, tested in their order; others are ignored."""

    members: dict[str, Shape] = field(hash=False)
    reason: str = "not an object"

    def fault(self, v: Column, path: Column) -> Column:
        inside = F.coalesce(*[shape.fault(_member(v, name), F.concat(path, F.lit(f".{name}"))) for name, shape in self.members.items()])
        return F.when(kind_of(v) != "object", _at(path, self.reason)).otherwise(inside)

    def value(self, v: Column) -> Column:
        return F.struct(*[shape.value(_member(v, name)).alias(name) for name, shape in self.members.items()])


@dataclass(frozen=True)
class Default(Shape):
    """A member that may be missing altogether; then it is `otherwise`. A null that is there is not missing."""

    shape: Shape
    otherwise: str

    def fault(self, v: Column, path: Column) -> Column:
        return F.when(v.isNotNull(), self.shape.fault(v, path))

    def value(self, v: Column) -> Column:
        return F.when(v.isNull(), F.lit(self.otherwise)).otherwise(self.shape.value(v))


TERMS = ListOf(Obj({"source": Text(only="needed"), "target": Text(only="needed"), "note": Text(NOTE, else_blank=True)}), kept=lambda x: (x.source != "") & (x.target != ""))
PERSON = Obj({"name": Text(needed="no name"), "gender": Default(OneOf(GENDERS), "unknown"), "settled": ListOf(OneOf(FACTS), absent=True), "note": Text(CAST_NOTE)})
PEOPLE = ListOf(PERSON, most=CAST, absent=True)
STORY = Obj({"scene": Text(SCENE), "cast": PEOPLE})
CHAPTER = Obj({"beats": ListOf(Text(BEAT), read=BEATS, absent=True), "cast": PEOPLE, "terms": ListOf(TERMS.each, kept=TERMS.kept, absent=True), "synopsis": Text(SYNOPSIS), "register": Text(REGISTER)})
PAGES = ListOf(ListOf(Line()))
BUDGETS = ListOf(Whole())
KINDS_OF_LINES = ListOf(OneOf(KINDS, blank=""))
#: How many terms a prompt takes in.
MOST_TERMS = GLOSSARY


def fault(raw: Column, shape: Shape, name: str, v: Column | None = None) -> Column:
    """Why a request field (JSON text) is refused; null if it isn't, or wasn't sent. v: raw parsed, where that is a column already."""
    v = F.try_parse_json(raw) if v is None else v
    # a JSON null is a value, text that is no JSON is none
    return F.when(raw.isNull(), None).when(v.isNull(), f"{name}: not JSON").otherwise(shape.fault(v, F.lit(name)))


def choice(raw: Column, values: tuple[str, ...], name: str) -> Column:
    """The same for a plain field out of a closed set, such as a fill."""
    return F.when(raw.isNotNull() & ~F.lower(t.strip(raw)).isin(*values), f"{name}: none of {', '.join(values)}")


def beside(raw: Column, texts: Column, shape: ListOf, name: str) -> Column:
    """The same for a list that lies beside `texts` (an array): its length has to be theirs, and is never padded."""
    n = F.size(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"))
    off = F.concat(F.lit(f"{name}: "), n.cast("string"), F.lit(" for "), F.size(texts).cast("string"), F.lit(" texts"))
    not_a_list = F.when(raw.isNotNull() & (kind_of(F.try_parse_json(raw)) != "list"), f"{name}: not a list")
    return F.coalesce(F.when(raw.isNotNull() & F.try_parse_json(raw).isNull(), f"{name}: not JSON"), not_a_list, F.when(n != F.size(texts), off), fault(raw, shape, name))


def value(raw: Column, shape: Shape, why: Column | None = None, v: Column | None = None) -> Column:
    """What a request field holds; null if it is refused or wasn't sent. why, v: its fault and raw parsed, where those are columns already."""
    v = F.try_parse_json(raw) if v is None else v
    return F.when(raw.isNotNull() & (fault(raw, shape, "") if why is None else why).isNull(), shape.value(v))
