"""Replies of a model as JSON text: found, then read leniently (bad elements drop) or strictly (with a reason)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.operators.context import BEAT, CAST_NOTE, NOTE, SCENE
from inkfold.operators.folds import BEATS, CAST, GLOSSARY, PLACEHOLDERS

GENDERS = ("male", "female", "unknown")


#: A code fence and its line, if the text opens with one, then all from the first brace to the last.
_OBJECT = r"(?sU)^(?:\s*```[^\n]*\n?)?+[^{]*(\{.*\})"


def reply(x: Column) -> Column:
    """The object in a reply, as VARIANT: without a code fence and its line, from the first brace to the last; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(x, _OBJECT, 1), F.lit("")))


def elements(v: Column, path: str) -> Column:
    """A list inside a VARIANT as array<variant>; null if it isn't one."""
    return F.try_variant_get(v, path, "array<variant>")


def usable(*fields: Column, key: str) -> Column:
    """The first field whose object has a list under `key`. Each field is read once."""
    return F.get(F.filter(F.transform(F.array(*fields), reply), lambda v: elements(v, f"$.{key}").isNotNull()), 0)


def said(v: Column, path: str) -> Column:
    """A scalar as stripped text; '' if missing."""
    return t.strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def terms(v: Column, path: str = "$.terms", most: int = GLOSSARY) -> Column:
    """Terms with a source and a target; the note only if it says something; the first `most`."""
    read = F.transform(
        elements(v, path),
        lambda e: F.struct(said(e, "$.source").alias("source"), said(e, "$.target").alias("target"), F.nullif(F.substring(said(e, "$.note"), 1, NOTE), F.lit("")).alias("note")),
    )
    return F.coalesce(F.slice(F.filter(read, lambda x: (x.source != "") & (x.target != "")), 1, most), F.array().cast("array<struct<source:string,target:string,note:string>>"))


def people(v: Column, path: str = "$.story.cast", most: int = CAST) -> Column:
    """People with a real name; a gender that isn't known is unknown; the first `most`."""
    read = F.transform(
        elements(v, path),
        lambda e: F.struct(
            said(e, "$.name").alias("name"),
            F.when(said(e, "$.gender").isin(*GENDERS), said(e, "$.gender")).otherwise("unknown").alias("gender"),
            F.substring(said(e, "$.note"), 1, CAST_NOTE).alias("note"),
        ),
    )
    named = F.filter(read, lambda x: (x["name"] != "") & ~F.lower(x["name"]).isin(*PLACEHOLDERS))
    return F.coalesce(F.slice(named, 1, most), F.array().cast("array<struct<name:string,gender:string,note:string>>"))


def scene(v: Column, path: str = "$.story.scene") -> Column:
    return F.substring(said(v, path), 1, SCENE)


def counted(v: Column, path: str, wanted: Column) -> Column:
    """A list of texts if it has as many as wanted, else null."""
    texts = F.transform(elements(v, path), lambda e: F.coalesce(F.try_variant_get(e, "$", "string"), F.lit("")))
    return F.when(F.size(texts) == wanted, texts)


def beats(v: Column, wanted: Column) -> Column:
    """One beat per page, or none at all: they are never shifted."""
    found = F.transform(counted(v, "$.beats", wanted), lambda b: t.cut(b, BEAT))
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, BEATS)


def rejects_terms(v: Column, path: str = "$") -> Column:
    """Why a caller's terms are refused; null if they aren't. Blank terms are skipped, wrong shapes are not."""
    items = elements(v, path)
    shaped = lambda e: F.try_variant_get(e, "$", "map<string,variant>").isNotNull()
    texts = lambda e, k: F.coalesce(F.schema_of_variant(F.try_variant_get(e, f"$.{k}", "variant")), F.lit("VOID")).isin("STRING", "VOID")
    return (
        F.when(items.isNull(), "not a list")
        .when(F.exists(items, lambda e: ~shaped(e)), "not an object")
        .when(F.exists(items, lambda e: ~(texts(e, "source") & texts(e, "target"))), "not text")
    )


def rejects_people(v: Column, path: str = "$") -> Column:
    """Why a caller's cast is refused: unlike a model's, a nameless person or another gender is an error."""
    items = elements(v, path)
    return (
        F.when(items.isNull(), "not a list")
        .when(F.exists(items, lambda e: said(e, "$.name") == ""), "no name")
        .when(F.exists(items, lambda e: ~F.when(said(e, "$.gender") == "", "unknown").otherwise(said(e, "$.gender")).isin(*GENDERS)), "not a gender")
    )


def whole(x: Column, low: int, high: int) -> Column:
    """A whole number inside [low, high]; blank is `low`; null if it isn't one."""
    n = F.when(t.blank(x), F.lit(low)).otherwise(t.strip(x).try_cast("int"))
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(low)), F.lit(high)))
