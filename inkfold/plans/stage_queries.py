"""Queries over stages that remember: answers by content, surveys, and translation that starts from them. The models are fakes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.operators import memo, surveys
from inkfold.operators.models import Asker
from inkfold.plans.model_queries import scratch
from inkfold.plans.registry import query
from inkfold.sources.views import chapter_pages, with_views


def _digests(once: DataFrame) -> DataFrame:
    """A model stage whose answer depends on every byte of a content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"content": frame["content"], "answer": [hashlib.md5(x.encode() + b"!").hexdigest() for x in frame["text"]]})

    return once.mapInPandas(run, "content string, answer string")


@query("""with first as (select distinct text from documents where doc_id % 2 = 0 and text is not null),
new as (select count(distinct text) as n from documents where text is not null and text not in (select text from first))
select doc_id, md5(text || '!') as answer, (select count(*) from first) as asked_first, (select n from new) as asked_then, 0::bigint as asked_again from documents""")
def remembered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's answer from a model that is asked once for each distinct text, over three runs with one table."""
    folder = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    asked = [memo.ask_for_new(some, "text", _digests, folder) for some in (docs.where("doc_id % 2 = 0"), docs, docs)]
    names = [F.lit(n).cast("bigint").alias(name) for n, name in zip(asked, ("asked_first", "asked_then", "asked_again"))]
    return memo.answered(docs, "text", _digests, folder).select("doc_id", "answer", *names)


def fake_surveyor() -> Asker:
    """Finds four terms, a person and a beat on each page; fails at the third window."""

    def ask(request: dict) -> str:
        if request["first"] == 16:
            raise ValueError("too much to read")
        pages = list(enumerate(request["pages"], request["first"]))
        terms = [{"source": text[3 * k : 3 * k + 3], "target": f"w{request['first']}", "note": f" {len(request['chapter']['beats'])} "} for _, text in pages for k in range(4)]
        cast = [{"name": f"N{len(text) % 15}", "gender": "male" if len(text) % 2 == 0 else "odd", "note": f"n{i}" if i % 2 == 0 else ""} for i, text in pages]
        return "Here: " + json.dumps({"beats": [f" b{len(text) % 10}@{i} " for i, text in pages], "synopsis": f"s{request['first']}", "register": " ", "cast": cast, "terms": terms})

    return ask


def fake_translator() -> Asker:
    """Answers in angle brackets, with a term of its own for each page and a scene for some."""

    def ask(request: dict) -> str:
        (line,) = request["lines"]
        return json.dumps({"translations": [f"<{len(line)}>"], "terms": [{"source": f"own{len(line) % 7}", "target": "t"}], "story": {"scene": f"s{len(line)}" if len(line) % 3 == 0 else " "}})

    return ask


_STRIPPED = r"regexp_replace(substring(beat, 3 * k + 1, 3), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_FOUND = rf"""with read as (select *, page_no // 8 * 8 as first from chapter_pages where page_no < 16),
said as (select chapter, page_no, k, first, {_STRIPPED} as source from read, unnest(range(4)) u(k)),
terms as (select *, row_number() over (partition by chapter order by pos) - 1 as place from (
  select chapter, source, min(page_no * 10 + k) as pos, max(first) as last from said where source <> '' group by 1, 2)),
cast_ as (select *, row_number() over (partition by chapter order by pos) - 1 as place from (
  select chapter, 'N' || length(beat) % 15 as name, min(page_no) as pos, coalesce(max('male') filter (length(beat) % 2 = 0), 'unknown') as gender,
    coalesce('n' || max(page_no) filter (page_no % 2 = 0), '') as note from read group by 1, 2)),
found as (
  select chapter, 'synopsis' as part, 0 as place, null as name, 's' || max(first) as value, null as note from read group by 1
  union all select chapter, 'beat', page_no, null, 'b' || length(beat) % 10 || '@' || page_no, null from read
  union all select chapter, 'person', place, name, gender, note from cast_ where place < 12
  union all select chapter, 'term', place, source, 'w' || last, last::varchar from terms where place < 40
  union all select distinct chapter, 'why', 16, null, 'too much to read', null from chapter_pages where page_no >= 16)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chapter_pages(spark, sf_dir).withColumnRenamed("beat", "text")
    return surveys.surveyed(surveys.page_windows(pages), fake_surveyor)


@query(with_views(_FOUND + "select chapter, part, place::int as place, name, value, note from found", "chapter_pages"))
def surveyed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that surveys find, with the window at which they end."""
    return _found(spark, sf_dir)


@query(with_views(_FOUND + """, p as (select *, 'own' || length(beat) % 7 as own, case when length(beat) % 3 = 0 then 's' || length(beat) end as scene_said from chapter_pages),
firsts as (select chapter, own, min(page_no) as pos from p group by 1, 2)
select p.chapter, p.page_no, '<' || length(beat) || '>' as answer,
  least(40, (select count(*) from found f where f.chapter = p.chapter and part = 'term') + (select count(*) from firsts o where o.chapter = p.chapter and o.pos < p.page_no))::int as known,
  (select string_agg(name, ', ' order by place) from found f where f.chapter = p.chapter and part = 'person') as people,
  coalesce((select arg_max(scene_said, q.page_no) from p q where q.chapter = p.chapter and q.page_no < p.page_no and scene_said is not null), '') as scene from p""", "chapter_pages"))
def translate_surveyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages translated in order, from the terms and people that the survey of their chapter found."""
    pages = chapter_pages(spark, sf_dir).withColumnRenamed("beat", "text")
    return surveys.translated(pages, _found(spark, sf_dir), fake_translator)
