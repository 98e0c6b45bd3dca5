"""Queries over chapters: context, folds and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import jsonx, text as t
from inkfold.operators import context, folds
from inkfold.plans.registry import query
from inkfold.sources.views import chapter_pages, mentions, with_views

_BEAT = r"regexp_replace(beat, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query(with_views(f"""with b as (select chapter, page_no, substring({_BEAT}, 1, 160) as s from chapter_pages)
select p.chapter, p.page_no, count(*)::int as n_seen,
  coalesce(string_agg(case when q.page_no = p.page_no then '→ ' else '  ' end || (q.page_no + 1) || '. ' || q.s, chr(10) order by q.page_no) filter (q.s <> ''), '') as context
from b p join b q on p.chapter = q.chapter and q.page_no between p.page_no - 6 and p.page_no + 2 group by 1, 2""", "chapter_pages"))
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.around(chapter_pages(spark, sf_dir)).select("chapter", "page_no", "n_seen", "context")


@query(with_views(f"select chapter, (page_no // 8)::int as \"window\", min(page_no) as first, count(*) as pages, string_agg('Page ' || (page_no + 1) || ':' || chr(10) || {_BEAT}, chr(10) || chr(10) order by page_no) as text from chapter_pages group by 1, 2", "chapter_pages"))
def survey_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.survey_windows(chapter_pages(spark, sf_dir))


@query(with_views("select chapter, page_no, 'This is page ' || (page_no + 1) || ' of ' || count(*) over (partition by chapter) || '.' as position from chapter_pages", "chapter_pages"))
def page_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.positions(chapter_pages(spark, sf_dir)).select("chapter", "page_no", "position")


@query(with_views("""with f as (select chapter, name, min(seq) as seq, arg_min(gender, seq) as target from mentions group by 1, 2),
g as (select *, row_number() over (partition by chapter order by seq)::int as place from f) select chapter, name, target, seq, place from g where place <= 40""", "mentions"))
def glossary_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.first_wins(mentions(spark, sf_dir), "name").select("chapter", "name", F.col("gender").alias("target"), "seq", "place")


@query(with_views("""with f as (select chapter, name, min(seq) as seq, arg_max(gender, seq) as gender, arg_max(note, seq) as note from mentions group by 1, 2),
g as (select *, row_number() over (partition by chapter order by seq)::int as place from f) select chapter, name, gender, note, seq, place from g where place <= 10""", "mentions"))
def glossary_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.last_wins(mentions(spark, sf_dir), "name", ["gender", "note"], 10)


_CAST = """with f as (select chapter, name, min(seq) as first_seq, coalesce(arg_max(gender, seq) filter (gender <> 'unknown'), 'unknown') as gender,
  coalesce(arg_max(note, seq) filter (note <> ''), '') as note from mentions group by 1, 2),
people as (select *, row_number() over (partition by chapter order by first_seq)::int as place from f)
"""


@query(with_views(_CAST + "select chapter, name, first_seq, gender, note, place from people where place <= 12", "mentions"))
def cast_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.cast_fold(mentions(spark, sf_dir))


@query(with_views(_CAST + "select chapter, name, gender, note, place from people where place <= 12", "mentions"))
def story_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cast_fold as an ordered fold over arrays, the step that streams use."""
    person = F.struct("name", "gender", "note", F.array().cast("array<string>").alias("settled"))
    told = mentions(spark, sf_dir).groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("seq", person.alias("p")))).alias("told"))
    news = F.transform("told", lambda x: x.p)
    none = F.filter(news, lambda x: F.lit(False))
    people = told.select("chapter", F.posexplode(folds.merged_cast(none, news)))
    return people.select("chapter", "col.name", "col.gender", "col.note", (F.col("pos") + 1).alias("place"))


@query(with_views(_CAST + "select chapter, coalesce('Still unknown: ' || string_agg(name, ', ' order by place) filter (gender = 'unknown' and place <= 12) || '.', '') as question from people group by 1", "mentions"))
def unknown_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.still_unknown(folds.cast_fold(mentions(spark, sf_dir)))


@query(with_views(_CAST + """, edits as (select chapter, name, arg_max('other', seq) as g from mentions where seq % 7 = 0 and note <> '' group by 1, 2)
select p.chapter, p.name, coalesce(e.g, p.gender) as gender, p.note, (e.g is not null) as settled, p.name || ' — ' || concat_ws(', ', case when coalesce(e.g, p.gender) <> 'unknown' then coalesce(e.g, p.gender) || case when e.g is not null then ' (settled)' else '' end end, nullif(p.note, '')) as line
from people p left join edits e on p.chapter = e.chapter and p.name = e.name where place <= 12 and (coalesce(e.g, p.gender) <> 'unknown' or p.note <> '')
union all select p.chapter, p.name, p.gender, p.note, false, p.name from people p left join edits e on p.chapter = e.chapter and p.name = e.name where place <= 12 and coalesce(e.g, p.gender) = 'unknown' and p.note = ''""", "mentions"))
def cast_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = mentions(spark, sf_dir)
    people = folds.cast_fold(said).withColumn("settled", F.array().cast("array<string>"))
    edits = said.where("seq % 7 = 0 and note <> ''").select("chapter", "name", F.lit("gender").alias("fact"), F.lit("other").alias("value"), "seq")
    fixed = folds.corrected(people, edits)
    line = t.member(F.col("name"), F.col("gender"), F.col("note"), F.col("settled"))
    return fixed.select("chapter", "name", "gender", "note", F.array_contains("settled", "gender").alias("settled"), line.alias("line"))


@query(with_views("select chapter, page_no, beat from chapter_pages", "chapter_pages"))
def chapter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey windows written into the chapter's beats, the odd ones first: they leave blanks that the even ones fill."""
    pages = chapter_pages(spark, sf_dir)
    windows = pages.groupBy("chapter", F.floor(F.col("page_no") / 8).alias("w")).agg(
        F.min("page_no").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("page_no", "beat"))), lambda b: b.beat).alias("beats")
    )
    ordered = windows.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct((F.col("w") % 2 == 0).alias("even"), "first", "beats"))).alias("news"))
    folded = F.aggregate("news", F.array().cast("array<string>"), lambda acc, x: folds.folded_beats(acc, x.beats, x.first))
    return ordered.select("chapter", F.posexplode(folded).alias("page_no", "beat"))


@query(with_views("select chapter, count(*) % 2 = 1 as fits from chapter_pages group by 1", "chapter_pages"))
def chapter_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of an even number of pages come with a beat too few and aren't handed on."""
    pages = chapter_pages(spark, sf_dir)
    n = F.count("*")
    told = pages.groupBy("chapter").agg(F.slice(F.collect_list("beat"), F.lit(1), (n - F.when(n % 2 == 0, 1).otherwise(0)).cast("int")).alias("beats"))
    return context.fits(told, pages).select("chapter", "fits")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies built from events: fenced, wrapped, ragged or broken."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(
        F.lit('{"translations":["a","b"],"terms":[{"source":"s'), k.cast("string"), F.lit('","target":"t","note":" n "},{"source":"only"},"nonsense",{"source":"x","target":'), (k % 5).cast("string"),
        F.lit('}],"story":{"scene":" on '), F.col("event_type"), F.lit('","cast":[{"name":"k'), k.cast("string"), F.lit('","gender":"'), F.when(k % 2 == 0, "male").otherwise("odd"), F.lit('"},{"name":"Unknown"},{"gender":"male"}]}}'),
    )
    shape = F.col("event_id") % 5
    content = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(shape == 3, "no json {").otherwise("")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", content.alias("content"), F.when(shape == 3, body).otherwise("").alias("thinking"))


_REPLIES = """with r as (select event_id, event_type, json_extract_string(props, '$.k')::int as k, event_id % 5 as shape from events)
"""


@query(_REPLIES + "select event_id, shape <> 4 as found, case when shape = 3 then 'thinking' when shape <> 4 then 'content' else 'none' end as field from r")
def reply_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = jsonx.usable(F.col("content"), key="translations")
    either = jsonx.usable(F.col("content"), F.col("thinking"), key="translations")
    field = F.when(content.isNotNull(), "content").when(either.isNotNull(), "thinking").otherwise("none")
    return _replies(spark, sf_dir).select("event_id", either.isNotNull().alias("found"), field.alias("field"))


@query(_REPLIES + "select event_id, 0 as ord, 's' || k as source, 't' as target, 'n' as note from r where shape <> 4 union all select event_id, 1, 'x', (k % 5)::varchar, null from r where shape <> 4")
def lenient_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = jsonx.usable(F.col("content"), F.col("thinking"), key="translations")
    rows = _replies(spark, sf_dir).select("event_id", read.alias("v"))
    return rows.select("event_id", F.posexplode(jsonx.terms(F.col("v")))).select("event_id", F.col("pos").alias("ord"), "col.source", "col.target", "col.note")


@query(_REPLIES + "select event_id, 'on ' || event_type as scene, 1 as people, 'k' || k as name, case when k % 2 = 0 then 'male' else 'unknown' end as gender from r where shape <> 4")
def lenient_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = jsonx.usable(F.col("content"), F.col("thinking"), key="translations")
    rows = _replies(spark, sf_dir).select("event_id", read.alias("v")).where("v is not null")
    told = rows.select("event_id", jsonx.scene(F.col("v")).alias("scene"), jsonx.people(F.col("v")).alias("cast"))
    return told.select("event_id", "scene", F.size("cast").alias("people"), F.get("cast", 0)["name"].alias("name"), F.get("cast", 0)["gender"].alias("gender"))


@query(_REPLIES + "select event_id, case when shape = 4 or event_id % 3 = 0 then -1 else 2 end as answers from r")
def counted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = jsonx.usable(F.col("content"), F.col("thinking"), key="translations")
    wanted = F.when(F.col("event_id") % 3 == 0, 3).otherwise(2)
    got = jsonx.counted(F.col("v"), "$.translations", wanted)
    return _replies(spark, sf_dir).select("event_id", read.alias("v")).select("event_id", F.coalesce(F.when(got.isNotNull(), F.size(got)), F.lit(-1)).alias("answers"))


@query("""select event_id, case event_id % 6 when 0 then null when 1 then 'not a list' when 2 then 'not an object' when 3 then 'not text' else null end as terms,
  case event_id % 6 when 1 then 'not a list' when 4 then 'no name' when 5 then 'not a gender' when 2 then 'no name' when 3 then 'no name' else null end as people from events""")
def strict_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.col("event_id") % 6
    body = (
        F.when(shape == 0, '[{"name":"a","gender":"male","source":"s","target":"t"}]').when(shape == 1, '{"source":"s"}').when(shape == 2, '[3,"s"]')
        .when(shape == 3, '[{"source":4,"target":"t"}]').when(shape == 4, '[{"source":"s","target":""}]').otherwise('[{"name":"a","gender":"cat"}]')
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_parse_json(body).alias("v"))
    return rows.select("event_id", jsonx.rejects_terms(F.col("v")).alias("terms"), jsonx.rejects_people(F.col("v")).alias("people"))


@query("""with k as (select event_id, case event_id % 4 when 0 then ' 7 ' when 1 then '' when 2 then 'x' else event_id::varchar end as raw from events)
select event_id, case event_id % 4 when 0 then 7 when 1 then 0 when 2 then null else least(event_id, 64) end::int as n from k""")
def scalar_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, " 7 ").when(e % 4 == 1, "").when(e % 4 == 2, "x").otherwise(e.cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", jsonx.whole(raw, 0, 64).alias("n"))
