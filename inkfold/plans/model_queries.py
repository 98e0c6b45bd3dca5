"""Queries over model stages (with fakes), archives and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.operators import context, folds, lines as ln, models
from inkfold.plans import fakes
from inkfold.plans.registry import query
from inkfold.session import shared_dir
from inkfold.sources import archive
from inkfold.sources.views import chapter_pages, files, grids, lines, mentions, with_views
from inkfold.streaming import chapters, ingest


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query(with_views("""with u as (select page_id, text, min(ord) as o from lines where trim(text, ' ' || chr(9) || chr(13)) <> '' group by 1, 2),
a as (select page_id, text, row_number() over (partition by page_id order by o)::int as n, count(*) over (partition by page_id) as wanted from u)
select page_id, n, '<' || text || '>' as answer, case when wanted = 1 then 1 when wanted % 10 = 0 then 2 + wanted when wanted % 3 = 0 then 2 else 1 end::int as asks,
  case when wanted % 2 = 0 then '["first"]' when wanted % 3 = 0 then '["again"]' else '[]' end as terms, case when wanted % 2 = 0 then 'first' when wanted % 3 = 0 then 'again' else '' end as scene from a""", "lines"))
def translate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of a page through a fake model that miscounts: asked again, then line by line; the first terms and scene stay."""
    asked = ln.asked_once(ln.not_blank(lines(spark, sf_dir)).withColumn("kind", F.lit("")))
    return models.translated(asked, fakes.fake_asker)


@query(with_views("select chapter, page_no, 'beat ' || (page_no % 8) as beat from chapter_pages", "chapter_pages"))
def survey_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.surveyed(context.survey_windows(chapter_pages(spark, sf_dir)), fakes.fake_asker)


@query(with_views("""with f as (select chapter, substring(beat, 1, 1) as s, min(page_no) as first from chapter_pages where beat <> '' group by 1, 2),
s as (select chapter, page_no, case when length(beat) % 2 = 0 then trim(substring(beat, -1, 1), ' ' || chr(9) || chr(10) || chr(13)) else '' end as said from chapter_pages)
select p.chapter, p.page_no, '<' || p.beat || '>' as answer, least(40, (select count(*) from f where f.chapter = p.chapter and f.first < p.page_no))::int as known,
  coalesce((select arg_max(said, page_no) from s where s.chapter = p.chapter and s.page_no < p.page_no and said <> ''), '') as scene from chapter_pages p""", "chapter_pages"))
def translate_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a chapter in order, each told the terms of those before it."""
    return models.carried(chapter_pages(spark, sf_dir).select("chapter", "page_no", F.col("beat").alias("text")), fakes.fake_term_asker)


@query("select distinct 'm' || (k % 9) as model from (select json_extract_string(props, '$.k')::int as k, event_id from events) where event_id % 4 <> 0")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("m"), (F.get_json_object("props", "$.k").cast("int") % 9).cast("string"))).otherwise("")
    told = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_json(F.struct(F.array(F.struct(name.alias("name"))).alias("models"))).alias("answer"))
    return models.catalogue(told, "answer")


@query("""select page_id, 0 as det_id, 1 as label, 0.9::double as score, (strlen(html) % 100)::int as x0, (strlen(html) % 100)::int as y0, null as why from pages where page_id % 10 <> 0
union all select page_id, 1, 0, 0.8, greatest(0, strlen(html) % 100 - 10)::int, greatest(0, strlen(html) % 100 - 10)::int, null from pages where page_id % 10 <> 0
union all select page_id, null, null, null, null, null, 'empty page' from pages where page_id % 10 = 0""")
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", data.alias("data"))
    return models.detected(pages, fakes.fake_detector).select("page_id", "det_id", "label", "score", "x0", "y0", "why")


@query("select page_id, 0 as ord, case when page_id % 5 = 0 then '' else 'ja ' || strlen(html) end as text from pages")
def read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.lit(0).alias("ord"), (F.col("page_id") % 5 * 4).cast("int").alias("w"), F.lit(9).alias("h"), F.col("html").cast("binary").alias("data"), F.lit("ja").alias("language")
    )
    return models.read(crops, fakes.fake_reader)


@query("""select page_id, case when page_id % 10 = 0 then null when strlen(html) % 2 = 0 then 200 * (50 + 3) else 0 end as ink, case when page_id % 10 = 0 then 'no map' end as why from pages""")
def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink masks of pages twice as wide as high: the map covers them with its upper half, and the ink in it grows by a pixel of the map."""
    data = F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lit(200).alias("width"), F.lit(100).alias("height"), data.alias("data"))
    return models.segmented(pages, fakes.fake_segmenter, grow=1).select("page_id", "ink", "why")


@query(with_views("""with ink as (select vec_id, i % 8 as x, i // 8 as y from tiles where grey > 128), box as (select vec_id, max(y) - min(y) > max(x) - min(x) as upright from ink group by 1),
used as (select distinct vec_id, upright, case when upright then x else y end as p from ink join box using (vec_id)),
islands as (select *, p - row_number() over (partition by vec_id order by p) as island from used),
runs as (select vec_id, upright, min(p) as a, count(*) as n from islands group by vec_id, upright, island having count(*) >= 3),
every as (select distinct vec_id, ['ja', 'en', 'zh'][vec_id % 3 + 1] as lang from tiles),
parts as (select vec_id, string_agg(n || case when upright then 'x8' else '' end, '/' order by case when upright then -a else a end) as sizes, any_value(upright) as upright from runs group by 1)
select e.vec_id as page_id, 0 as ord, case when lang = 'ja' then 'ja8x8' else coalesce(replace(lang || case when upright then '' else '8x' end || sizes, '/', case when lang = 'zh' then '' else ' ' end || lang || case when upright then '' else '8x' end), lang || '8x8') end as text
from every e left join parts p on e.vec_id = p.vec_id""", "tiles"))
def read_in_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles read as a whole or by their lines of ink, by language."""
    language = F.element_at(F.array(*map(F.lit, ("ja", "en", "zh"))), (F.col("vec_id") % 3 + 1).cast("int"))
    crops = grids(spark, sf_dir).select(F.col("vec_id").alias("page_id"), F.lit(0).alias("ord"), F.lit(8).alias("w"), F.lit(8).alias("h"), "grey", language.alias("language"))
    crops = crops.withColumn("ink", F.transform("grey", lambda g: (g > 128).cast("int")))
    return models.read_slices(crops, fakes.fake_slice_reader, ("ja",), ("zh",))


@query(with_views("""with f as (select page_id, regexp_extract(path, '^([^/]*)/', 1) as folder, regexp_extract(path, '[^/]*$', 0) as name, path from files),
u as (select folder, page_id, path, case when n = 1 then name else regexp_replace(name, '\\.[^.]+$', '') || ' (' || n || ')' || regexp_extract(name, '\\.[^.]+$', 0) end as name
  from (select *, row_number() over (partition by folder, name order by page_id) as n from f))
select folder as archive, name, case lower(regexp_extract(name, '\\.[^.]+$', 0)) when '.png' then 'image/png' when '.jpg' then 'image/jpeg' else 'image/webp' end as type, length(path)::int as size from u where not ends_with(name, '.txt') and not starts_with(name, '.')""", "files"))
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders packed into archives and read back: page images only, under names that don't clash."""
    own = files(spark, sf_dir).select(F.concat(F.regexp_extract("path", "^([^/]*)/", 1), F.lit(".zip")).alias("archive"), t.base_name(F.col("path")).alias("name"), F.col("page_id").alias("place"), F.col("path").cast("binary").alias("data"))
    folder = scratch(spark)
    archive.pack(own, folder)
    return archive.pages(spark, folder).select(F.regexp_replace("archive", r"\.zip$", "").alias("archive"), "name", "type", F.length("data").alias("size"))


@query(with_views("""with f as (select chapter, name, min(seq) as first_seq, coalesce(arg_max(gender, seq) filter (gender <> 'unknown'), 'unknown') as gender,
  coalesce(arg_max(note, seq) filter (note <> ''), '') as note from mentions group by 1, 2),
people as (select *, row_number() over (partition by chapter order by first_seq)::int as place from f)
select chapter, name, gender, note, place from people where place <= 12""", "mentions"))
def streamed_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cast of each chapter, kept as state while its mentions come in by two batches; the second goes on from the checkpoint of the first."""
    folder = scratch(spark)
    rows = folds.as_events(mentions(spark, sf_dir))
    for some in (rows.where("seq < 20"), rows.where("seq >= 20")):
        some.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        chapters.keep(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return chapters.kept(spark, f"{folder}/out").select("chapter", "name", "gender", "note", "place")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by hand that stand between mentions: genders and notes set, cleared, and people who are never mentioned."""
    e = mentions(spark, sf_dir).where("seq % 3 = 0")
    gender = F.col("seq") % 2 == 0
    value = F.when(F.col("seq") % 9 == 0, F.when(gender, "unknown").otherwise(" ")).when(gender, "other").otherwise(F.concat(F.lit("by hand "), F.col("seq").cast("string")))
    name = F.when(F.col("seq") % 15 == 0, F.concat(F.lit("hand"), (F.col("seq") % 4).cast("string"))).otherwise(F.col("name"))
    return e.select("chapter", (F.col("seq") * 2 + 1).alias("seq"), name.alias("name"), F.when(gender, "gender").otherwise("note").alias("fact"), value.alias("value"))


_CORRECTED = """with e as (select chapter, seq * 2 as seq, name, gender, note, null as fact, null as value from mentions union all
  select chapter, seq * 2 + 1, case when seq % 15 = 0 then 'hand' || (seq % 4) else name end, null, null, case when seq % 2 = 0 then 'gender' else 'note' end,
    case when seq % 9 = 0 then case when seq % 2 = 0 then 'unknown' else ' ' end when seq % 2 = 0 then 'other' else 'by hand ' || seq end from mentions where seq % 3 = 0),
f as (select chapter, name, min(seq) as first_seq,
  arg_max(gender, seq) filter (gender <> 'unknown') as gs, max(seq) filter (gender <> 'unknown') as gs_at, arg_max(value, seq) filter (fact = 'gender') as ge, max(seq) filter (fact = 'gender') as ge_at,
  arg_max(note, seq) filter (note <> '') as ns, max(seq) filter (note <> '') as ns_at, arg_max(value, seq) filter (fact = 'note') as ne, max(seq) filter (fact = 'note') as ne_at from e group by 1, 2),
p as (select *, row_number() over (partition by chapter order by first_seq, name)::int as place from f)
select chapter, name, place, case when ge <> 'unknown' then ge when ge is null or gs_at > ge_at then coalesce(gs, 'unknown') else 'unknown' end as gender,
  case when trim(ne) <> '' then ne when ne is null or ns_at > ne_at then coalesce(ns, '') else '' end as note,
  concat_ws(',', case when ge <> 'unknown' then 'gender' end, case when trim(ne) <> '' then 'note' end) as settled from p where place <= 12"""


def _corrected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.as_events(mentions(spark, sf_dir).withColumn("seq", F.col("seq") * 2), _edits(spark, sf_dir))


@query(with_views(_CORRECTED, "mentions"))
def corrected_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and corrections in order: settled facts stand, cleared ones are open again, people come in by hand too."""
    return folds.settled_cast(folds.facts(_corrected_events(spark, sf_dir))).withColumn("settled", F.array_join("settled", ","))


@query(with_views(_CORRECTED, "mentions"))
def streamed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two streams into one state, over three runs from one checkpoint: corrections come before, among and long after what they correct."""
    folder = scratch(spark)
    news = mentions(spark, sf_dir).withColumn("seq", F.col("seq") * 2)
    edits = _edits(spark, sf_dir)
    parts = [(news.where("seq >= 40"), edits.where("seq < 20")), (news.where("seq < 10"), edits.where("seq >= 60")), (news.where("seq >= 10 and seq < 40"), edits.where("seq >= 20 and seq < 60"))]
    for some_news, some_edits in parts:
        some_news.write.mode("append").parquet(f"{folder}/news")
        some_edits.write.mode("append").parquet(f"{folder}/edits")
        streams = [spark.readStream.schema(df.schema).parquet(f"{folder}/{name}") for name, df in (("news", news), ("edits", edits))]
        chapters.keep(folds.as_events(*streams), f"{folder}/out", f"{folder}/state").awaitTermination()
    return chapters.kept(spark, f"{folder}/out").withColumn("settled", F.array_join("settled", ","))


@query(with_views("""with f as (select page_id, regexp_extract(path, '[^/]*$', 0) as name, regexp_extract(path, '^([^/]*)/', 1) as folder, path from files),
k as (select *, folder || ':' || name as fingerprint, not ends_with(name, '.txt') as is_image from f),
s as (select folder, case when not is_image then 'rejected' when fingerprint in (select fingerprint from k where page_id % 3 = 0) then 'duplicate'
  when row_number() over (partition by fingerprint order by page_id) > 1 then 'duplicate' else 'fresh' end as state from k where page_id % 3 <> 0)
select folder, state, count(*) as n from s group by 1, 2""", "files"))
def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that come in by three batches, with a restart after each, against a library: fresh, repeated and rejected ones."""
    folder = scratch(spark)
    path = F.col("path")
    all_files = files(spark, sf_dir).select("page_id", F.regexp_extract(path, "^([^/]*)/", 1).alias("folder"), t.base_name(path).alias("name"), F.when(t.image_type(path).isNull(), "rejected").alias("state"))
    all_files = all_files.withColumn("fingerprint", F.concat_ws(":", "folder", "name"))
    incoming = all_files.where("page_id % 3 <> 0")
    # a session of its own, so that the caller's settings stay as they are
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    all_files.where("page_id % 3 = 0").write.parquet(f"{folder}/library")
    # about a third of the files each; where the batches part makes no difference to the result
    ends = incoming.agg(F.percentile_approx("page_id", [1 / 3, 2 / 3], 100)).first()[0] or [0, 0]
    third = (F.col("page_id") > ends[0]).cast("int") + (F.col("page_id") > ends[1]).cast("int")
    for k in range(3):
        incoming.where(third == k).write.mode("append").parquet(f"{folder}/in")
        stream = own.readStream.schema(incoming.schema).parquet(f"{folder}/in")
        library = own.readStream.schema(incoming.schema).parquet(f"{folder}/library")
        judged = ingest.told_apart(stream, library, "page_id", hold_ms=30 * 24 * 3600 * 1000)
        ingest.drain(ingest.write(judged, f"{folder}/out", f"{folder}/state", "0 seconds"))
    return ingest.counted(spark.read.parquet(f"{folder}/out"))
