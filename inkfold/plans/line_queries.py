"""Queries over the lines of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import layout, text as t
from inkfold.operators import lines as ln
from inkfold.plans.registry import query
from inkfold.sources.views import dialogue, lines, with_views

_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_S = _STRIP.format(x="text")
_ASKED = """with first as (select page_id, text, kind, min(ord) as first_ord, arg_min(budget, ord) as fb, min(nullif(budget, 0)) as mb, count(*) as copies from lines group by 1, 2, 3),
asked as (select page_id, text, kind, first_ord, case when fb = 0 then 0 else mb end as budget, copies, row_number() over (partition by page_id order by first_ord)::int as n from first)
"""


@query(with_views(f"select page_id, ord, text from lines where {_S} <> ''", "lines"))
def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.not_blank(lines(spark, sf_dir)).select("page_id", "ord", "text")


@query(with_views(_ASKED + "select page_id, text, kind, first_ord, budget, copies, n from asked", "lines"))
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.asked_once(lines(spark, sf_dir))


@query(with_views(_ASKED + "select l.page_id, l.ord, a.n || ':' || substring(l.text, 1, 20) as answer from lines l join asked a on l.page_id = a.page_id and l.text = a.text and l.kind = a.kind", "lines"))
def fan_out_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    answers = ln.asked_once(rows).withColumn("answer", F.concat(F.col("n").cast("string"), F.lit(":"), F.substring("text", 1, 20)))
    return ln.fanned_out(rows, answers).select("page_id", "ord", "answer")


@query(with_views(_ASKED + f"select page_id, n, concat_ws(' ', n || '.', '[' || kind || ']', case when budget > 0 then '<=' || budget end, {_S}) as line from asked", "lines"))
def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.numbered(ln.asked_once(lines(spark, sf_dir))).select("page_id", "n", "line")


@query(with_views("select page_id, count(*) as wanted, count(*) filter (budget > 3) as got from lines group by 1 having count(*) <> count(*) filter (budget > 3)", "lines"))
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return ln.misaligned(rows, rows.where("budget > 3"))


@query(with_views("select page_id, ord, length(text)::int as size, budget from lines where page_id in (select page_id from lines group by 1 having min(budget) > 3)", "lines"))
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    texts = rows.select("page_id", "ord", F.length("text").alias("size"))
    return ln.zipped(texts, rows.where("budget > 3").select("page_id", "ord", "budget"))


@query(f"""with s as (select conv_id, turn, {_S} as x from conversations)
select conv_id, coalesce(string_agg(x, chr(10) order by turn) filter (x <> ''), '') as text, count(*) as turns from s group by 1""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue(spark, sf_dir)
    return ln.page_texts(rows, "conv_id", "turn").join(rows.groupBy("conv_id").agg(F.count("*").alias("turns")), "conv_id")


@query(with_views("select doc_id, n_chars from documents where doc_id not in (select page_id from lines group by 1 having count(*) > 5)", "lines"))
def resume_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    done = lines(spark, sf_dir).groupBy(F.col("page_id").alias("doc_id")).count().where("count > 5")
    return ln.missing(docs, done, "doc_id")


@query(with_views("select why, count(*) as n from (select case when length(text) = 0 then 'empty' when length(text) < 20 then 'short' when budget = 0 then 'no room' end as why from lines) where why is not null group by 1", "lines"))
def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    why = F.when(size == 0, "empty").when(size < 20, "short").when(F.col("budget") == 0, "no room")
    return ln.reasons(lines(spark, sf_dir).withColumn("why", why))


@query(with_views("""with m as (select page_id, ord, 40 + ord % 200 as w, 60 + budget * 7 as h, length(regexp_replace(text, '\\s+', '', 'g')) as n from lines),
z as (select *, case when n > 0 then greatest(6, floor(1.25 * sqrt(w * h / n) + 0.5)) else 200 end::int as size from m),
r as (select *, floor(w / (size * 0.5) * greatest(1, floor(h / (size * 1.15))) * 0.85) as room from z)
select page_id, ord, size, case when room < 12 then 0 else room end::int as room from r""", "lines"))
def line_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.lit(40) + F.col("ord") % 200, F.lit(60) + F.col("budget") * 7
    sized = lines(spark, sf_dir).select("page_id", "ord", w.alias("w"), h.alias("h"), t.original_size(w, h, F.col("text")).alias("size"))
    return sized.select("page_id", "ord", "size", t.room_in_characters(F.col("w"), F.col("h"), F.col("size"), F.col("size") * 0.5).alias("room"))


@query(with_views("""select page_id, ord, concat_ws(' | ', replace(replace('Put {source} into {target}; keep {this}', '{target}', kind), '{source}', substring(text, 1, 5)),
  case when ord % 3 = 0 then 'third' end, case when budget = 1 then '1 page' else budget || ' pages' end) as prompt from lines""", "lines"))
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = t.filled(F.lit("Put {source} into {target}; keep {this}"), F.col("kind"), F.substring("text", 1, 5))
    third = F.when(F.col("ord") % 3 == 0, "third").otherwise("")
    return lines(spark, sf_dir).select("page_id", "ord", t.joined([filled, third, t.plural(F.col("budget"), "page")], " | ").alias("prompt"))


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(with_views(f"""with w as (select page_id, ord, {_WORDS} as words from lines)
select page_id, ord, case when len(words) = 0 then '' else list_reduce(words, lambda acc, x: case when length(regexp_extract(acc, '[^\n]*$', 0)) + 1 + length(x) <= 24 then acc || ' ' || x else acc || chr(10) || x end) end as wrapped from w""", "lines"))
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page_id", "ord", layout.wrapped(F.col("text"), F.lit(24)).alias("wrapped"))


@query(with_views(f"""with w as (select page_id, ord, list_transform({_WORDS}, lambda x: length(x)) as n from lines),
s as (select page_id, ord, unnest(range(6, 31)) as size, n from w where len(n) > 0),
f as (select *, floor(300 / (size * 0.5))::int as most from s),
c as (select page_id, ord, size, most, n, list_reduce(list_prepend(0::bigint, n), lambda acc, x: case when acc > 0 and acc % 100000 + 1 + x <= most then acc + 1 + x else (acc // 100000 + 1) * 100000 + x end) // 100000 as lines from f)
select page_id, ord, coalesce(max(size) filter (list_max(n) <= most and lines * size * 1.15 <= 220), 6)::int as size from c group by 1, 2""", "lines"))
def font_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("page_id", "ord", F.transform(layout.words(F.col("text")), lambda w: F.length(w)).alias("word_lengths")).where("size(word_lengths) > 0")
    return rows.select("page_id", "ord", layout.largest_size(F.lit(300), F.lit(220), 6, 30).alias("size"))


@query(with_views(f"""with w as (select page_id, ord, list_transform({_WORDS}, lambda x: length(x)) as n from lines),
s as (select page_id, ord, unnest(range(6, 31)) as size, n from w where len(n) > 0),
f as (select *, floor(60 / (size * 0.5))::int as most from s),
c as (select page_id, ord, size, most, n,
  list_reduce(list_prepend(0::bigint, n), lambda acc, x: case when acc > 0 and acc % 100000 + 1 + x <= most then acc + 1 + x else (acc // 100000 + 1) * 100000 + x end) // 100000 as lines,
  list_reduce(list_prepend(0::bigint, n), lambda acc, x: case when x > most then (acc // 100000 + (x + most - 2) // (most - 1)) * 100000 + x - ((x + most - 2) // (most - 1) - 1) * (most - 1)
    when acc > 0 and acc % 100000 + 1 + x <= most then acc + 1 + x else (acc // 100000 + 1) * 100000 + x end) // 100000 as cut_lines from f)
select page_id, ord, coalesce(max(size) filter (list_max(n) <= most and lines * size * 1.15 <= 400), max(size) filter (most >= 2 and cut_lines * size * 1.15 <= 400), 6)::int as size from c group by 1, 2""", "lines"))
def font_fit_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in a narrow column: words are cut only where no size takes them whole."""
    rows = lines(spark, sf_dir).select("page_id", "ord", F.transform(layout.words(F.col("text")), lambda w: F.length(w)).alias("word_lengths")).where("size(word_lengths) > 0")
    return rows.select("page_id", "ord", layout.largest_size(F.lit(60), F.lit(400), 6, 30, hyphens=True).alias("size"))


@query(with_views("select page_id, ord, sha256(text) as hash from lines", "lines"))
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page_id", "ord", F.sha2("text", 256).alias("hash"))


@query(with_views(r"""with v as (select page_id, ord, length(text) as n, trim(substring(text, 1, length(text) // 3), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as first, trim(substring(text, length(text) // 3 + 1), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as second from lines)
select page_id, ord, case when first <> '' and second <> '' then first end as first, case when first <> '' and second <> '' then second end as second,
  case when first <> '' and second <> '' then (n // 3)::double / n end as share from v""", "lines"))
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines split at a caret a third of the way in; none where a side would be blank."""
    caret = F.floor(F.length("text") / 3).cast("int")
    rows = lines(spark, sf_dir).select("page_id", "ord", t.split_at(F.col("text"), caret).alias("s"))
    return rows.select("page_id", "ord", "s.first", "s.second", "s.share")


@query(with_views(r"""with p as (select page_id, ord, unnest([text, substring(text, 5)]) as part, unnest([1, 2]) as k from lines),
w as (select *, list_filter(regexp_split_to_array(part, '\s+'), lambda x: x <> '') as words from p),
c as (select *, flatten(list_transform(words, lambda x: case when length(x) > 8
  then list_transform(range(0, (length(x) - 1) // 7 + 1), lambda i: chr(1) || substring(x, (i * 7 + 1)::int, 7) || case when i < (length(x) - 1) // 7 then '-' else '' end) else [x] end)) as tokens from w),
l as (select page_id, ord, k, case when len(tokens) = 0 then '' else replace(list_reduce(tokens, lambda acc, x:
  case when not starts_with(x, chr(1)) and length(replace(regexp_extract(acc, '[^
]*$', 0), chr(1), '')) + 1 + length(x) <= 8 then acc || ' ' || x else acc || chr(10) || x end), chr(1), '') end as line from c)
select page_id, ord, coalesce(string_agg(line, chr(10) order by k) filter (line <> ''), '') as wrapped from l group by 1, 2""", "lines"))
def hyphen_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paragraphs from each line, in lines of eight characters."""
    two = F.concat("text", F.lit("\n"), F.substring("text", F.lit(5), F.length("text")))
    return lines(spark, sf_dir).select("page_id", "ord", layout.hyphenated(two, F.lit(8)).alias("wrapped"))
