from pyspark.sql import functions as F

from inkfold.functions import jsonx, text as t
from inkfold.plans import fakes
from inkfold.operators import context, folds, gallery, languages, lines as ln, models


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_strip_is_unicode_and_templates_are_literal(spark):
    assert one(spark, t.strip(F.lit("　 a b　")), t.blank(F.lit("　"))) == ("a b", True)
    assert one(spark, t.filled(F.lit("{target} {x} {source}"), F.lit("{source}!"), F.lit("en"))) == ("en! {x} en",)


def test_formats(spark):
    assert one(spark, t.numbered(F.lit(1), F.lit(" おはよう "), F.lit(""), F.lit(18))) == ("1. <=18 おはよう",)
    assert one(spark, t.term(F.lit("a"), F.lit("b"), F.lit(None).cast("string")), t.term(F.lit("a"), F.lit("b"), F.lit("n"))) == ("a = b", "a = b  (n)")
    assert one(spark, t.slug(F.lit(" Brazilian Portuguese! ")), t.slug(F.lit("日本"))) == ("brazilian-portuguese", "translated")
    assert one(spark, *[t.bytes_text(F.lit(n)) for n in (5, 1536, 20 * 1024, 3 * 1024**3)]) == ("5 B", "1.5 KB", "20 KB", "3.0 GB")
    assert one(spark, t.plural(F.lit(1), "page"), t.plural(F.lit(2), "page")) == ("1 page", "2 pages")
    assert one(spark, t.original_size(F.lit(100), F.lit(100), F.lit(" ")), t.original_size(F.lit(100), F.lit(100), F.lit("a b"))) == (200, 88)
    assert one(spark, t.room_in_characters(F.lit(100), F.lit(50), F.lit(10), F.lit(5))) == (68,)


def test_natural_order(spark):
    rows = spark.createDataFrame([("Page2.png",), ("page10.png",), ("page1.png",), ("páge1b.png",)], "n string")
    assert [x.n for x in rows.orderBy(t.natural_key(F.col("n"))).collect()] == ["page1.png", "páge1b.png", "Page2.png", "page10.png"]


def test_unique_names_probe_past_taken_ones(spark):
    rows = spark.createDataFrame([("f", i, n) for i, n in enumerate(["a (2).png", "a.png", "a.png", "a.png"])], "folder string, place int, name string")
    got = gallery.unique_names(rows, "folder", "name", "place").orderBy("place").collect()
    assert [x.unique_name for x in got] == ["a (2).png", "a.png", "a (3).png", "a (4).png"]


def test_tightest_budget(spark):
    rows = spark.createDataFrame(
        [(1, 0, "……", "", 40), (1, 1, "行こう", "", None), (1, 2, "……", "", 18), (1, 3, "行こう", "", 9), (2, 0, "x", "", 0), (2, 1, "x", "", 5), (2, 2, "x", "free", 5)],
        "page_id long, ord int, text string, kind string, budget int",
    )
    got = {(x.page_id, x.text, x.kind): (x.n, x.budget, x.copies) for x in ln.asked_once(rows).collect()}
    assert got == {(1, "……", ""): (1, 18, 2), (1, "行こう", ""): (2, 9, 2), (2, "x", ""): (1, 0, 2), (2, "x", "free"): (2, 5, 1)}


def test_context_window(spark):
    pages = spark.createDataFrame([("c", i, f"b{i}" if i != 18 else " ") for i in range(40)], "chapter string, page_no int, beat string")
    got = {x.page_no: x for x in context.around(pages).collect()}
    text = got[20].context
    assert "→ 21. b20" in text and "  15. b14" in text and "  23. b22" in text and "b13" not in text and "b23" not in text and "19." not in text
    assert got[20].n_seen == 9 and got[0].n_seen == 3 and got[39].n_seen == 7


def test_replies(spark):
    good = '{"terms":[{"source":"タロウ"},{"target":"only"},"nonsense",{},{"source":"a","target":"b","note":" "}],"beats":["x"]}'
    for wrap in ("%s", "```json {\n%s\n```", "Here it is: %s. Done"):
        found = one(spark, F.to_json(jsonx.terms(jsonx.reply(F.lit(wrap % good)))))
        assert found == ('[{"source":"a","target":"b"}]',)
    assert one(spark, jsonx.reply(F.lit("none")).isNull(), jsonx.reply(F.lit("")).isNull(), jsonx.reply(F.lit("{bad}")).isNull()) == (True, True, True)
    v = jsonx.reply(F.lit(good))
    assert one(spark, jsonx.beats(v, F.lit(1)), jsonx.beats(v, F.lit(2))) == (["x"], [])
    cast = '{"story":{"scene":" s ","cast":[{"name":"A","gender":"cat"},{"name":"NONE"},{"gender":"male"}]}}'
    v = jsonx.reply(F.lit(cast))
    assert one(spark, F.to_json(jsonx.people(v)), jsonx.scene(v)) == ('[{"name":"A","gender":"unknown","note":""}]', "s")


def test_story_fold_rules(spark):
    person = "struct<name:string,gender:string,note:string,settled:array<string>>"
    held = [("a", "male", "x", ["gender"]), ("b", "unknown", "", [])]
    news = [("a", "female", "y", []), ("b", "female", "", []), ("c", "male", "", [])]
    rows = spark.createDataFrame([(held, news)], f"held array<{person}>, news array<{person}>")
    got = rows.select(folds.merged_cast(F.col("held"), F.col("news"), 3)).first()[0]
    assert [tuple(p)[:3] for p in got] == [("a", "male", "y"), ("b", "female", ""), ("c", "male", "")]
    assert len(rows.select(folds.merged_cast(F.col("held"), F.col("news"), 2)).first()[0]) == 2


def test_beats_are_padded_and_overwritten(spark):
    def fold(held, news, first):
        return one(spark, folds.folded_beats(F.lit(held) if held else F.array().cast("array<string>"), F.lit(news), F.lit(first)))[0]

    assert fold([], ["x", "y"], 2) == ["", "", "x", "y"]
    assert fold(["a", "b", "c", "d"], ["x"], 1) == ["a", "x", "c", "d"]
    assert fold(["a"], ["x", "y"], 0) == ["x", "y"]


def test_forty_people_become_twelve(spark):
    news = spark.createDataFrame([(1, i, f"p{i}", "male", "") for i in range(40)], "chapter long, seq int, name string, gender string, note string")
    assert folds.cast_fold(news).count() == 12
    assert [x.question for x in folds.still_unknown(folds.cast_fold(news.withColumn("gender", F.lit("unknown")))).collect()] == [
        "Still unknown: " + ", ".join(f"p{i}" for i in range(12)) + "."
    ]


def test_languages(spark):
    rows = spark.createDataFrame([(" JA ",), ("",), (None,), ("zh-hant",), ("xx",)], "code_asked string")
    assert [x.code for x in languages.looked_up(rows, "code_asked").collect()] == ["ja", "ja", "ja", "zh-Hant", None]
    assert languages.unknown(rows, "code_asked").count() == 1


def test_retry_then_line_by_line():
    ask = fakes.fake_asker()
    assert models.answers(["a", "b"], ask) == (["<a>", "<b>"], 1)
    assert models.answers(["a", "b", "c"], ask) == (["<a>", "<b>", "<c>"], 2)
    assert models.answers([str(i) for i in range(10)], ask)[1] == 12
    assert models.answers(["a"], lambda request: "no") == ([""], 3)


def test_corrections_settle(spark):
    people = spark.createDataFrame([(1, "a", "male", "", []), (1, "b", "unknown", "n", ["note"])], "chapter long, name string, gender string, note string, settled array<string>")
    edits = spark.createDataFrame([(1, "a", "gender", "female", 1), (1, "a", "gender", "male", 0), (1, "b", "note", "", 2)], "chapter long, name string, fact string, value string, seq int")
    got = {x.name: tuple(x)[2:] for x in folds.corrected(people, edits).collect()}
    assert got == {"a": ("female", "", ["gender"]), "b": ("unknown", "", [])}


def test_folded_beats_keep_every_page(spark):
    rows = spark.createDataFrame([([str(i) for i in range(398)], ["x"] * 8, 396), ([], ["x"] * 8, 496)], "held array<string>, news array<string>, first int")
    a, b = (r[0] for r in rows.select(folds.folded_beats(F.col("held"), F.col("news"), F.col("first"))).collect())
    assert a == [str(i) for i in range(396)] + ["x"] * 8
    assert b == [""] * 496 + ["x"] * 8
