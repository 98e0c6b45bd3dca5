"""Stages that remember, strict shapes, patches and text sizes, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from inkfold.functions import layout, shapes
from inkfold.operators import memo, regions as r, surveys


def counting(spark, calls, broken=()):
    """An answer stage that counts the contents it is asked for."""

    def answer(once):
        def run(frames):
            for frame in frames:
                for content, x in zip(frame["content"], frame["x"]):
                    calls.add(1)
                    if x in broken:
                        raise ValueError("the model died")
                    yield frame.iloc[:0][["content"]].assign(answer="").astype(str) if x == "none" else __import__("pandas").DataFrame({"content": [content] * 2, "answer": [x + "1", x + "2"]})

        return once.mapInPandas(run, "content string, answer string")

    return answer


def test_each_content_is_asked_once_and_answers_fan_out(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    rows = [(i, ["a", "b", "c", "none"][i % 4] if i % 10 else None) for i in range(200)] + [(1000 + i, "hot") for i in range(300)]
    table = spark.createDataFrame(rows, "id long, x string").repartition(6)
    folder = f"file://{tmp_path}/memo"
    got = memo.answered(table, "x", counting(spark, calls), folder)
    want = sorted((i, x, a) for i, x in rows for a in ([None] if x in (None, "none") else [x + "1", x + "2"]))
    seen = sorted(((row.id, row.content, row.answer) for row in got.collect()), key=str)
    assert seen == sorted(((i, x and hashlib.sha256(x.encode()).hexdigest(), a) for i, x, a in want), key=str)
    assert calls.value == 5  # a, b, c, none and hot; what has no answer isn't asked again either
    assert memo.ask_for_new(table, "x", counting(spark, calls), folder) == 0 and calls.value == 5
    assert memo.ask_for_new(spark.createDataFrame([(1, "a"), (2, "new")], "id long, x string"), "x", counting(spark, calls), folder) == 1 and calls.value == 6


def test_a_run_that_died_counts_for_nothing(spark, tmp_path):
    calls, folder = spark.sparkContext.accumulator(0), f"{tmp_path}/memo"
    table = spark.createDataFrame([(i, f"x{i % 5}") for i in range(20)], "id long, x string")
    with pytest.raises(Exception, match="the model died"):
        memo.ask_for_new(table, "x", counting(spark, calls, broken=("x3",)), folder)
    assert memo.ask_for_new(table, "x", counting(spark, calls), folder) == 5
    # answers of a run that never got as far as to note what it asked
    spark.createDataFrame([(hashlib.sha256(b"x1").hexdigest(), "stray")], "content string, answer string").write.parquet(f"{folder}/answers/run=zz")
    assert sorted(x.answer for x in memo.recalled(spark, folder).collect()) == sorted(f"x{i}{k}" for i in range(5) for k in (1, 2))


def test_surveys_end_with_a_reason_and_seed_translation(spark):
    def survey():
        def ask(request):
            if "bad" in request["pages"]:
                raise ValueError("no answer")
            held = [t["source"] for t in request["chapter"]["terms"]]
            beats = [p.upper() for p in request["pages"]]
            return json.dumps({"beats": beats if "short" not in request["pages"] else beats[1:], "terms": [{"source": p, "target": f"{request['first']}/{len(held)}"} for p in request["pages"]] + [{"source": "only"}, "odd"], "cast": [{"name": p, "gender": "male" if p == "p0" else "odd", "note": ""} for p in request["pages"]] + [{"gender": "male"}], "synopsis": f" s{request['first']} " if request["first"] == 0 else ""})

        return ask

    def translate():
        return lambda request: json.dumps({"translations": [request["lines"][0] + "!"], "terms": [{"source": "p1", "target": "later"}, {"source": "q" + request["lines"][0], "target": "t"}]})

    pages = [("one", i, f"p{i % 3}") for i in range(20)] + [("two", i, "bad" if i == 9 else "short" if i == 3 else "x") for i in range(17)] + [("three", 0, None)]
    table = spark.createDataFrame(pages, "chapter string, page_no int, text string").repartition(3)
    found = surveys.surveyed(surveys.page_windows(table), survey).collect()
    of = lambda chapter, part: [(x.place, x["name"], x.value, x.note) for x in sorted(found, key=lambda x: x.place) if x.chapter == chapter and x.part == part]
    assert of("one", "beat") == [(i, None, f"P{i % 3}", None) for i in range(20)] and of("one", "synopsis") == [(0, None, "s0", None)] and of("one", "why") == []
    assert of("one", "term") == [(0, "p0", "16/3", ""), (1, "p1", "16/3", ""), (2, "p2", "16/3", "")]  # the last holds, in place
    assert of("one", "person") == [(0, "p0", "male", ""), (1, "p1", "unknown", ""), (2, "p2", "unknown", "")]
    assert of("two", "beat") == [] and of("two", "why") == [(8, None, "no answer", None)] and of("two", "term") == [(0, "x", "0/0", ""), (1, "short", "0/0", "")]
    assert of("three", "beat") == [(0, None, "", None)]
    out = surveys.translated(table, spark.createDataFrame(found, surveys.FOUND).where("chapter <> 'two'"), translate).collect()
    known = {c: [x.known for x in sorted(out, key=lambda x: x.page_no) if x.chapter == c] for c in ("one", "two", "three")}
    assert known == {"one": [3, 4, 5, *[6] * 17], "two": [0, 2, 2, 2, *[3] * 6, *[4] * 7], "three": [0]}
    assert {x.people for x in out if x.chapter == "one"} == {"p0, p1, p2"} and {x.people for x in out if x.chapter == "two"} == {""}


PERSON = {"name": " A ", "gender": "male", "note": " n "}


def as_text(x):
    """A value as text: a text itself, others as JSON, what is empty as nothing."""
    return "" if not x else x.strip() if isinstance(x, str) else json.dumps(x, separators=(",", ":"))


def strict_story(said, field="previously"):
    """The rules as they are said, in plain Python: (fault, value)."""
    if not isinstance(said, dict):
        return f"{field}: not an object", None
    cast = said.get("cast") or []
    if not isinstance(cast, list):
        return f"{field}.cast: not a list", None
    people = []
    for i, p in enumerate(cast):
        at = f"{field}.cast[{i}]"
        if not isinstance(p, dict):
            return f"{at}: not an object", None
        name = as_text(p.get("name"))
        if not name:
            return f"{at}.name: no name", None
        if p.get("gender", "unknown") not in shapes.GENDERS:
            return f"{at}.gender: none of male, female, unknown", None
        settled = p.get("settled") or []
        if not isinstance(settled, list):
            return f"{at}.settled: not a list", None
        for j, fact in enumerate(settled):
            if fact not in shapes.FACTS:
                return f"{at}.settled[{j}]: none of gender, note", None
        people.append((name, p.get("gender", "unknown"), as_text(p.get("note"))[:200], settled))
    return None, (as_text(said.get("scene"))[:600], people[:12])


def test_strict_stories_equal_the_rules(spark):
    rng = random.Random(3)
    odd = [None, "", 0, False, True, {}, [], "x", 7, 2.5, [1], {"a": 1}, "　 x　", "é" * 700]
    cases = [odd_one for odd_one in odd]
    for _ in range(400):
        people = []
        for _ in range(rng.choice([0, 1, 3, 14])):
            p = {k: v for k, v in (PERSON | {"settled": rng.choice([[], ["gender"], ["note", "gender"]])}).items() if rng.random() < 0.97 or k == "name"}
            if rng.random() < 0.1:
                p[rng.choice(["name", "gender", "settled", "note"])] = rng.choice(odd[:5] + ["x", 7, [1], ["gender", None], "female", "é" * 300])
            people.append(p if rng.random() < 0.97 else rng.choice(odd[:9]))
        story = {"cast": people, "scene": rng.choice(["s", " s ", None, 5, "é" * 700])}
        if rng.random() < 0.1:
            story["cast"] = rng.choice(odd[:10])
        cases.append(story)
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(-1, "no json"), (-2, None), (-3, "")]
    raw = F.col("raw")
    got = {x.i: x for x in spark.createDataFrame(rows, "i int, raw string").select("i", shapes.fault(raw, shapes.STORY, "previously").alias("why"), shapes.value(raw, shapes.STORY).alias("v")).collect()}
    for i, c in enumerate(cases):
        why, value = strict_story(c)
        v = got[i].v
        assert got[i].why == why, (c, got[i].why, why)
        assert (v and (v.scene, [(p["name"], p.gender, p.note, p.settled) for p in v.cast])) == value, c
    assert got[-1].why == got[-3].why == "previously: not JSON" and got[-2].why is None and got[-1].v is got[-2].v is None


def test_other_shapes(spark):
    def told(shape, *values):
        rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
        out = rows.select("i", shapes.fault(F.col("raw"), shape, "f").alias("why"), shapes.value(F.col("raw"), shape).alias("v")).orderBy("i").collect()
        return [x.why or x.v for x in out]

    term = {"source": " a ", "target": "b", "note": 5}
    got = told(shapes.TERMS, [term, {"source": " ", "target": "b"}, {"source": "c", "target": "d", "note": " " + "n" * 99}], [term, "x"], [{"source": "a"}], [term, {"source": 5, "target": "b"}], {}, [])
    assert [tuple(x) for x in got[0]] == [("a", "b", ""), ("c", "d", "n" * 80)] and got[1:] == ["f[1]: not an object", "f[0].target: needed", "f[1].source: needed", "f: not a list", []]
    assert told(shapes.PAGES, [["a", 5, None], []], [["a"], "b"], "x") == [[["a", "5", ""], []], "f[1]: not a list", "f: not a list"]
    assert told(shapes.BUDGETS, [5, " 7 ", -3, 5.9, -0.5, True, 10**17 + 1], [1, "5.5"], [None], ["x"], [[1]]) == [[5, 7, 0, 5, 0, 1, 10**17 + 1], *["f[1]: not a whole number", "f[0]: not a whole number"], *["f[0]: not a whole number"] * 2]
    assert told(shapes.KINDS_OF_LINES, ["speech", "", None, "free"], ["speech", "loud"], [5]) == [["speech", "", "", "free"], "f[1]: none of speech, free", "f[0]: none of speech, free"]
    chapter = {"synopsis": " s ", "register": None, "beats": [" b ", None, 5] + ["x"] * 500, "cast": [PERSON], "terms": [term]}
    (c, *faults) = told(shapes.CHAPTER, chapter, {"beats": "x"}, {"beats": [], "cast": [{}], "terms": 5}, {"terms": [5]}, {"terms": {"a": 1}}, {"beats": {}, "terms": ""})
    assert (c.synopsis, c.register, len(c.beats), c.beats[:3], c.cast[0]["name"], c.terms[0].source) == ("s", "", 400, ["b", "", "5"], "A", "a")
    assert faults[:4] == ["f.beats: not a list", "f.cast[0].name: no name", "f.terms[0]: not an object", "f.terms: not a list"] and faults[4].beats == faults[4].terms == []
    rows = spark.createDataFrame([(0, '["speech",""]'), (1, '["speech"]'), (2, "[5, 6]"), (3, "{"), (4, None), (5, "5")], "i int, raw string")
    texts = F.array(F.lit("a"), F.lit("b"))
    out = [x.why for x in rows.select("i", shapes.beside(F.col("raw"), texts, shapes.KINDS_OF_LINES, "kinds").alias("why")).orderBy("i").collect()]
    assert out == [None, "kinds: 1 for 2 texts", "kinds[0]: none of speech, free", "kinds: not JSON", None, "kinds: not a list"]
    fills = spark.createDataFrame([(" ART ",), ("white",), ("black",), (None,)], "f string").select(shapes.choice(F.col("f"), shapes.FILLS, "fill").alias("why")).collect()
    assert [x.why for x in fills] == [None, None, "fill: none of art, white", None]


def patched_by_hand(rows, patches):
    rows = {k[:2]: dict(zip(("page_id", "det_id", "x0", "y0", "x1", "y1", "room", "text", "lettered"), k)) for k in rows}
    box_at = {}
    for p in sorted(patches, key=lambda p: p["seq"]):
        if p["kind"] == "box":
            box_at[p["page_id"], p["det_id"]] = p["seq"]
    for p in sorted(patches, key=lambda p: p["seq"]):
        key = p["page_id"], p["det_id"]
        row, stale = rows.get(key), p["asked_at"] is not None and p["asked_at"] < box_at.get(key, -1)
        if row is None:
            continue
        if p["kind"] == "box":
            row.update({e: p[e] for e in r.EDGES}, room=None)
    for p in sorted(patches, key=lambda p: p["seq"]):
        key = p["page_id"], p["det_id"]
        row, stale = rows.get(key), p["asked_at"] is not None and p["asked_at"] < box_at.get(key, -1)
        if row is None or stale:
            continue
        if p["kind"] == "room":
            row["room"] = p["room"]
        if p["kind"] == "reading" and row["text"] is not None:
            row["text"] = p["text"] or ""
        if p["kind"] == "lettering" and row["lettered"] is not None:
            row["lettered"] = p["lettered"]
    return sorted(tuple(x.values()) for x in rows.values())


def test_patches_of_every_kind(spark):
    rng = random.Random(11)
    rows = [(p, d, 1, 2, 30, 40, rng.choice([None, d]), rng.choice([None, "t"]), rng.choice([None, "l"])) for p in range(15) for d in range(8)]
    patches = []
    for seq in rng.sample(range(1000), 300):
        kind = rng.choice(["box", "room", "reading", "lettering"])
        patches.append({"page_id": rng.randrange(16), "det_id": rng.randrange(9), "seq": seq, "kind": kind, "asked_at": rng.randrange(seq + 1) if kind in ("room", "reading") else None, "x0": seq, "y0": 1, "x1": seq + 5, "y1": 9, "room": rng.choice([None, 7]), "text": rng.choice([None, "r"]), "lettered": rng.choice(["p", "q"])})
    kinds = "page_id int, det_id int, x0 int, y0 int, x1 int, y1 int, room int, text string, lettered string"
    table = spark.createDataFrame([tuple(p.values()) for p in patches], "page_id int, det_id int, seq int, kind string, asked_at int, x0 int, y0 int, x1 int, y1 int, room int, text string, lettered string")
    got = r.patched(spark.createDataFrame(rows, kinds), table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(patched_by_hand(rows, patches), key=str)


def lines_by_hand(lengths, most, hyphens):
    lines = used = 0
    for n in lengths:
        if hyphens and n > most:
            parts = -(-n // (most - 1))
            lines, used = lines + parts, n - (parts - 1) * (most - 1)
        elif lines and used + 1 + n <= most:
            used += 1 + n
        else:
            lines, used = lines + 1, n
    return lines


def size_by_hand(lengths, w, h, low, high, hyphens):
    """Every size is tried."""
    for cut in (False, True)[: 1 + hyphens]:
        found = [s for s in range(low, high + 1) if (most := int(w // (s * 0.5))) >= (2 if cut else max(lengths)) and lines_by_hand(lengths, max(most, 2) if cut else most, cut) * s * 1.15 <= h]
        if found:
            return max(found)
    return low


def test_sizes_by_halves_equal_trying_every_size(spark):
    rng = random.Random(13)
    rows = [(i, [rng.choice([1, 2, 3, 5, 9, 14, 30]) for _ in range(rng.choice([1, 2, 5, 20, 80]))], rng.choice([10, 60, 300, 900]), rng.choice([5, 40, 220, 2000])) for i in range(1500)]
    table = spark.createDataFrame(rows, "i int, word_lengths array<int>, w int, h int")
    for low, high, hyphens in ((6, 200, False), (6, 200, True), (6, 30, True), (6, 6, True), (6, 7, False)):
        got = {x.i: x["s"] for x in table.select("i", layout.largest_size(F.col("w"), F.col("h"), low, high, hyphens=hyphens).alias("s")).collect()}
        assert got == {i: size_by_hand(lengths, w, h, low, high, hyphens) for i, lengths, w, h in rows}


def test_what_fits_at_a_size_fits_at_every_smaller_one():
    """Fewer characters a line never make fewer lines, hyphens or not."""
    rng = random.Random(17)
    for _ in range(4000):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 12))]
        for hyphens in (False, True):
            lines = [lines_by_hand(lengths, most, hyphens) for most in range(2 if hyphens else max(lengths), 40)]
            assert lines == sorted(lines, reverse=True), (lengths, hyphens, lines)


def test_nothing_new_moves_no_payload(spark, tmp_path):
    """Where all contents are known, keys alone are compared and no content is put down again."""
    table = spark.createDataFrame([(i, f"x{i % 5}") for i in range(50)], "id long, x string")
    answer = lambda once: once.select("content", "x")
    assert memo.ask_for_new(table, "x", answer, str(tmp_path)) == 5
    assert memo.ask_for_new(table, "x", answer, str(tmp_path)) == 0
    assert len(list((tmp_path / "asking").glob("run=*"))) == 1
