"""Streams: corrections in every order of arrival, and files that come in, with restarts and failures."""

import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from inkfold.functions import raster
from inkfold.operators import folds
from inkfold.streaming import chapters, ingest

EVENTS = "chapter long, seq long, name string, gender string, note string, fact string, value string"


def folded(events, most=12):
    """The cast after each event in turn, by the rules as they are said."""
    cast = {}
    for _, _, name, gender, note, fact, value in sorted(events, key=lambda e: (e[1], e[5] is not None)):
        if not name.strip():
            continue
        if name not in cast:
            if len(cast) >= most:
                continue
            cast[name] = {"gender": "unknown", "note": "", "settled": set()}
        person = cast[name]
        if fact is None:
            for f, said, nothing in (("gender", gender, "unknown"), ("note", note, "")):
                if f not in person["settled"] and said != nothing:
                    person[f] = said
        else:
            nothing = "unknown" if fact == "gender" else ""
            cleared = not value.strip() or value == nothing
            person[fact] = nothing if cleared else value
            person["settled"] = person["settled"] - {fact} | (set() if cleared else {fact})
    return [(n, p["gender"], p["note"], sorted(p["settled"]), i) for i, (n, p) in enumerate(cast.items(), 1)]


def some_events(rng, chapter, n):
    names = [f"k{i}" for i in range(rng.choice([3, 15]))] + ["", " "]
    out = []
    for seq in rng.sample(range(10 * n), n):
        name = rng.choice(names)
        if rng.random() < 0.5:
            out.append((chapter, seq, name, rng.choice(["male", "female", "unknown"]), rng.choice(["", f"n{seq}"]), None, None))
        else:
            fact = rng.choice(["gender", "note"])
            out.append((chapter, seq, name, None, None, fact, rng.choice(["male", "unknown", ""] if fact == "gender" else [f"e{seq}", " ", ""])))
    return out


def rows_of(cast):
    out = {}
    for r in cast.orderBy("chapter", "place").collect():
        out.setdefault(r.chapter, []).append((r["name"], r.gender, r.note, sorted(r.settled), r.place))
    return out


def test_settled_cast_equals_the_fold_in_order(spark):
    rng = random.Random(6)
    events = {c: some_events(rng, c, rng.choice([1, 5, 40, 120])) for c in range(150)}
    every = [e for some in events.values() for e in some]
    rng.shuffle(every)
    got = rows_of(folds.settled_cast(folds.facts(spark.createDataFrame(every, EVENTS).repartition(5))))
    assert got == {c: f for c, some in events.items() if (f := folded(some))}


def test_an_edit_comes_after_news_of_its_number(spark):
    events = [(1, 5, "a", "male", "said", None, None), (1, 5, "a", None, None, "gender", "female"), (1, 5, "a", None, None, "note", "")]
    assert rows_of(folds.settled_cast(folds.facts(spark.createDataFrame(events, EVENTS)))) == {1: [("a", "female", "", ["gender"], 1)]}


@pytest.mark.parametrize("seed", [1, 2])
def test_two_streams_end_alike_in_any_interleaving(spark, tmp_path, seed):
    rng = random.Random(seed)
    every = [e for c in range(20) for e in some_events(rng, c, 40)]
    news = [(e[0], e[1], e[2], e[3], e[4]) for e in every if e[5] is None]
    edits = [(e[0], e[1], e[2], e[5], e[6]) for e in every if e[5] is not None]
    kinds = {"news": "chapter long, seq long, name string, gender string, note string", "edits": "chapter long, seq long, name string, fact string, value string"}
    rng.shuffle(news)
    rng.shuffle(edits)
    cuts = {"news": [0, 7, len(news) // 2, len(news)], "edits": [0, len(edits) - 5, len(edits) - 5, len(edits)]}  # a batch without edits
    for k in range(3):
        for name, rows in (("news", news), ("edits", edits)):
            a, b = cuts[name][k : k + 2]
            spark.createDataFrame(rows[a:b], kinds[name]).write.mode("append").parquet(f"{tmp_path}/{name}")
        streams = [spark.readStream.schema(kinds[n]).parquet(f"{tmp_path}/{n}") for n in ("news", "edits")]
        # every run goes on from the checkpoint of the one before
        chapters.keep(folds.as_events(*streams), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows_of(chapters.kept(spark, f"{tmp_path}/out")) == {c: f for c in range(20) if (f := folded([e for e in every if e[0] == c]))}


def png(shade):
    import numpy as np

    return raster.png(np.full((4, 6), shade, np.uint8))


def test_dropped_files_are_opened_told_apart_and_counted(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(name, data):
        (drop / name).write_bytes(data)
        os.utime(drop / name, (1_700_000_000 + len(data), 1_700_000_000 + len(data)))

    def put_zip(name, entries):
        with zipfile.ZipFile(drop / name, "w") as z:
            for n, data in entries:
                z.writestr(zipfile.ZipInfo(n), data)
        os.utime(drop / name, (1_700_000_000, 1_700_000_000))

    library = own.createDataFrame([("vol:known.png:%d:2023-11-14 22:13:20" % len(png(1)),)], "fingerprint string")
    library.write.parquet(f"{tmp_path}/library")

    def run():
        found = own.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(str(drop))
        files = ingest.with_fingerprint(ingest.opened(found))
        held = own.readStream.schema("fingerprint string").parquet(f"{tmp_path}/library")
        ingest.drain(ingest.write(ingest.told_apart(files, held, "name", 10**9), str(out), f"{tmp_path}/state", "0 seconds"))
        return {(r.folder, r.state): r.n for r in ingest.counted(spark.read.parquet(str(out))).collect()}

    put_zip("vol.cbz", [("p1.png", png(2)), ("p2.png", b"broken"), ("x/p1.png", png(2)), ("known.png", png(1)), ("t.txt", b"t")])
    put("page.png", png(3))
    put("notes.txt", b"notes")
    put("bad.zip", b"bad")
    put_zip("hollow.zip", [("t.txt", b"t")])
    first = run()
    # p1 is in the archive twice under one name, size and time
    want = {("vol", "fresh"): 1, ("vol", "duplicate"): 2, ("vol", "broken"): 1, (None, "fresh"): 1, (None, "rejected"): 1, ("bad", "unopenable"): 1, ("hollow", "hollow"): 1}
    assert first == want
    put_zip("vol.zip", [("p1.png", png(2)), ("p3.png", png(4))])  # the same folder, by another archive of the same time
    sub = drop / "again"
    sub.mkdir()
    (sub / "page.png").write_bytes(png(3))
    os.utime(sub / "page.png", (1_700_000_000 + len(png(3)),) * 2)
    assert run() == want | {("vol", "duplicate"): 3, ("vol", "fresh"): 2, (None, "duplicate"): 1}
    fresh = spark.read.parquet(str(out)).where("state = 'fresh'").collect()
    assert sorted((r.name, r.width, r.height) for r in fresh) == [("p1.png", 6, 4), ("p3.png", 6, 4), ("page.png", 6, 4)]
    assert run() == want | {("vol", "duplicate"): 3, ("vol", "fresh"): 2, (None, "duplicate"): 1}  # nothing new


def test_a_fingerprint_is_held_for_a_time_only(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "fingerprint string, folder string, state string, n long"
    for k in range(2):
        own.createDataFrame([("a", "f", None, k)], kind).write.mode("append").parquet(f"{tmp_path}/in")
        own.createDataFrame([], kind).write.mode("append").parquet(f"{tmp_path}/library")
        stream, held = (own.readStream.schema(kind).parquet(f"{tmp_path}/{n}") for n in ("in", "library"))
        ingest.drain(ingest.write(ingest.told_apart(stream, held, "n", 500), f"{tmp_path}/out", f"{tmp_path}/state", "0 seconds"))
        time.sleep(1)
    assert [r.state for r in spark.read.parquet(f"{tmp_path}/out").orderBy("n").collect()] == ["fresh", "fresh"]


def test_a_crashed_batch_counts_once(spark, tmp_path, monkeypatch):
    """The first run fails after its batch is written and before it is committed."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "fingerprint string, folder string, state string, n long"
    own.createDataFrame([(f"p{i % 7}", "f", "rejected" if i % 5 == 0 else None, i) for i in range(30)], kind).write.parquet(f"{tmp_path}/in")
    own.createDataFrame([("p3", None, None, None)], kind).write.parquet(f"{tmp_path}/library")

    def judged():
        return ingest.told_apart(*(own.readStream.schema(kind).parquet(f"{tmp_path}/{n}") for n in ("in", "library")), "n", 10**9)

    def crash(batch, n):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        raise RuntimeError("crashed")

    query = judged().writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(crash).start()
    with pytest.raises(Exception, match="crashed"):
        query.awaitTermination()
    ingest.drain(ingest.write(judged(), f"{tmp_path}/out", f"{tmp_path}/state", "0 seconds"))
    assert {r.state: r.n for r in ingest.counted(spark.read.parquet(f"{tmp_path}/out")).collect()} == {"rejected": 6, "fresh": 6, "duplicate": 18}
