"""The archive source and sink: planning, pruning, pushed filters, broken archives, commits and aborts."""

import io
import os
import random
import re
import struct
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.operators.gallery import in_natural_order
from inkfold.sources import archive
from inkfold.sources.page_archives import ArchiveReader, directory, entry_header, is_page
from pyspark.sql.types import StructType


def zipped(path, entries, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)


@pytest.fixture
def shelf(tmp_path):
    rng = random.Random(2)
    zipped(tmp_path / "big.zip", [(f"ch/p{i}.png", rng.randbytes(1000)) for i in range(100)] + [("n.txt", b"x"), ("__MACOSX/p.png", b"x"), ("d/", b"")])
    zipped(tmp_path / "small.CBZ", [(f"q{i}.JPG", b"abc" * 100) for i in range(3)], zipfile.ZIP_DEFLATED)
    zipped(tmp_path / "hollow.zip", [("n.txt", b"x"), (".hidden.png", b"x")])
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "empty.cbz").write_bytes(b"")
    (tmp_path / "page.png").write_bytes(b"not an archive")
    return tmp_path


def test_page_entries_are_told_as_columns_tell_them(spark):
    paths = ["a.png", "a/b.JPEG", "__MACOSX/a.png", "x/__MACOSX/a.png", "__MACOSXa/a.png", ".a.png", "x/.a.png", "a.txt", "png", "dir.png/", "a.b/c", "x/a.avif"]
    told = spark.createDataFrame([(p,) for p in paths], "p string").select("p", t.is_page_entry(F.col("p")).alias("is")).collect()
    assert {r.p: r["is"] for r in told} == {p: is_page(p) for p in paths}


def test_large_archives_are_read_by_runs_of_entries(spark, shelf):
    found = archive.entries(spark, f"file://{shelf}", "archive string, path string, size long, data binary, why string", run_bytes="20000")
    assert found.rdd.getNumPartitions() == 6  # five runs of the large one, and all others together
    rows = found.collect()
    good = [r for r in rows if r.why is None]
    assert len({(r.archive, r.path) for r in good}) == len(good) == 103 and all(len(r.data) == r.size for r in good)
    with zipfile.ZipFile(shelf / "big.zip") as z:
        assert all(z.read(r.path) == r.data for r in good if r.archive == "big.zip")
    assert {r.archive for r in rows if r.why} == {"hollow.zip", "broken.zip", "empty.cbz"}
    assert [r.why for r in rows if r.archive == "hollow.zip"] == ["no pages"]


def test_runs_cover_every_wanted_entry_once(shelf):
    fields = StructType.fromDDL("archive string, path string")
    for size in (1, 999, 1000, 1001, 5000, 10**9):
        reader = ArchiveReader({"path": str(shelf / "big.zip"), "run_bytes": str(size)}, fields)
        runs = reader.partitions()
        read = [path for part in runs for _, path in reader.read(part)]
        assert sorted(read) == sorted(f"ch/p{i}.png" for i in range(100))
        assert len(runs) == (1 if size == 10**9 else max(1, 100 // max(1, size // 1000)))


def test_bytes_are_only_read_where_data_is_asked_for(spark, tmp_path):
    zipped(tmp_path / "a.zip", [("p.png", b"x" * 1000)])
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(whole.replace(b"x" * 1000, b"y" * 1000))  # the checksum no longer fits
    assert [r.why for r in archive.entries(spark, str(tmp_path)).collect()] == [None]
    row = archive.entries(spark, str(tmp_path), "path string, data binary, why string").first()
    assert row.data is None and "CRC" in row.why
    with pytest.raises(Exception, match="CRC"):
        archive.entries(spark, str(tmp_path), "path string, data binary", mode="FAILFAST").collect()
    assert archive.entries(spark, str(tmp_path), "path string, data binary, why string", mode="DROPMALFORMED").count() == 0


def test_filters_reach_the_source(spark, shelf):
    found = archive.entries(spark, str(shelf))
    some = found.where(F.col("path").endswith("9.png") & (F.col("archive") == "big.zip") & (F.col("size") > 5))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "size" in plan.split("Filter")[1].split("\n")[0] and "EndsWith" not in plan and "big.zip" not in plan
    assert some.count() == 10
    assert found.where("path in ('q1.JPG', 'q2.JPG')").count() == 2 and found.where("path like 'ch/p1%'").count() == 11
    assert found.where("path is null").count() == 3  # the rows with reasons


def test_of_equal_paths_the_last_counts(spark, tmp_path):
    with pytest.warns(UserWarning):
        zipped(tmp_path / "a.zip", [("p.png", b"old"), ("p.png", b"new")])
    rows = archive.pages(spark, str(tmp_path)).collect()
    assert [(r.place, r.name, bytes(r.data)) for r in rows] == [(0, "p.png", b"new")]


@pytest.mark.parametrize("spread", [False, True])
def test_packed_archives_hold_every_file_in_order(spark, tmp_path, spread):
    rows = [("one.zip", i, f"p{i % 50}.png", bytes([i % 256]) * (i % 7)) for i in range(300)] + [("sub/two.cbz", 1, "é 文.png", b"x"), ("sub/two.cbz", 0, "a.png", None)]
    files = spark.createDataFrame(rows, "archive string, place int, name string, data binary").repartition(6)
    archive.pack(files, f"file://{tmp_path}", spread=spread)
    assert sorted(os.listdir(tmp_path)) == ["one.zip", "sub"] and os.listdir(tmp_path / "sub") == ["two.cbz"]
    with zipfile.ZipFile(tmp_path / "one.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 300
        assert [z.read(n) for n in z.namelist()] == [r[3] for r in rows[:300]]  # as placed
        assert z.namelist()[:3] == ["p0.png", "p1.png", "p2.png"] and z.namelist()[50] == "p0 (2).png"
        assert all(e.compress_type == zipfile.ZIP_STORED for e in z.infolist())
    with zipfile.ZipFile(tmp_path / "sub/two.cbz") as z:
        assert [(n, z.read(n)) for n in z.namelist()] == [("a.png", b""), ("é 文.png", b"x")]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    files = spark.createDataFrame([(f"a{i % 3}.zip", i, f"p{i}.png", b"x" * 100) for i in range(60)], "archive string, place int, name string, data binary").repartition(4)
    killed = F.udf(lambda data, place: data if place != 59 else 1 / 0, "binary")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="division by zero"):
        archive.pack(files.withColumn("data", killed("data", "place")), str(out))
    assert not out.exists() or os.listdir(out) == []
    archive.pack(files.where("archive = 'a0.zip'"), str(out))
    before = (out / "a0.zip").read_bytes()
    with pytest.raises(Exception, match="FileExistsError"):  # one of three is there already: none is written
        archive.pack(files, str(out))
    assert os.listdir(out) == ["a0.zip"] and (out / "a0.zip").read_bytes() == before
    archive.pack(files.where("archive = 'a1.zip'"), str(out), mode="overwrite")
    assert os.listdir(out) == ["a1.zip"]
    clash = spark.createDataFrame([("b.zip", "p.png", b"1"), ("b.zip", "p.png", b"2")], "archive string, path string, data binary")
    for parts in (1, 2):
        with pytest.raises(Exception, match="two entries p.png"):
            clash.repartition(parts).write.format("page_archive").mode("append").save(str(out))
    assert os.listdir(out) == ["a1.zip"]


def test_directories_of_very_large_archives():
    """Entries beyond 4 GB, and more than 65,535 of them, in a file whose entries are left out."""
    start = 5 << 30
    records = b"".join(directory([(b"a.png", 1, 10, 7), (b"b.png", 2, 20, (4 << 30) + 5)], start))
    class Far(io.BytesIO):  # the records, said to stand at `start`
        def seek(self, at, whence=0):
            return super().seek(at - start if whence == 0 else at, whence) + start
        def tell(self):
            return super().tell() + start
    with zipfile.ZipFile(Far(records)) as z:
        assert [(e.filename, e.CRC, e.file_size, e.header_offset) for e in z.infolist()] == [("a.png", 1, 10, 7), ("b.png", 2, 20, (4 << 30) + 5)]
    body = entry_header(b"x", 0, 0)
    many = body + b"".join(directory(((b"%d" % i, 0, 0, 0) for i in range(70_000)), len(body)))
    with zipfile.ZipFile(io.BytesIO(many)) as z:
        assert len(z.infolist()) == 70_000


def by_hand(path):
    """Numbers by value, letters by their base in any script, punctuation before digits before letters."""
    plain = "".join(c for c in unicodedata.normalize("NFD", path.casefold()) if not unicodedata.combining(c))
    parts = re.findall(r"\d+|\D", plain)
    return [(1, int(p), "") if p.isdigit() else (2, 0, p) if p.isalpha() else (0, " _-,;:!?./".index(p), "") for p in parts]


def test_natural_order_equals_a_key_by_hand(spark):
    rng = random.Random(4)
    words = ["page", "PAGE", "pâge", "Ärger", "arger", "зима", "Зима", "άλφα", "Álfa", "", "-", "_", " ", ".", "/"]
    numbers = ["", "0", "1", "01", "9", "10", "010", "123456789", "1234567890", "9" * 17, "9" * 18, "1" + "0" * 18, "1" * 25, "2" * 25, "1" * 40]
    paths = sorted({rng.choice(words) + rng.choice(numbers) + rng.choice(words) + rng.choice(numbers) for _ in range(600)} - {""})
    rows = [(1, p, i) for i, p in enumerate(paths)] + [(1, paths[0], 10**6), (1, paths[7], 10**6)]
    got = in_natural_order(spark.createDataFrame(rows, "g int, path string, n int"), "g", "path", "n").orderBy("place").collect()
    want = sorted(rows, key=lambda r: (by_hand(r[1]), r[1].encode(), r[2]))
    assert [(r.path, r.n) for r in got] == [(r[1], r[2]) for r in want]
