"""Marks by joins against the numpy rasters, on pages with long winding marks."""

import numpy as np
import pytest

from inkfold.functions import raster
from inkfold.operators import gallery, marks
from pyspark.sql import functions as F


def spiral(n):
    """One mark that winds inwards, so labels have a long way to go."""
    out = np.zeros((n, n), np.uint8)
    x0, y0, x1, y1 = 0, 0, n - 1, n - 1
    x, y = 0, 0
    while x0 < x1 and y0 < y1:
        out[y0, x:x1 + 1] = 1
        out[y0:y1 + 1, x1] = 1
        out[y1, x0:x1 + 1] = 1
        out[y0 + 2:y1 + 1, x0] = 1
        x = x0
        x0, y0, x1, y1 = x0 + 2, y0 + 2, x1 - 2, y1 - 2
    return out


def pages():
    rng = np.random.RandomState(5)
    found = [(rng.rand(h, w) < share).astype(np.uint8) for h, w, share in ((40, 60, 0.4), (60, 40, 0.55), (30, 90, 0.25), (1, 50, 0.5), (50, 1, 0.5))]
    return [*found, spiral(41), np.zeros((5, 5), np.uint8), np.ones((9, 7), np.uint8)]


def cells_of(spark, images):
    rows = [(k, int(x), int(y)) for k, image in enumerate(images) for y, x in zip(*np.nonzero(image))]
    return spark.createDataFrame(rows, "page long, x int, y int").repartition(4)


@pytest.mark.parametrize("reach", [1, 0])
def test_marks_equal_the_raster(spark, reach):
    images = pages()
    got = {}
    for r in marks.numbered(marks.labelled(cells_of(spark, images), "page", reach), "page").collect():
        got[r.page, r.y, r.x] = r.component
    for k, image in enumerate(images):
        if reach:
            want = raster.labelled(image * 255)[0]
        else:  # by flooding from each pixel in turn
            want, n = np.zeros(image.shape, int), 0
            for y, x in zip(*np.nonzero(image)):
                if want[y, x]:
                    continue
                n, todo = n + 1, [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < image.shape[0] and 0 <= b < image.shape[1] and image[a, b] and not want[a, b]:
                        want[a, b] = n
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert {(y, x): int(want[y, x]) for y, x in zip(*np.nonzero(image))} == {(y, x): c for (p, y, x), c in got.items() if p == k}


def test_patches_equal_the_raster(spark):
    rng = np.random.RandomState(6)
    images = [(rng.rand(60, 80) < 0.004).astype(np.uint8) for _ in range(6)]
    got = {}
    for r in marks.patches(cells_of(spark, images), "page", 80, 60, apart=8, least=3, context=0.5).collect():
        got.setdefault(r.page, []).append((r.patch, r.x0, r.y0, r.x1, r.y1))
    for k, image in enumerate(images):
        want = [(i, *map(int, b)) for i, b in enumerate(raster.patches(image * 255, apart=8, least=3, context=0.5))]
        assert sorted(got.get(k, [])) == want


def test_slices_equal_the_raster(spark):
    rng = np.random.RandomState(7)
    images = [(rng.rand(20, 14) < share).astype(np.uint8) * (rng.rand(1, 14) < 0.6) for share in (0.1, 0.3, 0.6)] + [(rng.rand(9, 30) < 0.5).astype(np.uint8) * (rng.rand(9, 1) < 0.7) for _ in range(4)] + [np.zeros((6, 4), np.uint8)]
    regions = spark.createDataFrame([(k, *image.shape[::-1]) for k, image in enumerate(images)], "page long, w int, h int")
    got = {}
    for r in marks.slices(cells_of(spark, images), regions, "page", F.col("w"), F.col("h")).orderBy("page", "ord").collect():
        got.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    assert got == {k: [tuple(map(int, b)) for b in raster.slices(image)] for k, image in enumerate(images)}


def test_names_of_mixed_families_equal_probing_in_order(spark):
    import random

    rng = random.Random(8)
    rows = []
    for folder in ("a", "b", None):
        for place in range(120):
            rows.append((folder, place, rng.choice(["p.png", "p (2).png", "p (3).png", "p (2) (2).png", "q", "q (2)", "x.tar.gz", "x.tar (4).gz", "y\nz.png"])))
    got = {(r.folder, r.place): r.unique_name for r in gallery.unique_names(spark.createDataFrame(rows, "folder string, place int, name string").repartition(5), "folder", "name", "place").collect()}
    for folder in ("a", "b", None):
        taken = set()
        for _, place, name in sorted((r for r in rows if r[0] == folder), key=lambda r: r[1]):
            dot = name.rfind(".")
            stem, ending = (name[:dot], name[dot:]) if dot > -1 else (name, "")
            own, n = name, 2
            while own in taken:
                own, n = f"{stem} ({n}){ending}", n + 1
            taken.add(own)
            assert got[folder, place] == own
    assert gallery.without_masks(spark.createDataFrame([("1@0", 5), ("11@0", 6), ("1@12", 7)], "key string, ink int"), spark.createDataFrame([(1,)], "page_id long")).collect() == [("11@0", 6)]


def test_rooms_found_on_pixels_are_cropped_to_their_cells(spark):
    """Pages of bright and dark balloons, some shared, some too small, and blocks without any, against the steps one by one."""
    from inkfold.operators import space

    rng = np.random.RandomState(9)
    w, h, pages, blocks = 120, 90, [], []
    for page in range(6):
        grey = np.full((h, w), 60, np.uint8)
        balloons = [(5, 5, 60, 45), (70, 10, 115, 80), (10, 60, 50, 85)]
        for k, (x0, y0, x1, y1) in enumerate(balloons):
            grey[y0:y1, x0:x1] = 240 if (page + k) % 3 else 10
        n = 0
        for k, (x0, y0, x1, y1) in enumerate(balloons):
            for _ in range(rng.randint(0, 4)):
                bx, by = int(rng.randint(x0 + 1, x1 - 14)), int(rng.randint(y0 + 1, y1 - 10))
                box = (bx, by, bx + int(rng.randint(3, 13)), by + int(rng.randint(4, 9)))
                grey[box[1] : box[3], box[0] : box[2]][::2, ::2] = 128
                blocks.append((page, n, n, k, *box, *balloons[k]))
                n += 1
        blocks.append((page, n, n, None, 0, 0, 10, 10, None, None, None, None))
        pages.append((page, grey.tobytes()))
    kinds = "page_id long, ord int, det_id int, balloon_id int, x0 int, y0 int, x1 int, y1 int, bx0 int, by0 int, bx1 int, by1 int"
    got = {(r.page_id, r.det_id): r.rx0 if r.rx0 is None else (r.rx0, r.ry0, r.rx1, r.ry1) for r in space.rooms(spark.createDataFrame(pages, "page_id long, grey binary"), spark.createDataFrame(blocks, kinds).repartition(3), w, h).collect()}
    assert len(got) == len(blocks)
    seen = {"alone": 0, "cropped": 0, "none": 0}
    for page, data in pages:
        grey = np.frombuffer(data, np.uint8).reshape(h, w)
        for k in (0, 1, 2, None):
            own = [b for b in blocks if b[0] == page and b[3] == k]
            cells = space.divide((0, 0, w, h), [b[4:8] for b in own]) if k is not None and own else []
            for b, cell in zip(own, cells or [None] * len(own)):
                room = None if k is None else space.room_inside(grey, b[8:12], b[4:8])
                if room and len(own) > 1:
                    x0, y0 = max(room[0], cell[0]), max(room[1], cell[1])
                    room = (x0, y0, max(x0, min(room[2], cell[2])), max(y0, min(room[3], cell[3])))
                    shared = max(0, min(b[6], room[2]) - max(b[4], room[0])) * max(0, min(b[7], room[3]) - max(b[5], room[1]))
                    room = room if shared >= 0.85 * (b[6] - b[4]) * (b[7] - b[5]) else None
                seen["none" if room is None else "cropped" if len(own) > 1 else "alone"] += 1
                assert got[page, b[2]] == room
    assert min(seen.values()) > 0
