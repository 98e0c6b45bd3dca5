import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import raster
from inkfold.operators import ink
from inkfold.sources import archive, images


def test_rasterise_and_dilate():
    m = raster.rasterised((10, 10), [(2, 3, 5, 6)])
    assert m.sum() == 9 * 255 and m[3, 2] == 255 and m[6, 5] == 0
    assert (raster.dilated(m, 1) > 0).sum() == 25
    assert (raster.dilated(m, 1, round_=True) > 0).sum() == 21


@pytest.mark.parametrize("corners", [True, False])
def test_components_match_a_flood_fill(corners):
    rng = np.random.RandomState(0)
    for _ in range(20):
        mask = (rng.rand(12, 9) < 0.5).astype(np.uint8)
        want, n = np.zeros(mask.shape, int), 0
        for y in range(12):
            for x in range(9):
                if mask[y, x] and not want[y, x]:
                    n += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 12 and 0 <= b < 9 and mask[a, b] and not want[a, b]:
                            want[a, b] = n
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or 0 in (i, j)]
        got, m = raster.labelled(mask, corners)
        assert m == n and (got == want).all()


def test_holes_are_filled_and_pieces_joined():
    ring = raster.rasterised((9, 9), [(1, 1, 8, 8)])
    ring[3:6, 3:6] = 0
    assert (raster.solid(ring) > 0).sum() == 49
    assert (raster.joined(ring, (3, 3, 6, 6)) > 0).sum() == 49


def test_largest_rectangle_around_a_block():
    mask = raster.rasterised((20, 30), [(2, 2, 28, 18)])
    mask[4, 20] = 0
    best = raster.holding(mask, (10, 8, 12, 10))
    brute = max(
        ((x1 - x0) * (y1 - y0)) for x0 in range(11) for y0 in range(9) for x1 in range(12, 31) for y1 in range(10, 21) if mask[y0:y1, x0:x1].all()
    )
    assert (best[2] - best[0]) * (best[3] - best[1]) == brute
    assert raster.holding(mask, (19, 3, 22, 6)) is None


def test_room_on_light_and_dark_ground():
    page = np.full((60, 80), 40, np.uint8)
    page[10:50, 10:70] = 250
    page[25:30, 35:45] = 0
    assert raster.room(page, (35, 25, 45, 30)) == (10, 10, 70, 50)
    assert raster.room(255 - page, (35, 25, 45, 30)) == (10, 10, 70, 50)


def test_patches_join_near_marks():
    near = raster.rasterised((300, 300), [(100, 100, 110, 110), (115, 100, 125, 110)])
    far = raster.rasterised((300, 300), [(10, 10, 20, 20), (200, 200, 210, 210)])
    assert len(raster.patches(near)) == 1 and len(raster.patches(far)) == 2
    assert raster.patches(near)[0] == (36, 36, 189, 174)


def test_slices():
    rows = np.zeros((40, 100), np.uint8)
    rows[4:9] = rows[20] = rows[30:39] = 1
    assert raster.slices(rows) == [(0, 4, 100, 9), (0, 30, 100, 39)]
    assert raster.slices(rows.T.copy()) == [(30, 0, 39, 100), (4, 0, 9, 100)]
    assert raster.slices(np.zeros((5, 6), np.uint8)) == [(0, 0, 6, 5)]


def test_a_solid_column_is_cut_into_squares():
    assert len(raster.cells(np.ones((100, 20), np.uint8))) == 5
    two = np.ones((50, 20), np.uint8)
    two[22:28] = 0
    assert raster.cells(two) == [(0, 0, 20, 22), (0, 28, 20, 50)]
    assert raster.cells(np.ones((20, 20), np.uint8)) == [(0, 0, 20, 20)]


def test_fill():
    page = np.full((10, 10, 3), 200, np.uint8)
    page[4:6, 4:6] = 0
    mask = raster.rasterised((10, 10), [(4, 4, 6, 6)])
    assert (raster.art_filled(page, mask) == 200).all()
    assert (raster.white_filled(page, mask)[4:6, 4:6] == 255).all()
    assert (raster.art_filled(page, np.full((10, 10), 255, np.uint8)) == 255).all()


def test_page_mask_grows_with_the_page():
    probability = np.zeros((64, 64))
    probability[30:34, 30:34] = 1
    small, large = raster.page_mask(probability, 64, 64, 2), raster.page_mask(probability, 128, 128, 2)
    assert abs((large > 0).mean() - (small > 0).mean()) < 0.01


def test_png_is_read_by_spark(spark, tmp_path):
    image = np.arange(6 * 4 * 3, dtype=np.uint8).reshape(6, 4, 3)
    (tmp_path / "a.png").write_bytes(raster.png(image))
    (tmp_path / "b.png").write_bytes(b"broken")
    row = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).select("image.*").collect()
    assert len(row) == 1 and (np.frombuffer(row[0].data, np.uint8).reshape(6, 4, 3)[..., ::-1] == image).all()
    got = images.library(spark, str(tmp_path)).collect()
    assert [(r.name, r.width, r.height) for r in got] == [("a.png", 4, 6)]


def test_mask_uses_alpha_only_if_it_says_something():
    rgba = np.full((2, 2, 4), 255, np.uint8)
    assert (raster.mask_of(rgba) == 255).all()
    rgba[0, 0, 3] = 0
    assert raster.mask_of(rgba)[0, 0] == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [("f", i, n, n.encode()) for i, n in enumerate(["p10.png", "p2.png", "p2.png", "__MACOSX/x.png", ".hid.png", "n.txt"])]
    archive.pack(spark.createDataFrame([("f.CBZ", *r[1:]) for r in rows], "archive string, place int, name string, data binary"), str(tmp_path))
    got = archive.pages(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.archive, r.name, bytes(r.data)) for r in got] == [("f.CBZ", "p2 (2).png", b"p2.png"), ("f.CBZ", "p2.png", b"p2.png"), ("f.CBZ", "p10.png", b"p10.png")]


def test_runs_and_blanks(spark):
    def cells(bits):
        return spark.createDataFrame([(1, i, b) for i, b in enumerate(bits)], "k int, i int, b int")

    on = F.col("b") == 1
    runs = lambda bits: [(r.start, r.end) for r in ink.runs(cells(bits), "k", on).collect()]
    assert runs([0] * 4 + [1] * 5 + [0] * 3) == [(4, 9)] and runs([0, 1, 0]) == []
    blanks = lambda bits: sorted((r.start, r.length) for r in ink.interior_blanks(cells(bits), "k", on).collect())
    assert blanks([1, 0, 0, 1, 0, 1, 1]) == [(1, 2), (4, 1)] and blanks([0, 1, 1, 0]) == []


def grid(columns, rows, em=20, gap=(0, 0)):
    out = np.zeros((400, 400), np.uint8)
    for c in range(columns):
        for r in range(rows):
            x, y = 20 + c * (em + 2) + (gap[0] if c >= columns / 2 else 0), 20 + r * (em + 2) + (gap[1] if c >= columns / 2 else 0)
            out[y : y + em, x : x + em] = 1
    return out


def test_blocks_split_at_wide_blanks_only():
    from inkfold.functions.layout import split_blocks, strokes

    assert len(split_blocks(grid(4, 6), 20)) == 1
    assert len(split_blocks(grid(4, 6, gap=(18, 0)), 20)) == 2
    assert len(split_blocks(grid(4, 1, gap=(18, 0)), 20)) == 1  # one character deep: 1.5 are wanted
    assert len(split_blocks(grid(4, 1, gap=(40, 0)), 20)) == 2
    assert len(split_blocks(grid(4, 6, gap=(8, 30)), 20)) == 2  # staggered
    assert split_blocks(np.zeros((5, 5)), 20) == []
    assert (strokes((20, 20), [(5, 5)], 2) > 0).sum() == 13 and (strokes((20, 20), [(5, 5), (10, 5)], 0.5) > 0).sum() == 6


def test_coarse_search_stays_inside_and_holds_the_block():
    rng = np.random.RandomState(5)
    for _ in range(20):
        mask = np.where(rng.rand(300, 420) < 0.999, 255, 0).astype(np.uint8)
        y, x = rng.randint(20, 240), rng.randint(20, 360)
        block = (x, y, x + 9, y + 7)
        mask[y - 6 : y + 16, x - 6 : x + 18] = 255
        got, exact = raster.holding(mask, block), raster.holding(mask, block, grid=1000)
        for x0, y0, x1, y1 in (got, exact):
            assert mask[y0:y1, x0:x1].all() and x0 <= block[0] and y0 <= block[1] and x1 >= block[2] and y1 >= block[3]
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        assert area(exact) >= area(got)


def test_first_of_equal_rectangles_in_reading_order():
    mask = raster.rasterised((9, 9), [(3, 0, 6, 9), (0, 3, 9, 6)])
    assert raster.holding(mask, (4, 4, 5, 5)) == (3, 0, 6, 9)
