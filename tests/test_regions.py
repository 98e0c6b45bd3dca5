from pyspark.sql import functions as F

from inkfold.operators import regions as r
from inkfold.operators.space import divide

SCHEMA = "page_id long, det_id int, label int, score double, x0 int, y0 int, x1 int, y1 int"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, label, score, *b) for i, (label, score, b) in enumerate(rows)], SCHEMA)


def test_duplicates_keep_the_surest(spark):
    d = boxes(spark, (1, 0.91, (540, 300, 620, 500)), (1, 0.62, (543, 305, 619, 501)), (1, 0.91, (540, 640, 620, 840)))
    assert sorted(x.det_id for x in r.suppressed(d, ["page_id"]).collect()) == [0, 2]


def test_only_kept_boxes_suppress(spark):
    d = boxes(spark, (1, 0.9, (0, 0, 100, 100)), (1, 0.8, (20, 0, 120, 100)), (1, 0.7, (45, 0, 145, 100)))
    assert sorted(x.det_id for x in r.suppressed(d, ["page_id"]).collect()) == [0, 2]


def test_threshold_clip_and_kinds(spark):
    d = boxes(spark, (0, 0.35, (-5, 0, 50, 50)), (1, 0.349, (0, 0, 50, 50)), (2, 0.9, (199, 0, 260, 50)), (7, 0.9, (0, 0, 9, 9)))
    got = r.on_page(r.confident(d), 200, 140).withColumn("kind", r.kind(F.col("label"))).collect()
    assert {(x.det_id, x.kind, x.x0) for x in got} == {(0, "bubble", 0), (3, None, 0)}


def test_reading_order_on_one_height(spark):
    d = boxes(spark, (1, 0.9, (0, 10, 20, 30)), (1, 0.9, (50, 10, 90, 30)), (1, 0.9, (0, 5, 9, 9)))
    assert [x.det_id for x in r.in_reading_order(d, True).orderBy("ord").collect()] == [2, 1, 0]
    assert [x.det_id for x in r.in_reading_order(d, False).orderBy("ord").collect()] == [2, 0, 1]


def test_smallest_balloon_wins_and_half_out_has_none(spark):
    blocks = boxes(spark, (1, 0.9, (40, 40, 60, 60)), (1, 0.9, (80, 80, 160, 160)))
    balloons = boxes(spark, (0, 0.9, (0, 0, 200, 100)), (0, 0.9, (30, 30, 70, 70)), (0, 0.9, (31, 30, 71, 70)))
    got = {x.det_id: x.balloon_id for x in r.assigned(blocks, balloons).collect()}
    assert got == {0: 1, 1: None}


def test_insertion_goes_before_what_is_strictly_after(spark):
    page = r.in_reading_order(boxes(spark, (1, 0.9, (0, 0, 10, 10)), (1, 0.9, (0, 20, 10, 30)), (1, 0.9, (0, 40, 10, 50))), True)
    new = boxes(spark, (2, 0.9, (0, 20, 10, 25)), (2, 0.9, (0, 90, 10, 99)), (2, 0.9, (0, 19, 10, 25)))
    assert {x.det_id: x["at"] for x in r.insertion_points(new, page, True).collect()} == {0: 2, 1: 3, 2: 1}


def test_moves_splits_and_updates(spark):
    rows = spark.createDataFrame([(1, i, i * 10, 0, 0, 100, 40) for i in range(4)], "page_id long, ord int, det_id int, x0 int, y0 int, x1 int, y1 int")
    order = lambda df: [x.det_id for x in df.orderBy("ord").collect()]
    assert order(r.moved(rows, F.lit(0), F.lit(2))) == [10, 20, 0, 30]
    assert order(r.moved(rows, F.lit(3), F.lit(1))) == [0, 30, 10, 20]
    assert order(r.split_at(rows, F.lit(1))) == [0, 10, 10, 20, 30]
    news = spark.createDataFrame([(10, None), (99, 5)], "det_id int, x0 int")
    assert {x.det_id: x.x0 for x in r.updated(rows, news, ["det_id"], "x0").collect()} == {0: 0, 10: None, 20: 0, 30: 0}


def area(c):
    return (c[2] - c[0]) * (c[3] - c[1])


def test_divided_space_is_covered_without_overlap():
    space = (100, 100, 500, 400)
    for blocks in (
        [(110, 150, 200, 300), (300, 150, 400, 300)],
        [(110, 110, 200, 180), (110, 300, 200, 390)],
        [(110, 110, 200, 180), (300, 110, 400, 180), (110, 300, 200, 390), (300, 300, 400, 390)],
        [(110, 110, 250, 200), (200, 150, 350, 300), (120, 310, 220, 390)],
    ):
        cells = divide(space, blocks)
        assert sum(map(area, cells)) == area(space)
        for i, a in enumerate(cells):
            for b in cells[:i]:
                assert min(a[2], b[2]) <= max(a[0], b[0]) or min(a[3], b[3]) <= max(a[1], b[1])
    cells = divide(space, [(110, 150, 200, 300), (300, 150, 400, 300)])
    assert cells == [(100, 100, 250, 400), (250, 100, 500, 400)]


def test_detections_are_numbered_once_for_regions_and_patches(spark):
    from inkfold.plans import catalog

    plan = catalog.QUERIES["patched_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "row_number" not in plan
