from pyspark.sql import functions as F

from inkfold.functions import geometry as g
from inkfold.functions.geometry import Box


def lit(*values):
    return Box(*[F.lit(v) for v in values])


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_edges_and_centre(spark):
    b = lit(10, 20, 40, 80)
    assert one(spark, b.w, b.h, b.cx, b.cy, b.area) == (30, 60, 25.0, 50.0, 1800)


def test_box_from_values(spark):
    rows = spark.createDataFrame([(["1.4", "2.6", "30", "40.0"],), (["60", "40", "10", "5"],), (["1", "x", "3", "4"],), (["1", "2", "3"],)], "v array<string>")
    got = [tuple(r) for r in rows.select(*g.box_from_values(F.col("v"), 200, 140).columns()).collect()]
    assert got == [(1, 3, 30, 40), (10, 5, 60, 40), (None,) * 4, (None,) * 4]


def test_wholly_off_the_page_is_empty(spark):
    assert one(spark, *lit(300, 10, 400, 50).clipped(200, 140).columns()) == (200, 10, 200, 50)


def test_covers_is_symmetric_and_within_is_not(spark):
    small, large = lit(0, 0, 10, 10), lit(5, 0, 105, 10)
    assert one(spark, small.covers(large), large.covers(small), small.within(large), large.within(small)) == (0.5, 0.5, 0.5, 0.05)
    assert one(spark, small.covers(lit(20, 20, 20, 30)), lit(1, 1, 1, 1).within(small)) == (0.0, 0.0)


def test_cropped_is_never_negative(spark):
    c = lit(0, 0, 10, 10).cropped(lit(20, 20, 30, 30))
    assert one(spark, c.w, c.h) == (0, 0)


def test_rounding(spark):
    assert one(spark, g.even_round(F.lit(2.5)), g.even_round(F.lit(3.5)), g.js_round(F.lit(-2.5)), g.js_round(F.lit(2.5))) == (2, 4, -2, 3)


def test_padding_is_two_pixels_at_least(spark):
    assert one(spark, *lit(10, 10, 20, 20).padded(0.04, 2, 200, 140).columns()) == (8, 8, 22, 22)
    assert one(spark, *lit(0, 0, 100, 100).padded(0.04, 2, 200, 140).columns()) == (0, 0, 104, 104)


def test_shrinking_keeps_a_box_that_would_vanish(spark):
    assert one(spark, *lit(0, 0, 100, 50).shrunk(0.12).columns()) == (6, 6, 94, 44)
    assert one(spark, *lit(0, 0, 2, 2).shrunk(0.12).columns()) == (0, 0, 2, 2)


def test_halves_come_in_reading_order(spark):
    first, second = lit(0, 0, 100, 40).halves(0.3, 12, True)
    assert one(spark, *first.columns(), *second.columns("s")) == (30, 0, 100, 40, 0, 0, 30, 40)
    first, second = lit(0, 0, 100, 40).halves(0.3, 12, False)
    assert one(spark, *first.columns(), *second.columns("s")) == (0, 0, 30, 40, 30, 0, 100, 40)
    first, second = lit(0, 0, 20, 22).halves(0.1, 12, True)
    assert one(spark, *first.columns(), *second.columns("s")) == (0, 0, 20, 11, 0, 11, 20, 22)


def test_angles_and_working_size(spark):
    assert one(spark, g.angle(F.lit(-90)), g.angle(F.lit(450))) == (270, 90)
    assert one(spark, *g.working_size(F.lit(4000), F.lit(1000))) == (2000, 500)
    assert one(spark, *g.letterbox(F.lit(100), F.lit(200), 640)) == (3.2, 320, 0)
