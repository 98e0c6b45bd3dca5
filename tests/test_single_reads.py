from pyspark.sql import functions as F

from inkfold.operators import models
from inkfold.plans import catalog, fakes


def test_rooms_are_told_from_blocks_that_are_analysed_once(spark):
    plan = catalog.QUERIES["update_rooms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_pages_that_span_batches_are_asked_as_one(spark):
    asked = spark.createDataFrame([(p, n, f"x{n}") for p in range(4) for n in range(1, 6)], "page_id long, n int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = models.translated(asked, fakes.fake_asker).where(F.col("asks") == 1).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == 20
