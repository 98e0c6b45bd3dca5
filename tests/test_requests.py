from pyspark.sql import functions as F

from inkfold.functions import shapes
from inkfold.plans import catalog


def test_a_story_is_parsed_once_and_kinds_are_told_once(spark):
    plan = catalog.QUERIES["strict_stories"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    v = F.try_parse_json(F.col("x"))
    values = ['{"a":[1]}', "[{}]", '"t"', "true", "null", "5", "1.5", "1e300", "no json"]
    rows = spark.createDataFrame([(x,) for x in values], "x string").select("x", shapes.kind_of(v).alias("kind")).collect()
    assert dict(map(tuple, rows)) == dict(zip(values, ["object", "list", "text", "boolean", "nothing", "number", "number", "number", "nothing"]))


def test_equal_replies_are_read_once(spark):
    got = catalog.QUERIES["capped_replies"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("parseJson") and "Aggregate" in plan[plan.index("parseJson"):]
