from inkfold.operators import marks


def test_marks_are_joined_without_broadcasts(spark):
    cells = spark.createDataFrame([(p, x, y) for p in range(3) for x in range(6) for y in range(6) if (x + y + p) % 4], "page long, x int, y int")
    for found in (marks.labelled(cells, "page"), marks.patches(cells, "page", 6, 6, apart=2, least=1)):
        assert found.count() > 0
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
