from pyspark.sql import functions as F

from framelake.operators.lookup import both_sides


def test_both_sides_like_except_all(spark):
    """Nulls are equal, rows come as often as they are missing, also many times."""
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c"), (4, "d")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "x")], "k long, v string")
    left = left.union(spark.range(70_000).select(F.lit(9), F.lit("often")))
    want = left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
    count = lambda d: {tuple(r)[:3]: r["count"] for r in d.groupBy("k", "v", "side").count().collect()}
    assert count(both_sides(left, right)) == count(want)
    assert count(both_sides(left.limit(0), right.limit(0))) == {}


def test_tasks_of_both_sides_grow_in_number(spark, monkeypatch):
    """A task counts a bounded number of rows: more rows are more tasks, and both sides are summed once."""
    monkeypatch.setattr("framelake.operators.lookup.ROWS_A_TASK", 1000)
    found = both_sides(spark.range(20_000), spark.range(5, 20_005))
    assert found.rdd.getNumPartitions() >= 40
    assert sorted((r["id"], r["side"]) for r in found.collect()) == [(i, "left") for i in range(5)] + [(i, "right") for i in range(20_000, 20_005)]
