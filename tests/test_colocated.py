"""Row-level joins of tables kept by frame."""

import pytest

from framelake.operators.colocated import by_frame, frame_rows


@pytest.fixture()
def sides(spark):
    make = spark.createDataFrame
    return [
        make([("a", 1, "f1"), ("a", 2, "f2"), ("b", 1, "f3"), ("a", None, "f4"), (None, 1, "f5")], "source string, frame_id long, frame string"),
        make([("a", 1, "g1"), ("a", 2, "g2"), ("b", 1, "g3"), ("a", None, "g4")], "source string, frame_id long, shape string"),
        make([("a", 1, 10), ("b", 1, 30), ("a", None, 40)], "source string, frame_id long, clock int"),
        make([("a", 1, 7), ("a", 1, 7), ("a", 1, 8), ("a", 2, 9), ("b", 2, 5), ("a", None, 6), (None, 1, 6)], "source string, frame_id long, box int"),
    ]


def test_rows_meet_without_an_exchange(spark, sides):
    kept = by_frame(dict(zip(("f", "g", "c", "t"), sides, strict=True)), buckets=5)
    joined = frame_rows(*kept.values())
    want = [("a", 1, "f1", "g1", 10, 7), ("a", 1, "f1", "g1", 10, 7), ("a", 1, "f1", "g1", 10, 8)]
    assert sorted(map(tuple, joined.collect())) == want
    assert sorted(map(tuple, frame_rows(*sides).collect())) == want
    plan = joined.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    counted = joined.groupBy("source", "frame_id").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_empty_tables_and_clashing_names(sides):
    frames, geometry, telemetry, targets = sides
    assert frame_rows(frames, geometry, telemetry.where("false"), targets).count() == 0
    with pytest.raises(ValueError, match="box"):
        frame_rows(frames, geometry, telemetry.withColumnRenamed("clock", "Box"), targets)
