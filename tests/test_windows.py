"""Windows, ordinals and sequences against plain loops, with small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import lookup, windows


@pytest.mark.parametrize("height,stride,lines", [(64, 16, 200), (10, 10, 35), (4, 9, 40), (7, 3, 20), (30, 7, 5)])
def test_frame_ids(spark, height, stride, lines):
    df = windows.assign_frames(spark.range(lines).withColumnRenamed("id", "line"), height, stride)
    want = {
        (i, k)
        for k in range(-(-lines // stride))
        for i in range(k * stride, min(lines, k * stride + height))
    }
    assert {tuple(r) for r in df.select("line", "frame_id").collect()} == want


def _lines(spark, lines, seed):
    rng = random.Random(seed)
    rows = [("s", i, lines, rng.random() > 0.3, i % 16, i * 10) for i in range(lines)]
    return rows, spark.createDataFrame(rows, "source string, line bigint, source_lines bigint, valid boolean, nibble int, v bigint")


@pytest.mark.parametrize("height,stride,lines", [(64, 16, 203), (96, 32, 150), (32, 48, 170), (40, 12, 100), (16, 16, 33)])
def test_summary_and_rows(spark, height, stride, lines):
    rows, df = _lines(spark, lines, height)
    summary = {r.frame_id: r for r in windows.window_summary(df, height, stride, F.col("v")).collect()}
    placed = {(r.frame_id, r.line): r.out_row for r in windows.compact_rows(df, height, stride).collect()}
    want_rows = {}
    for k in range(-(-lines // stride)):
        window = rows[k * stride : k * stride + height]
        valid = [r for r in window if r[3]]
        starts = [r for r in valid if r[4] == 0 and r[1] - k * stride + 16 <= len(window)]
        got = summary[k]
        assert (got.n_lines, got.n_valid) == (len(window), len(valid))
        assert (got.window_start.sample if got.window_start else None) == (starts[0][5] if starts else None)
        assert (got.window_end.line if got.window_end else None) == (starts[-1][1] if starts else None)
        want_rows |= {(k, r[1]): i for i, r in enumerate(valid)}
    assert placed == want_rows


def test_look_ahead_crosses_blocks(spark):
    _, df = _lines(spark, 130, 1)
    got = windows.look_ahead(df, "v", (3, 14), block_lines=32).collect()
    assert len(got) == 130
    for r in got:
        assert r.v_3 == (r.line * 10 + 30 if r.line + 3 < 130 else None)
        assert r.v_14 == (r.line * 10 + 140 if r.line + 14 < 130 else None)


def test_sequence_gaps_and_contiguity_of_a_hot_source(spark):
    rng = random.Random(3)
    ids = {"hot": sorted(rng.sample(range(3000), 2000)), "cold": list(range(50)), "late": [5, 6, 900]}
    rows = [(s, i) for s, v in ids.items() for i in v]
    df = spark.createDataFrame(rows, "source string, frame_id bigint").repartition(7)
    numbers = windows.sequence_number(df, ("source",), "frame_id", "n", block_lines=64)
    assert {(r.source, r.frame_id): r.n for r in numbers.collect()} == {
        (s, i): n for s, v in ids.items() for n, i in enumerate(v)
    }
    want = {(s, a, b) for s, v in ids.items() for a, b in zip([-1, *v], v) if b - a > 1}
    assert {tuple(r) for r in windows.gaps(df, block_lines=64).collect()} == want
    doubled = df.union(df.where("source = 'cold' AND frame_id = 3"))
    verdict = {r.source: r.contiguous for r in windows.contiguity(doubled).collect()}
    assert verdict == {"hot": False, "cold": False, "late": False}
    assert {r.source: r.contiguous for r in windows.contiguity(df).collect()}["cold"]


def test_global_index_is_the_sorted_position(spark):
    words = [f"{random.Random(i).random():.9f}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "path string").repartition(5)
    got = {r.path: r["index"] for r in windows.global_index(df, ["path"]).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_hot_frame_keeps_all_rows_and_is_not_ranked(spark):
    df = spark.range(20000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS frame_id", "id AS place")
    placed = windows.bounded_ordinals(df, ["frame_id"], ["place"], 256)
    sizes = {r.over_limit: r.n for r in placed.groupBy("over_limit").agg(F.count("*").alias("n")).collect()}
    assert sizes == {True: 6667, False: 20000 - 6667}
    assert placed.where("over_limit AND target_index IS NOT NULL OR NOT over_limit AND target_index <> 0").count() == 0


def test_first_ranked(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id")
    best = windows.first_ranked(df, ["g"], [F.col("id").desc()], 2).collect()
    assert {(r.g, r["rank"], r.id) for r in best} == {(0, 1, 99), (0, 2, 96), (1, 1, 97), (1, 2, 94), (2, 1, 98), (2, 2, 95)}


@pytest.mark.parametrize("settle_rows", [100_000, 0])
def test_ordinals_read_the_rows_once(spark, tmp_path, monkeypatch, settle_rows):
    """Crowded frames, found by a count, are a broadcast of rows that are there; above the bound they are joined by shuffle."""
    monkeypatch.setattr(lookup.settled, "__defaults__", (settle_rows,))
    rows = [(f, p) for f in range(5) for p in range(400 if f == 3 else f + 1)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "frame_id long, place long").repartition(3).write.parquet(path)
    placed = windows.bounded_ordinals(spark.read.parquet(path), ["frame_id"], ["place"], 256)
    if settle_rows:
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan
    got = {(r.frame_id, r.place): (r.over_limit, r.target_index) for r in placed.collect()}
    assert got == {(f, p): (True, None) if f == 3 else (False, p) for f, p in rows}
    few = spark.read.parquet(path).where("frame_id <> 3")
    assert windows.crowded_keys(few, ["frame_id"], 256) is None
    assert windows.bounded_ordinals(few, ["frame_id"], ["place"], 256).where("over_limit").count() == 0
