"""Scan-line files with the cases a real file can hold."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.binary import RECORD_BYTES, be_float
from framelake.functions.imaging import unpack_10_to_8
from framelake.operators.dense import dense_frames
from framelake.operators.windows import window_summary
from framelake.plans.products import navigation_records
from framelake.sources.scanlines import scan_frames, scan_lines

MAGIC = bytes.fromhex("FAF3340A01")


def record(line, good=True, lla=(1.5, -2.5, 3.5), micro=1234, seed=0):
    header = (MAGIC if good else bytes(5)) + bytes([0, 2]) + (line & 0xFFFFFF).to_bytes(3, "big") + micro.to_bytes(3, "big") + bytes(3)
    nibble, param = line % 16, b""
    if nibble == 0:
        param = (1000 + line).to_bytes(4, "big") + bytes([1, 0, 8])
    elif nibble == 14:
        param = struct.pack(">HI3f3f", 2300, 400 + line, *lla, 0.25, 0.5, 0.75) + struct.pack(">f", -0.125)[:2]
    elif nibble == 15:
        param = struct.pack(">f", -0.125)[2:] + struct.pack(">2f", 0.5, 2.0)
    pixels = np.random.default_rng(seed + line).integers(0, 256, 5120, np.uint8).tobytes()
    return header + param.ljust(32, b"\0") + pixels + bytes(1280)


def write(path, lines, tail=b"", bad=(), **kw):
    path.write_bytes(b"".join(record(i, i not in bad, **kw) for i in range(lines)) + tail)
    return str(path)


def test_fields_of_one_group(spark, tmp_path):
    rows = scan_lines(spark, write(tmp_path / "a.dat", 16), "telemetry").orderBy("line").collect()
    assert len(rows) == 16 and all(r.source_lines == 16 for r in rows)
    s = rows[0].sample
    assert (s.channel_id, s.strip_number, s.row_number, s.camera_seconds, s.camera_microseconds) == (0, 2, 0, 1000, 1234)
    # The exposure counter reads its first byte from the sync status.
    assert (s.time_sync_status, s.exposure_time_ns) == (1, int(0x010008 * 12.5))
    assert (s.gps_week, s.gps_seconds) == (2300, 414)
    assert (s.lla, s.velocity, s.attitude) == ([1.5, -2.5, 3.5], [0.25, 0.5, 0.75], [-0.125, 0.5, 2.0])
    assert all(r.sample is None for r in rows[1:])


@pytest.mark.parametrize("lines,tail,expected", [(3, b"x" * 100, 3), (0, b"x" * 100, 0), (20, b"", 20)])
def test_partial_record_is_ignored(spark, tmp_path, lines, tail, expected):
    path = write(tmp_path / "a.dat", lines, tail)
    assert scan_lines(spark, path).count() == expected


def test_partitions_do_not_change_the_rows(spark, tmp_path):
    path = write(tmp_path / "a.dat", 100, b"tail", bad=(5, 32, 47))
    for columns in ("raw", "telemetry", "pixels"):
        whole = scan_lines(spark, path, columns)
        split = scan_lines(spark, path, columns, partitionBytes=7 * RECORD_BYTES)
        assert split.rdd.getNumPartitions() == 15
        key = lambda r: r.line
        assert sorted(whole.collect(), key=key) == sorted(split.collect(), key=key)


def test_line_bounds_prune_partitions(spark, tmp_path):
    path = write(tmp_path / "a.dat", 64)
    lines = scan_lines(spark, path, "telemetry", partitionBytes=8 * RECORD_BYTES)
    some = lines.where("line >= 16 AND line < 33")
    assert some.count() == 17
    assert some.rdd.getNumPartitions() == 3
    assert scan_lines(spark, path, startLine=10, endLine=12).count() == 2


def test_frames_compact_invalid_lines_and_pad(spark, tmp_path):
    path = write(tmp_path / "a.dat", 40, bad=(3, 20))
    frames = {r.frame_id: r for r in scan_frames(spark, path, 16, 8).collect()}
    assert sorted(frames) == [0, 1, 2, 3, 4]
    for k, row in frames.items():
        window = [i for i in range(k * 8, min(40, k * 8 + 16))]
        valid = [i for i in window if i not in (3, 20)]
        assert (row.n_lines, row.n_valid) == (len(window), len(valid))
        packed = np.stack([np.random.default_rng(i).integers(0, 256, 5120, np.uint8) for i in valid])
        image = np.frombuffer(row.pixels, np.uint8).reshape(16, 4096)
        assert (image[: len(valid)] == unpack_10_to_8(packed)).all()
        assert not image[len(valid) :].any()
        start = 1000 + {0: 0, 2: 16}.get(k, 0)
        assert (row.window_start.camera_seconds if row.window_start else None) == (start if k in (0, 2) else None)


def test_frame_runs_and_gaps(spark, tmp_path):
    path = write(tmp_path / "a.dat", 50)
    for height, stride in ((16, 8), (8, 20), (5, 3)):
        whole = scan_frames(spark, path, height, stride).collect()
        split = scan_frames(spark, path, height, stride, partitionBytes=1).collect()
        assert sorted(whole) == sorted(split)
        assert len(whole) == -(-50 // stride)


def test_window_without_valid_line_fails(spark, tmp_path):
    path = write(tmp_path / "a.dat", 32, bad=range(16, 32))
    with pytest.raises(Exception, match="no valid line"):
        scan_frames(spark, path, 16, 16).collect()
    assert scan_frames(spark, path, 16, 16, emptyWindow="keep").count() == 2
    with pytest.raises(Exception, match="no valid line"):
        navigation_records(scan_lines(spark, path, "telemetry"), 16, 16).collect()
    with pytest.raises(ValueError):
        scan_lines(spark, path, channel=1)


def test_summary_of_lines_equals_frames_of_files(spark, tmp_path):
    path = write(tmp_path / "a.dat", 200, bad=(0, 64, 65))
    for height, stride in ((64, 16), (48, 32), (40, 12), (16, 64)):
        lines = window_summary(scan_lines(spark, path, "telemetry"), height, stride, F.col("sample"))
        frames = scan_frames(spark, path, height, stride)
        flat = "frame_id, n_lines, n_valid, {}.row_number AS a, {}.row_number AS b".format
        left = lines.selectExpr(*flat("window_start.sample", "window_end.sample").split(", "))
        right = frames.selectExpr(*flat("window_start", "window_end").split(", "))
        assert sorted(left.collect(), key=str) == sorted(right.collect(), key=str)


def test_navigation_nulls_and_zeros(spark, tmp_path):
    bad_float = write(tmp_path / "a.dat", 16, lla=(float("nan"), float("inf"), 7.0))
    row = navigation_records(scan_lines(spark, bad_float, "telemetry"), 16, 16).first()
    assert row.lla == [None, None, 7.0] and row.gps_time.scale == "GPS"
    short = write(tmp_path / "b.dat", 10)
    row = navigation_records(scan_lines(spark, short, "telemetry"), 16, 16).first()
    assert row.lla == [0.0, 0.0, 0.0] and row.gps_time.week == 0


def test_float_expression_matches_ieee(spark):
    values = [0.0, 1.0, -120.5, 1e-40, 3.4e38, float("inf"), float("-inf"), float("nan"), 2.0**-126]
    rows = [(i, bytearray(struct.pack(">f", v))) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, raw binary").select("i", be_float(F.col("raw")).alias("f")).collect()
    for row in got:
        assert np.float32(row.f).tobytes() == np.float32(values[row.i]).tobytes() or np.isnan(values[row.i])


def _rows(frames):
    return sorted((r.source, r.frame_id, r.n_lines, r.n_valid, r.width, r.height, r.window_start, r.window_end, bytes(r.pixels)) for r in frames.collect())


@pytest.mark.parametrize("height,stride", [(16, 16), (40, 8), (33, 10), (16, 24), (200, 7), (1, 1)])
def test_dense_frames_of_a_table_equal_those_of_files(spark, tmp_path, height, stride):
    """Overlap, gaps, short last windows, broken lines, several sources, runs of any length, lines in no order."""
    write(tmp_path / "a.dat", 100, b"tail", bad=(5, 32, 47))
    write(tmp_path / "b.dat", 70, bad=(0, 69), seed=9)
    lines = scan_lines(spark, str(tmp_path), "pixels").orderBy(F.xxhash64("line"))
    want = _rows(scan_frames(spark, str(tmp_path), height, stride, emptyWindow="keep"))
    for run in (None, 1, 3):
        assert _rows(dense_frames(lines, height, stride, run, "keep")) == want


def test_dense_frames_of_odd_tables(spark, tmp_path):
    """Lines that are missing or repeated, windows without a valid line or without any line, an empty table, a null source."""
    path = write(tmp_path / "a.dat", 64, bad=range(16, 32))
    lines = scan_lines(spark, path, "pixels").withColumn("extra", F.lit(1)).withColumn("run", F.lit("x"))
    with pytest.raises(Exception, match="has no valid line"):
        dense_frames(lines, 16, 16).collect()
    assert _rows(dense_frames(lines.union(lines), 16, 16, None, "keep")) == _rows(dense_frames(lines, 16, 16, None, "keep"))
    thin = dense_frames(lines.where("line <> 3 AND line NOT BETWEEN 32 AND 47"), 16, 16, None, "keep").orderBy("frame_id").collect()
    assert [(r.frame_id, r.n_lines, r.n_valid) for r in thin] == [(0, 15, 15), (1, 16, 0), (3, 16, 16)]
    assert dense_frames(lines.where("false"), 16, 16).count() == 0
    assert dense_frames(lines.withColumn("source", F.lit(None).cast("string")), 32, 16, None, "keep").count() == 4
    with pytest.raises(Exception, match="same number of pixels"):
        dense_frames(lines.withColumn("pixels", F.when(F.col("line") != 8, F.col("pixels"))), 16, 16, None, "keep").collect()
    with pytest.raises(ValueError, match="must be positive"):
        dense_frames(lines, 0, 16)
