"""Frame bundles and chips: files with a manifest, all or nothing; pixels that stay where they are."""

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scanlines import write

from framelake.functions.boxes import Box, crop_window
from framelake.functions.binary import RECORD_BYTES
from framelake.operators import chips
from framelake.operators.rules import RuleViolation
from framelake.plans import bundles
from framelake.plans.products import crop_records, named_chips
from framelake.sources.scanlines import _FrameReader, scan_chips, scan_frames


def frames(spark, n=5, seed=0):
    rows = [(s, i, 4, 3, bytes((s.encode()[-1] + i * 7 + k * seed) % 256 for k in range(12))) for s in ("/a/x.dat", "/b/x.dat") for i in range(n)]
    return spark.createDataFrame(rows, "source string, frame_id bigint, width int, height int, pixels binary")


def visible(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def test_bundle_of_two_sources(spark, tmp_path):
    path = str(tmp_path / "b")
    kinds = {"geometry": F.lit(True), "detection": F.col("frame_id") == 2}
    members = bundles.members_of(frames(spark), kinds, F.col("frame_id") * 10, F.lit(5).cast("bigint"))
    manifest = bundles.write_bundle(members.repartition(3), path, {"request_id": "r"})
    assert bundles.read_manifest(spark, path) == manifest
    assert (manifest["request_id"], manifest["source_count"], manifest["frame_count"], manifest["size_bytes"]) == ("r", 2, 10, 120)
    assert (manifest["first_frame_metadata"]["index"], manifest["last_frame_metadata"]["index"]) == (0, 4)
    rows = {(r.source, r.frame_id): r for r in bundles.bundle_members(spark, path).collect()}
    assert len(rows) == 10
    for (source, frame), r in rows.items():
        assert (tmp_path / "b" / r.name).read_bytes() == bytes(frames(spark).where((F.col("source") == source) & (F.col("frame_id") == frame)).first().pixels)
        described = json.loads((tmp_path / "b" / r.name.replace(".bin", ".json")).read_text())
        assert described == r.metadata.asDict(True) and described["pts_ns"] == frame * 10 and described["video"] == {"format": "GRAY8", "height": 3, "width": 4}
        assert described["meta_kinds"] == ["geometry"] + ["detection"] * (frame == 2)
    assert bundles.verify_bundle(spark, path).count() == 0
    (tmp_path / "b" / rows[("/a/x.dat", 1)].name).write_bytes(b"changed")
    (tmp_path / "b" / rows[("/b/x.dat", 0)].name).unlink()
    assert sorted(r.status for r in bundles.verify_bundle(spark, path).collect()) == ["changed", "missing"]


def test_equal_frames_give_an_equal_digest(spark, tmp_path):
    written = [bundles.write_bundle(bundles.members_of(f.repartition(p)), str(tmp_path / f"b{p}")) for p, f in ((1, frames(spark)), (4, frames(spark).orderBy(F.desc("frame_id"))))]
    assert written[0] == written[1]
    other = bundles.write_bundle(bundles.members_of(frames(spark, seed=1)), str(tmp_path / "c"))
    assert other["sha256"] != written[0]["sha256"] and other["frame_count"] == written[0]["frame_count"]


@pytest.mark.parametrize("spoil", ["task", "twice", "gap", "none"])
def test_a_bundle_that_fails_leaves_nothing(spark, tmp_path, spoil):
    path, good = str(tmp_path / "b"), frames(spark)
    bad = {
        "task": good.withColumn("pixels", F.when(F.col("frame_id") < 4, F.col("pixels")).otherwise(F.raise_error(F.lit("broken frame")).cast("binary"))),
        "twice": good.unionByName(good.where("frame_id = 1")),
        "gap": good.where("frame_id <> 2"),
        "none": good.where("false"),
    }[spoil]
    with pytest.raises(Exception, match="broken frame|twice|contiguous|at least one"):
        bundles.write_bundle(bundles.members_of(bad.repartition(4)), path)
    assert not Path(path).exists() or visible(path) == []
    with pytest.raises(bundles.NoBundle):
        bundles.bundle_members(spark, path)
    assert bundles.write_bundle(bundles.members_of(good), path)["frame_count"] == 10  # the path is free again


def test_two_writers_of_one_bundle(spark, tmp_path):
    def attempt(_):
        try:
            bundles.write_bundle(bundles.members_of(frames(spark)), str(tmp_path / "b"))
        except FileExistsError:
            return 0
        return 1

    with ThreadPoolExecutor(3) as pool:
        assert sum(pool.map(attempt, range(3))) == 1
    assert bundles.verify_bundle(spark, str(tmp_path / "b")).count() == 0


# ---- chips ------------------------------------------------------------------------------------------


def test_window_is_that_of_the_expression(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(float, e)) for e in np.round(rng.uniform(-6, 14, (300, 4)) * 4) / 4] + [(1.0, 1.0, float("inf"), 2.0), (float("-inf"), 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "i int, x_min double, y_min double, x_max double, y_max double")
    finite = df.where("abs(x_min) < 1e9 AND abs(x_max) < 1e9")
    rect = crop_window(Box.of(), F.lit(8), F.lit(5))
    for r in finite.select("i", *[c.alias(n) for c, n in zip(rect, ("x0", "y0", "x1", "y1"))]).collect():
        want = (r.x0, r.y0, r.x1, r.y1) if r.x1 > r.x0 and r.y1 > r.y0 else None
        assert chips.window(edges[r.i], 8, 5) == want
    assert chips.window(edges[300], 8, 5) == (1, 1, 8, 2) and chips.window(edges[301], 8, 5) == (0, 0, 1, 1)
    assert chips.window((0.0, None, 1.0, 1.0), 8, 5) is None and chips.window((float("nan"), 0.0, 1.0, 1.0), 8, 5) is None


def boxes_of(spark, path, ids, per_frame=3):
    rows = [(path, f, t, f"c/{t % 2}", 10.0 * t + 0.5, 2.0 * f, 10.0 * t + 4.25, 2.0 * f + 3) for f in ids for t in range(per_frame)]
    rows += [(None, 0, 0, "c", 0.0, 0.0, 1.0, 1.0), (path, None, 0, "c", 0.0, 0.0, 1.0, 1.0), (path, 99, 0, "c", 0.0, 0.0, 1.0, 1.0), ("other", 0, 0, "c", 0.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "source string, frame_id bigint, target_index bigint, type string, x_min double, y_min double, x_max double, y_max double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chips_do_not_move_pixels(spark, tmp_path, monkeypatch):
    """Cut from a table and from raw files, with tiny row groups, equal to cutting by hand; no exchange in either plan."""
    monkeypatch.setattr(chips, "ROW_GROUP_BYTES", 1)
    monkeypatch.setattr(chips, "CHIP_ROWS", 5)
    path = write(tmp_path / "a.dat", 96)
    detections = boxes_of(spark, path, [0, 2, 3])
    dense = scan_frames(spark, path, 32, 16)
    cut = crop_records(dense, detections)
    raw = named_chips(scan_chips(spark, path, detections, 32, 16, partitionBytes=40 * RECORD_BYTES))
    for df in (cut, raw):
        assert "Exchange" not in plan_of(df) and "Join" not in plan_of(df)
    image = {r.frame_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in dense.collect()}
    want = set()
    for f in (0, 2, 3):
        for t in range(3):
            part = image[f][2 * f : 2 * f + 3, 10 * t : 10 * t + 5]
            want.add((path, f, f"c_{t % 2}", f"f{f:06d}_d{t}", 5, 3, part.tobytes()))
    for df in (cut, raw):
        rows = df.collect()
        assert len(rows) == 9 and {(r.source, r.frame_id, r.class_dir, r.name, r.width, r.height, bytes(r.pixels)) for r in rows} == want


def test_a_crowded_frame_spreads_over_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = chips.sorted_boxes(boxes_of(spark, "s", [1], 4000), ["source", "frame_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(table.files) > 2
    spark.createDataFrame([("s", 1, 8, 8, bytes(64)), ("s", None, 8, 8, bytes(64)), ("t", 1, 8, 8, None)], "source string, frame_id bigint, width int, height int, pixels binary").write.parquet(str(tmp_path / "f"))
    held = spark.read.parquet(str(tmp_path / "f"))
    assert chips.cut_chips(held, table).count() == 1  # one of the boxes lies in the frame
    none = chips.sorted_boxes(boxes_of(spark, "s", []).where("false"), ["source", "frame_id"])
    assert chips.cut_chips(held, none).count() == 0


# ---- ring of decoded lines ----------------------------------------------------------------------------


@pytest.mark.parametrize("height,stride", [(32, 16), (16, 48), (700, 300), (48, 48)])
@pytest.mark.parametrize("scale", [{}, {"scaleWidth": "512", "scaleHeight": "4"}])
def test_frames_are_those_of_a_plain_reader(tmp_path, height, stride, scale):
    """Windows that overlap, touch and leave gaps, in several runs, with bad lines and the last window cut."""
    from framelake.functions.imaging import scaled, unpack_10_to_8

    total = 1100
    path = write(tmp_path / "a.dat", total, b"tail", bad=range(3, total, 7))
    block = np.frombuffer(Path(path).read_bytes()[: total * RECORD_BYTES], np.uint8).reshape(total, RECORD_BYTES)
    lines, good = unpack_10_to_8(block[:, 48:5168]), np.arange(total) % 7 != 3
    reader = _FrameReader({"path": path, "height": height, "stride": stride, "partitionBytes": 5 * stride * RECORD_BYTES, **scale})
    seen = {}
    for part in reader.partitions():
        for batch in reader.read(part):
            seen[batch["frame_id"][0].as_py()] = batch["pixels"][0].as_py()
    assert sorted(seen) == list(range(-(-total // stride)))
    for frame, pixels in seen.items():
        rows = slice(frame * stride, frame * stride + height)
        image = np.zeros((height, 4096), np.uint8)
        kept = lines[rows][good[rows]]
        image[: len(kept)] = kept
        assert pixels == (scaled(image, 512, 4) if scale else image).tobytes()


def test_gaps_are_not_read(tmp_path, monkeypatch):
    from framelake.sources import scanlines

    path = write(tmp_path / "a.dat", 200)
    read = []

    class Counting:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def seek(self, at):
            self.stream.seek(at)

        def read(self, size):
            read.append(size)
            return self.stream.read(size)

    class Files:
        def open_input_file(self, name):
            return Counting(open(name, "rb"))

    monkeypatch.setattr(scanlines, "resolve", lambda p: (Files(), p))
    reader = scanlines._FrameReader({"path": path, "height": 16, "stride": 64, "emptyWindow": "keep"})
    assert len(list(reader.read(scanlines.ByteRange(path, 200, 0, 4)))) == 4
    assert sum(read) == (3 * 16 + 8) * RECORD_BYTES  # the last window has 8 lines


def test_a_run_id_is_claimed_once(spark, tmp_path):
    from framelake.streaming.streams import claim_run

    claim_run(spark, str(tmp_path / "runs"), "r/1")
    claim_run(spark, str(tmp_path / "runs"), "r 1")
    with pytest.raises(RuleViolation):
        claim_run(spark, str(tmp_path / "runs"), "r/1")
