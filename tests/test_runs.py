"""Whole runs over written scan-line files."""

import hashlib
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from test_products import categories, detections
from test_scanlines import write

from framelake.functions.sql import register_functions
from framelake.operators.rules import RuleViolation
from framelake.operators.tiles import tile_grid
from framelake.plans import bundles, runs
from framelake.sources.config import read_products


def a_run(path, **changes):
    data = Path(path).read_bytes()
    settings = dict(
        run_id="r1", input_path=path, height=32, stride=16, max_frames=4, sensor_id="cam",
        size_bytes=len(data), sha256=hashlib.sha256(data).hexdigest(),
    )
    return runs.Run(**(settings | changes))


def test_navigation_run(spark, tmp_path):
    path, out = write(tmp_path / "a.dat", 64), str(tmp_path / "out")
    row = runs.run_navigation(spark, a_run(path, trace_id="t"), out).first()
    assert (row.status, row.frame_count, row.input_bytes, row.input_basename) == ("completed", 4, 64 * 6448, "a.dat")
    records = read_products(spark, f"{out}/nav", "frame_id bigint, lla array<float>")
    assert sorted(r.frame_id for r in records.collect()) == [0, 1, 2, 3]
    assert spark.read.parquet(f"{out}/runs").count() == 1
    listed = runs.product_artifacts(spark, out).collect()
    assert {r.media_type for r in listed} >= {"application/x-ndjson"} and all(len(r.sha256) == 64 for r in listed)
    with pytest.raises(Exception, match="(?i)exists"):
        runs.run_navigation(spark, a_run(path), out)


def test_refused_inputs(spark, tmp_path):
    path, out = write(tmp_path / "a.dat", 64), str(tmp_path / "out")
    with pytest.raises(RuleViolation, match="digest"):
        runs.run_navigation(spark, a_run(path, sha256="0" * 64), out)
    with pytest.raises(RuleViolation, match="size"):
        runs.run_navigation(spark, a_run(path, size_bytes=1), out)
    with pytest.raises(runs.FrameLimitExceeded):
        runs.run_navigation(spark, a_run(path, max_frames=3), out)
    with pytest.raises(runs.NoResult):
        runs.run_navigation(spark, a_run(path, frame_limit=0), out)
    assert not Path(f"{out}/nav").exists()
    statuses = sorted(r.status for r in spark.read.parquet(f"{out}/runs").collect())
    assert statuses == ["failed", "failed", "failed", "no_result"]
    assert runs.run_navigation(spark, a_run(path, max_frames=3, frame_limit=2), out).first().frame_count == 2


def test_target_run(spark, tmp_path):
    path, out = write(tmp_path / "a.dat", 48), str(tmp_path / "out")
    placed = runs.Placement("pad.v1", 0.5, 0.5, 64.0, 64.0, 2176, 2176)
    boxes = detections(spark, (70, 66, 74, 70)).selectExpr(f"'{path}' AS source", "* EXCEPT (source)")
    run = a_run(path, stride=32, height=32)
    row = runs.run_targets(spark, run, boxes, categories(spark), ["place"], out, placement=placed).first()
    assert (row.frame_count, row.observation_count, row.product) == (2, 1, "targets")
    schema = "frame_id bigint, geometry_id string, target_count int, observation_time struct<seconds: bigint>"
    meta = {r.frame_id: r for r in read_products(spark, f"{out}/image_meta", schema).collect()}
    assert {k: r.target_count for k, r in meta.items()} == {0: 1, 1: 0}
    assert meta[0].geometry_id == "pad.v1" and meta[1].observation_time.seconds == 1032


def test_limited_run_ignores_a_bad_window_behind_the_limit(spark, tmp_path):
    path, out = write(tmp_path / "a.dat", 96), str(tmp_path / "out")
    data = bytearray(Path(path).read_bytes())
    record = len(data) // 96
    for line in range(32, 64):  # no line of the second window is valid
        data[line * record : (line + 1) * record] = bytes(record)
    Path(path).write_bytes(data)
    run = a_run(path, stride=32, height=32, frame_limit=1, sha256=None)
    assert runs.run_navigation(spark, run, out).first().frame_count == 1
    with pytest.raises(Exception, match="no valid line"):
        runs.run_navigation(spark, a_run(path, stride=32, height=32, sha256=None), f"{out}2")


def test_tile_grid_table_function(spark):
    register_functions(spark)
    frames = spark.range(1).selectExpr("4096L AS width", "700L AS height")
    frames.createOrReplaceTempView("frames_of_grid")
    got = spark.sql("SELECT g.* FROM frames_of_grid f, LATERAL tile_grid(f.width, f.height, 640) g").collect()
    want = tile_grid(frames, 640).select("tile_index", "x_offset", "y_offset").collect()
    assert sorted(got) == sorted(want) and len(got) == 16


def test_paths(spark, tmp_path):
    from framelake.sources import images, paths

    assert paths.qualified(spark, "/a/b") == "/a/b" and paths.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    assert paths.scheme_of("file:/a") == "file" and paths.scheme_of("/a:/b") == ""
    assert paths.resolve("file:///a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="scheme"):
        paths.qualified(spark, "ftp://host/x")
    (tmp_path / "big.bin").write_bytes(b"x" * 2000)
    (tmp_path / "a.PGM").write_bytes(b"P5 2 1 255\n\x01\x02")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = images.scan_images(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.extension, r.width, bytes(r.pixels)) for r in found] == [(".pgm", 2, b"\x01\x02")]


def test_tree_digest_grows_with_its_members(spark):
    from framelake.operators.artifacts import tree_digest

    members = spark.range(40).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS d")
    assert tree_digest(members, "id", "d", fanout=2).count() == 1


def test_bundle_run(spark, tmp_path):
    path, out = write(tmp_path / "a.dat", 64), str(tmp_path / "out")
    row = runs.run_bundle(spark, a_run(path, trace_id="t"), out).first()
    assert (row.status, row.product, row.frame_count) == ("completed", "bundle", 4)
    manifest = bundles.read_manifest(spark, f"{out}/bundle")
    assert (manifest["request_id"], manifest["trace_id"], manifest["sensor_id"], manifest["frame_count"]) == ("r1", "t", "cam", 4)
    assert manifest["input_artifact"] == {"basename": "a.dat", "size_bytes": 64 * 6448, "sha256": a_run(path).sha256}
    assert manifest["first_frame_metadata"]["video"] == {"format": "GRAY8", "height": 32, "width": 4096}
    again = runs.run_bundle(spark, a_run(path, run_id="r2"), str(tmp_path / "out2")).first()
    assert again.status == "completed" and bundles.read_manifest(spark, str(tmp_path / "out2/bundle"))["sha256"] == manifest["sha256"]
    with pytest.raises(runs.FrameLimitExceeded):
        runs.run_bundle(spark, a_run(path, run_id="r3", max_frames=3), str(tmp_path / "out3"))
    assert not Path(tmp_path / "out3/bundle").exists()


def test_image_run(spark, tmp_path):
    folder, out = tmp_path / "images", str(tmp_path / "out")
    folder.mkdir()
    for name, value in (("b.pgm", 2), ("a.PGM", 1), ("c.pgm", 3)):
        (folder / name).write_bytes(b"P5 2 1 255\n" + bytes([value, value]))
    (folder / "note.txt").write_text("no image")
    run = a_run(str(folder / "a.PGM"), input_path=str(folder), size_bytes=None, sha256=None)
    row = runs.run_images(spark, run, out).first()
    assert (row.status, row.frame_count, row.input_bytes) == ("completed", 3, 39)
    members = bundles.bundle_members(spark, f"{out}/bundle").orderBy("frame_id").collect()
    assert [(Path(f"{out}/bundle") / m.name).read_bytes() for m in members] == [b"\1\1", b"\2\2", b"\3\3"]
    (folder / "d.pgm").write_bytes(b"broken")
    with pytest.raises(Exception, match="graymap|index|invalid"):
        runs.run_images(spark, runs.Run(**{**vars(run), "run_id": "r2"}), str(tmp_path / "out2"))
    assert not Path(tmp_path / "out2/bundle").exists()
    with pytest.raises(runs.FrameLimitExceeded):
        runs.run_images(spark, runs.Run(**{**vars(run), "run_id": "r3", "max_frames": 2}), str(tmp_path / "out3"))
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(runs.NoResult):
        runs.run_images(spark, runs.Run(**{**vars(run), "run_id": "r4", "input_path": str(empty)}), str(tmp_path / "out4"))


def test_two_writers_of_one_run(spark, tmp_path):
    """Both pass the early check; the claim lets one publish."""
    out, run = str(tmp_path), a_run(write(tmp_path / "a.dat", 16))

    def attempt(_):
        try:
            runs._publish(spark, run, f"{out}/runs_of_two", "nav", 1, 0, 1, 0.0)
        except runs.PublishedAlready:
            return 0
        return 1

    with ThreadPoolExecutor(2) as pool:
        assert sum(pool.map(attempt, range(2))) == 1
    assert spark.read.parquet(f"{out}/runs_of_two/runs").count() == 1


def test_role_and_plane_of_a_run(spark, tmp_path):
    path, out = write(tmp_path / "a.dat", 48), str(tmp_path / "out")
    boxes = detections(spark, (70, 66, 74, 70)).selectExpr(f"'{path}' AS source", "* EXCEPT (source)")
    placed = runs.Placement("pad.v1", 0.5, 0.5, 64.0, 64.0, 2176, 2176)
    run = a_run(path, stride=32, height=32)
    with pytest.raises(RuleViolation, match="does not match the role"):
        runs.run_targets(spark, a_run(path, stride=32, acquisition_mode="stare"), boxes, categories(spark), ["place"], out, placement=placed)
    with pytest.raises(RuleViolation, match="does not match the role"):
        runs.run_targets(spark, run, boxes, categories(spark), ["place"], out, "tracking", placed)
    other = boxes.selectExpr("*", "2176 AS plane_width", "IF(frame_id = 0, 2176, 2175) AS plane_height")
    same = boxes.selectExpr("*", "2176 AS plane_width", "2176 AS plane_height")
    if other.where("plane_height <> 2176").count():
        with pytest.raises(RuleViolation, match="filter plane differs"):
            runs.run_targets(spark, run, other, categories(spark), ["place"], out, placement=placed)
    wrong = boxes.selectExpr("*", "100 AS plane_width", "2176 AS plane_height")
    with pytest.raises(RuleViolation, match="filter plane differs"):
        runs.run_targets(spark, run, wrong, categories(spark), ["place"], out, placement=placed)
    assert not Path(f"{out}/targets").exists()
    assert runs.run_targets(spark, run, same, categories(spark), ["place"], out, placement=placed).first().status == "completed"
