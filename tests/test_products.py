"""Golden product records, rule modes, requests, images and artifacts."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.imaging import bilinear, nearest, scaled
from framelake.operators import artifacts, requests, rules
from framelake.operators.rules import Rule
from framelake.plans import products
from framelake.sources import config
from framelake.sources.images import scan_images

FRAME = (
    "source string, frame_id bigint, valid boolean, camera_seconds bigint, camera_microseconds bigint, exposure_time_ns bigint, "
    "geometry_id string, scale_x double, scale_y double, offset_x double, offset_y double, original_width int, "
    "original_height int, filter_width int, filter_height int, sensor_id string, acquisition_mode string"
)
TARGET = "source string, frame_id bigint, x_min double, y_min double, x_max double, y_max double, class_index bigint"
CLASSES = '{"id": "m1", "classes": [{"index": 0, "type": "vehicle"}, {"index": 1, "type": "old"}, {"index": 1, "type": "ship"}]}'


def frames(spark, n=1, scale=1.0, offset=0.0, size=4096, valid=True, micro=5):
    rows = [
        ("s", i, valid, 10, micro, 12, "g.v1", scale, scale, offset, offset, 4096, 4096, size, size, "cam", "pushbroom")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, FRAME)


def categories(spark):
    return config.categories_of(spark.createDataFrame([(CLASSES,)], "document string"))


def detections(spark, *boxes, klass=1, frame=0):
    rows = [("s", frame, *map(float, b), klass, 0.9, i) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, f"{TARGET}, confidence double, place int")


@pytest.mark.parametrize(
    "scale,offset,size,box", [(1.0, 0.0, 4096, (100, 40, 140, 80)), (0.5, 64.0, 2176, (114, 84, 134, 104))]
)
def test_detection_record(spark, scale, offset, size, box):
    records, meta, _ = products.target_records(
        frames(spark, 1, scale, offset, size), detections(spark, box), categories(spark), ["place"]
    )
    record = json.loads(records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    item = record["targets"][0]
    assert item["bbox"] == {"x_min": 100.0, "y_min": 40.0, "x_max": 140.0, "y_max": 80.0}
    assert item["class"] == {"index": 1, "mapping_id": "m1", "type": "ship"}
    assert item["geolocation_sample"] == {"line": 60.0, "pixel": 120.0}
    assert (item["confidence"], item["target_id"], item["source_id"]) == (0.9, "d0", "detection:0:0")
    assert record["observation_time"] == {"scale": "camera", "seconds": 10, "microseconds": 5}
    assert record["exposure_duration"] == {"unit": "ns", "value": 12}
    assert list(item) == sorted(item)
    assert meta.first().target_count == 1 and meta.first().filter_width == size


def test_track_records(spark):
    rows = [("s", k, 20.0, 30.0, 60.0, 90.0, 0, 7, 0) for k in range(3)]
    tracks = spark.createDataFrame(rows, f"{TARGET}, track_id bigint, place int")
    records, meta, _ = products.target_records(frames(spark, 3), tracks, categories(spark), ["place"], role="tracking")
    got = sorted(records.collect(), key=lambda r: r.frame_id)
    assert [r.frame_id for r in got] == [0, 1, 2]
    for r in got:
        item = r.tracks[0]
        assert (item.image_sample.row, item.image_sample.column, item.track_id) == (60.0, 40.0, 7)
        assert item["class"]["type"] == "vehicle" and "confidence" not in item.asDict()
    assert [r.tracked_target_count for r in meta.collect()] == [1, 1, 1]
    twice = (frames(spark, 3), tracks.union(tracks), categories(spark), ["place"])
    with pytest.raises(Exception, match="duplicate track_id"):
        products.target_records(*twice, role="tracking")[0].collect()
    kept, _, rejects = products.target_records(*twice, role="tracking", mode="quarantine")
    assert [len(r.tracks) for r in kept.collect()] == [1, 1, 1]
    assert [r.failed_rule for r in rejects.collect()] == ["track"] * 3


def test_frame_without_targets_keeps_an_empty_array(spark):
    none = detections(spark, (1, 1, 2, 2)).where("false")
    records, meta, _ = products.target_records(frames(spark), none, categories(spark), ["place"])
    assert records.first().targets == [] and meta.first().target_count == 0


@pytest.mark.parametrize(
    "box,klass,reason",
    [
        ((140, 40, 100, 80), 1, "box"),
        ((-1, 0, 5, 5), 1, "filter plane"),
        ((0, 0, 5000, 5), 1, "filter plane"),
        ((0, 0, 5, 5), 9, "unknown class"),
    ],
)
def test_strict_and_quarantine(spark, box, klass, reason):
    targets = detections(spark, box, klass=klass).union(detections(spark, (1, 1, 2, 2)))
    args = (frames(spark), targets, categories(spark), ["place", "x_min"])
    with pytest.raises(Exception, match=reason):
        products.target_records(*args)[0].collect()
    records, _, rejects = products.target_records(*args, mode="quarantine")
    assert len(records.first().targets) == 1 and rejects.count() == 1


def test_clock_and_crowded_frames_fail(spark):
    with pytest.raises(Exception, match="clock"):
        products.target_records(frames(spark, micro=1_000_000), detections(spark, (1, 1, 2, 2)), categories(spark), ["place"])[0].collect()
    crowd = detections(spark, *[(i, 1, i + 2, 2) for i in range(257)])
    with pytest.raises(Exception, match="too many"):
        products.target_records(frames(spark), crowd, categories(spark), ["place"])[0].collect()
    full = crowd.where("place < 256")
    assert products.target_records(frames(spark), full, categories(spark), ["place"])[1].first().target_count == 256


def test_strict_check_survives_pruning(spark):
    checked = rules.strict(spark.range(3), [Rule("r", F.col("id") < 2, "too big")], "id")
    with pytest.raises(Exception, match="too big"):
        checked.selectExpr("id * 2 AS x").collect()


def test_category_map_errors(spark):
    for text in ('{"classes": []}', '{"id": "a"}', '{"id": "a", "classes": [{"index": 1}]}'):
        with pytest.raises(Exception, match="category map"):
            config.categories_of(spark.createDataFrame([(text,)], "document string")).collect()


def test_sequence_and_reconciliation(spark):
    products.check_sequence(frames(spark, 4))
    with pytest.raises(rules.RuleViolation):
        products.check_sequence(frames(spark, 4).where("frame_id <> 2"))
    products.require_reconciled(frames(spark, 2), frames(spark, 2), 2)
    with pytest.raises(rules.RuleViolation):
        products.require_reconciled(frames(spark, 2), frames(spark, 1), 2)


def test_output_is_written_once(spark, tmp_path):
    path = str(tmp_path / "targets")
    records, _, _ = products.target_records(frames(spark, 2), detections(spark, (1, 1, 2, 2)), categories(spark), ["place"])
    products.write_records(records, path)
    back = config.read_products(spark, path, records.schema)
    assert sorted(back.collect()) == sorted(records.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        products.write_records(records, path)


REQUEST = {
    "schema_version": "1.0",
    "request_id": "r",
    "acquisition_mode": "pushbroom",
    "sensor": {"id": "s"},
    "input": {"artifact_ref": "a", "path": "/p", "media_type": "m"},
    "processing": {"runtime_profile": "p"},
}


def test_requests_and_missing_registry(spark):
    registry = {"profiles": {"p": {"sensor_id": "s", "acquisition_mode": "pushbroom", "max_frames": 4, "filter": {"role": "detection"}}}}
    profiles = config.profiles_of(spark.createDataFrame([(json.dumps(registry),)], "document string"))
    cases = {
        "good": (REQUEST, None),
        "null trace": (REQUEST | {"trace_id": None}, "R5"),
        "null path": (REQUEST | {"input": REQUEST["input"] | {"path": None}}, "R32"),
        "float frames": (REQUEST | {"processing": {"runtime_profile": "p", "max_frames": 1.0}}, "R34"),
        "null size": (REQUEST | {"input": REQUEST["input"] | {"size_bytes": None}}, "R15"),
        "text sensor": (REQUEST | {"sensor": "s"}, "R7"),
        "text": ("x", "R1"),
    }
    rows = [(name, json.dumps(document)) for name, (document, _) in cases.items()]
    rows += [("broken", '{"schema_version": '), ("twice", json.dumps(REQUEST)[:-1] + ', "request_id": ""}')]
    cases |= {"broken": (None, "R1"), "twice": (None, "R4")}
    df = spark.createDataFrame(rows, "name string, document string")
    got = {r.name: r.rule for r in requests.validate_requests(df, profiles).collect()}
    assert got == {name: rule for name, (_, rule) in cases.items()}
    without = {r.name: r.rule for r in requests.validate_requests(df, None).collect()}
    assert without["good"] == "R20" and without["text"] == "R1"


def test_ground_products_of_one_mode(spark):
    """Modes that only share the prefix are not ground products once the policy names the mode."""
    registry = {
        f"p{i}": {"sensor_id": "s", "acquisition_mode": "pushbroom", "max_frames": 4, "output_mode": mode, "filter": {"role": "detection"}}
        for i, mode in enumerate(("ground_a", "ground_b"))
    }
    profiles = config.profiles_of(spark.createDataFrame([(json.dumps({"profiles": registry}),)], "document string"))
    rows = [(p, json.dumps(REQUEST | {"processing": {"runtime_profile": p}})) for p in registry]
    df = spark.createDataFrame(rows, "name string, document string")
    policy = requests.Policy.of('{"ground_mode": "ground_a", "backends": ["x"]}')
    assert policy.backends == ("x",)
    assert {r.name: r.rule for r in requests.validate_requests(df, profiles, policy).collect()} == {"p0": "R28", "p1": None}
    with pytest.raises(ValueError, match="unknown"):
        requests.Policy.of('{"ground": "x"}')


def test_images(spark, tmp_path):
    values = " ".join(str(v) for v in range(16))
    (tmp_path / "b.PGM").write_text(f"P2\n# note\n4 4\n255\n{values}\n")
    (tmp_path / "a.pgm").write_bytes(b"P5 2 1 255\n" + bytes([9, 8]))
    (tmp_path / "skip.txt").write_text("x")
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "c.pgm").write_bytes(b"P5 1 1 255\n" + bytes([7]))
    flat = {r.relative_path: r for r in scan_images(spark, str(tmp_path), allowed="jpg, .PGM").collect()}
    assert sorted(flat) == ["a.pgm", "b.PGM"]
    row = flat["b.PGM"]
    assert (row.width, row.height, row.format, row.extension) == (4, 4, "GRAY8", ".pgm")
    assert list(row.pixels) == list(range(16)) and row.absolute_path == str(tmp_path / "b.PGM")
    everything = scan_images(spark, str(tmp_path), recursive=True)
    assert {r.relative_path for r in everything.collect()} == {"a.pgm", "b.PGM", "deep/c.pgm"}


def test_numpy_kernels():
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (nearest(image, (1.0, 1.0), (0.0, 0.0), 8, 8) == image).all()
    assert (nearest(image, (2.0, 2.0), (0.0, 0.0), 16, 16) == image.repeat(2, 0).repeat(2, 1)).all()
    assert not nearest(image, (1.0, 1.0), (8.0, 0.0), 8, 8).any()
    assert (bilinear(image, 8, 8) == image).all()
    assert scaled(image, 4, 4)[0, 0] == (0 + 1 + 8 + 9 + 2) // 4


def test_file_digests_and_listing(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}").write_bytes(bytes([i]) * (1000 + i))
    listed = artifacts.list_artifacts(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: (r.size_bytes, r.sha256) for r in artifacts.file_digests(listed).collect()}
    assert got == {f"f{i}": (1000 + i, hashlib.sha256(bytes([i]) * (1000 + i)).hexdigest()) for i in range(5)}


def test_tree_digest_depends_on_order_only(spark):
    members = spark.range(3000).selectExpr("id AS frame_id", "sha2(string(id), 256) AS sha256")
    digest = lambda df, **k: artifacts.tree_digest(df, "frame_id", "sha256", **k).first()[0]
    assert digest(members) == digest(members.repartition(9))
    assert digest(members) != digest(members.withColumn("frame_id", 2999 - F.col("frame_id")))
    assert digest(members, fanout=16) == digest(members.repartition(3), fanout=16)


def test_duplicate_paths_are_reported(spark):
    side = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x")], "path string, size_bytes bigint, sha256 string")
    got = {r.path: r.status for r in artifacts.reconcile(side.dropDuplicates(), side).collect()}
    assert got == {"a": "duplicate", "b": "ok"}


def test_observed_metrics(spark, tmp_path):
    frames_df = spark.range(10).selectExpr("id", "id * 2 AS size_bytes")
    watched, seen = artifacts.observed(frames_df, F.col("size_bytes"), "run")
    watched.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"frame_count": 10, "bytes": 90}


def test_products_of_queries_are_written_compressed(spark):
    """The repeated field names of JSON are most of what a written product has."""
    from pathlib import Path

    from framelake.recipes.tables import Tables
    from framelake.recipes.vision import _written

    records = spark.range(2000).selectExpr("id AS frame_id", "named_struct('scale', 'camera', 'seconds', id) AS observation_time")
    back = _written(Tables(spark, ""), records)
    files = [Path(f.removeprefix("file://")) for f in back.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 40 * 2000 and sorted(back.collect()) == sorted(records.collect())
