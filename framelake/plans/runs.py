"""Whole runs: verify the input, make a product, reconcile it, then publish the run row.

Products go to folders that must not exist yet. The run row is written last; readers take
only products whose run row says ``completed``, which makes several tables one publication.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.binary import PIXELS_PER_LINE, RECORD_BYTES
from framelake.functions.boxes import Geometry
from framelake.functions.names import file_name
from framelake.operators.artifacts import file_digests, frames_per_second, list_artifacts, observed
from framelake.operators.lookup import small_or_shuffled
from framelake.operators.rules import Rule, RuleViolation, fail_if_any, geometry_rules, plane_match_rule, quarantine
from framelake.operators.windows import global_index, window_summary
from framelake.plans.products import check_sequence, navigation_records, target_records, write_records
from framelake.session import scratch_path
from framelake.plans.bundles import members_of, write_bundle
from framelake.sources.config import read_products
from framelake.sources.images import DEFAULT_EXTENSIONS, Decoder, decode_pgm, list_images, scan_images
from framelake.sources.paths import claim, qualified
from framelake.sources.scanlines import scan_frames, scan_lines

RUN_TYPE = (
    "run_id string, trace_id string, runtime_profile string, product string, status string, frame_count bigint, "
    "observation_count bigint, input_bytes bigint, wall_time_seconds double, frames_per_second double, "
    "input_basename string, source_convention string"
)


class FrameLimitExceeded(RuleViolation):
    """More frames than the profile allows: the run fails, it is not cut short."""


class NoResult(RuleViolation):
    """The input holds no frame; no product is written."""


class PublishedAlready(RuleViolation):
    """The run id has a completed run."""


@dataclass(frozen=True)
class Run:
    run_id: str
    input_path: str
    height: int
    stride: int
    max_frames: int
    runtime_profile: str = ""
    sensor_id: str = ""
    acquisition_mode: str = "pushbroom"
    trace_id: str | None = None
    size_bytes: int | None = None
    sha256: str | None = None
    frame_limit: int | None = None


@dataclass(frozen=True)
class Placement:
    """Geometry of a product: filter = scale * original + offset, on a plane of a given size."""

    geometry_id: str = "identity.v1"
    scale_x: float = 1.0
    scale_y: float = 1.0
    offset_x: float = 0.0
    offset_y: float = 0.0
    filter_width: int | None = None
    filter_height: int | None = None


def verify_input(spark: SparkSession, run: Run) -> int:
    """Total input bytes, after comparing size and digest where the request states them."""
    files = list_artifacts(spark, run.input_path)
    total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if run.size_bytes is not None and run.size_bytes != total:
        raise RuleViolation("input artifact size does not match request")
    if run.sha256 is not None:
        wrong = file_digests(files).where(F.col("sha256") != run.sha256)
        fail_if_any(wrong.select("path"), "input artifact digest does not match request")
    return total


def count_frames(spark: SparkSession, run: Run) -> int:
    """Frames of all input files from their sizes alone."""
    lines = F.floor(F.col("size_bytes") / RECORD_BYTES)
    frames = F.ceil(lines / run.stride)
    if run.frame_limit is not None:
        frames = F.least(frames, F.lit(run.frame_limit))
    return int(list_artifacts(spark, run.input_path).agg(F.coalesce(F.sum(frames), F.lit(0))).first()[0])


def _planned_frames(spark: SparkSession, run: Run) -> int:
    frames = count_frames(spark, run)
    if frames > run.max_frames:
        raise FrameLimitExceeded(f"input holds {frames} frames, the limit is {run.max_frames}")
    if frames == 0:
        raise NoResult("input holds no frame")
    return frames


def _telemetry(spark: SparkSession, run: Run) -> DataFrame:
    """Scan lines of the run; a limited run stops reading behind its last window."""
    if run.frame_limit is None:
        return scan_lines(spark, run.input_path, "telemetry")
    end = (run.frame_limit - 1) * run.stride + run.height
    return scan_lines(spark, run.input_path, "telemetry", endLine=max(end, 0))


def frame_table(spark: SparkSession, run: Run, placement: Placement = Placement()) -> DataFrame:
    """One row per frame with geometry, camera clock and exposure, from telemetry only."""
    summary = window_summary(_telemetry(spark, run), run.height, run.stride, F.col("sample"))
    if run.frame_limit is not None:
        summary = summary.where(F.col("frame_id") < run.frame_limit)
    start = F.col("window_start.sample")
    plane = {
        "geometry_id": F.lit(placement.geometry_id),
        "scale_x": F.lit(placement.scale_x),
        "scale_y": F.lit(placement.scale_y),
        "offset_x": F.lit(placement.offset_x),
        "offset_y": F.lit(placement.offset_y),
        "original_width": F.lit(PIXELS_PER_LINE),
        "original_height": F.lit(run.height),
        "filter_width": F.lit(placement.filter_width or PIXELS_PER_LINE),
        "filter_height": F.lit(placement.filter_height or run.height),
    }
    return summary.select(
        "source",
        "frame_id",
        "n_valid",
        F.coalesce(start["valid"], F.lit(False)).alias("valid"),
        *[start[name].alias(name) for name in ("camera_seconds", "camera_microseconds", "exposure_time_ns")],
        *[column.alias(name) for name, column in plane.items()],
        F.lit(run.sensor_id).alias("sensor_id"),
        F.lit(run.acquisition_mode).alias("acquisition_mode"),
    )


@contextmanager
def _recorded(spark: SparkSession, run: Run, out: str, product: str) -> Iterator[None]:
    """Refuse a run id that is published already; leave a row for a run that fails or has no result."""
    begun = time.monotonic()
    try:
        earlier = spark.read.schema(RUN_TYPE).parquet(f"{out}/runs").where(F.col("status") == "completed")
        known = not earlier.where(F.col("run_id") == run.run_id).isEmpty()
    except AnalysisException:  # no run has been recorded yet
        known = False
    if known:
        raise PublishedAlready(f"run {run.run_id} is published already and exists below {out}")
    try:
        yield
    except NoResult:
        _publish(spark, run, out, product, 0, 0, 0, begun, "no_result")
        raise
    except PublishedAlready:  # another writer of the same run was first; its row stands
        raise
    except RuleViolation:
        _publish(spark, run, out, product, 0, 0, 0, begun, "failed")
        raise


def _publish(spark, run: Run, out: str, product: str, frames: int, observations: int, size: int, begun: float, status: str = "completed") -> DataFrame:
    """Append the run row. A completed run claims its id first, so of two writers at once only one publishes."""
    if status == "completed" and not claim(spark, f"{qualified(spark, out)}/_claims/{quote(run.run_id, safe='')}"):
        raise PublishedAlready(f"run {run.run_id} is published already and exists below {out}")
    wall = time.monotonic() - begun
    row = (run.run_id, run.trace_id, run.runtime_profile, product, status, frames, observations, size, wall, 0.0, run.input_path, "line-scan")
    runs = spark.createDataFrame([row], RUN_TYPE).withColumns(
        {
            "frames_per_second": frames_per_second(F.col("frame_count"), F.col("wall_time_seconds")),
            "input_basename": file_name(F.col("input_basename")),
        }
    )
    runs.write.mode("append").parquet(f"{out}/runs")
    return runs


def run_navigation(spark: SparkSession, run: Run, out: str) -> DataFrame:
    """Navigation product below ``out``; returns its run row."""
    with _recorded(spark, run, out, "nav"):
        return _navigation(spark, run, out)


def _navigation(spark: SparkSession, run: Run, out: str) -> DataFrame:
    begun = time.monotonic()
    size, planned = verify_input(spark, run), _planned_frames(spark, run)
    records = navigation_records(_telemetry(spark, run), run.height, run.stride, run.frame_limit)
    watched, seen = observed(records, F.lit(0), f"{run.run_id}.nav")
    write_records(watched, f"{out}/nav")
    if seen.get["frame_count"] != planned:
        raise RuleViolation("navigation record count does not match the input frames")
    check_sequence(read_products(spark, f"{out}/nav", records.schema).select("source", "frame_id"))
    return _publish(spark, run, out, "nav", planned, 0, size, begun)


def run_targets(
    spark: SparkSession,
    run: Run,
    detections: DataFrame,
    categories: DataFrame,
    order: list[str],
    out: str,
    role: str = "detection",
    placement: Placement = Placement(),
) -> DataFrame:
    """Detection or track product and its image metadata below ``out``; returns the run row.

    The raw input is read once: the frame table, one small row per frame, is written to the
    shared folder, and checks, records and metadata are made from it.
    """
    product = "targets" if role == "detection" else "tracks"
    with _recorded(spark, run, out, product):
        return _targets(spark, run, detections, categories, order, out, role, placement)


def _targets(spark, run: Run, detections, categories, order, out: str, role: str, placement: Placement) -> DataFrame:
    begun = time.monotonic()
    _check_role(run, detections, role, placement)
    size, planned = verify_input(spark, run), _planned_frames(spark, run)
    path = scratch_path(spark, "frames")
    frame_table(spark, run, placement).write.parquet(path)
    frames = spark.read.parquet(path)
    # One record per frame and kind holds by construction: the frame table has one row per frame.
    checks = [
        Rule("window", F.col("n_valid") > 0, "window contains no valid line"),
        *geometry_rules(Geometry.of(), F.col("geometry_id")),
    ]
    fail_if_any(quarantine(frames, checks)[1].select("source", "frame_id", "failed_rule"), "frame rejected")
    records, meta, _ = target_records(frames, detections, categories, order, role)
    product = "targets" if role == "detection" else "tracks"
    watched, seen = observed(records, F.size(product), f"{run.run_id}.{product}")
    watched_meta, seen_meta = observed(meta, F.lit(0), f"{run.run_id}.meta")
    write_records(watched, f"{out}/{product}")
    write_records(watched_meta, f"{out}/image_meta")
    if {seen.get["frame_count"], seen_meta.get["frame_count"]} != {planned}:
        raise RuleViolation("product record counts do not match the input frames")
    check_sequence(read_products(spark, f"{out}/{product}", records.schema).select("source", "frame_id"))
    return _publish(spark, run, out, product, planned, seen.get["bytes"], size, begun)


def run_bundle(spark: SparkSession, run: Run, out: str) -> DataFrame:
    """Bundle of the run's frames below ``out``: pixels, descriptions and a manifest with digest; returns the run row."""
    with _recorded(spark, run, out, "bundle"):
        begun = time.monotonic()
        size, planned = verify_input(spark, run), _planned_frames(spark, run)
        limits = {} if run.frame_limit is None else {"frameLimit": run.frame_limit}
        frames = scan_frames(spark, run.input_path, run.height, run.stride, **limits)
        kinds = {"telemetry": F.col("window_start").isNotNull()}
        return _bundle(spark, run, out, members_of(frames, kinds), planned, size, begun)


def run_images(
    spark: SparkSession, run: Run, out: str, recursive: bool = False, allowed: str = DEFAULT_EXTENSIONS, decoder: Decoder = decode_pgm
) -> DataFrame:
    """Bundle of an image folder: its images in order of their relative path are the frames 0 to n-1 of one source.

    The limit is checked on the listing; no image is decoded before. A bad image fails the run.
    """
    with _recorded(spark, run, out, "images"):
        begun = time.monotonic()
        images = scan_images(spark, run.input_path, recursive, allowed, decoder)
        names = global_index(list_images(spark, run.input_path, recursive, allowed).select("absolute_path", "relative_path", "size_bytes"), ["relative_path"], "frame_id")
        found = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
        if run.size_bytes is not None and run.size_bytes != found["bytes"]:
            raise RuleViolation("input artifact size does not match request")
        if found["n"] > run.max_frames:
            raise FrameLimitExceeded(f"input holds {found['n']} frames, the limit is {run.max_frames}")
        if found["n"] == 0:
            raise NoResult("input holds no frame")
        # Ids are small and meet the images where these are read, as long as they may be broadcast.
        frames = images.join(small_or_shuffled(names.select("relative_path", "frame_id")), "relative_path")
        members = members_of(frames.withColumn("source", F.lit(run.input_path)))
        return _bundle(spark, run, out, members, found["n"], found["bytes"], begun)


def _bundle(spark, run: Run, out: str, members: DataFrame, planned: int, size: int, begun: float) -> DataFrame:
    described = {
        "request_id": run.run_id,
        "trace_id": run.trace_id,
        "runtime_profile": run.runtime_profile,
        "acquisition_mode": run.acquisition_mode,
        "sensor_id": run.sensor_id,
        "input_artifact": {"basename": run.input_path.rstrip("/").rpartition("/")[2], "size_bytes": size, "sha256": run.sha256},
        "provenance": {"engine": "framelake", "spark_version": spark.version},
    }
    manifest = write_bundle(members, f"{out}/bundle", described)
    if manifest["frame_count"] != planned:
        raise RuleViolation("bundle frame count does not match the input")
    return _publish(spark, run, out, "bundle", planned, 0, size, begun)


def _check_role(run: Run, detections: DataFrame, role: str, placement: Placement) -> None:
    """The role fits the acquisition mode, and boxes that say which plane they were found in name the run's filter plane.

    ``detections`` may carry ``plane_width`` and ``plane_height``; one frame has one role because a run has one.
    """
    if (run.acquisition_mode == "pushbroom") != (role == "detection"):
        raise RuleViolation(f"mode {run.acquisition_mode} does not match the role record {role}")
    if {"plane_width", "plane_height"} <= set(detections.columns):
        plane = Geometry.of()._replace(filter_width=F.lit(placement.filter_width or PIXELS_PER_LINE), filter_height=F.lit(placement.filter_height or run.height))
        rule = plane_match_rule(plane, F.col("plane_width"), F.col("plane_height"))
        _, rejects = quarantine(detections, [rule])
        fail_if_any(rejects.select("source", "frame_id", "failed_rule"), rule.message)


def product_artifacts(spark: SparkSession, out: str) -> DataFrame:
    """Files of a finished run with size, digest and media type."""
    files = list_artifacts(spark, out).where(~F.col("path").rlike(r"/[._][^/]*$"))
    return file_digests(files).withColumn(
        "media_type",
        F.when(F.endswith("path", F.lit(".json")), "application/x-ndjson").otherwise("application/vnd.apache.parquet"),
    )
