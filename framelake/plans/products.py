"""End-to-end products: navigation, detection and track records, crops, bundles, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.boxes import Box, Geometry, finite_triplet, inverse_map
from framelake.functions.names import class_folder, crop_name
from framelake.functions.records import (
    camera_time,
    detection_item,
    exposure,
    gps_time,
    image_meta,
    target_class,
    track_item,
)
from framelake.operators.artifacts import run_metrics
from framelake.operators.chips import cut_chips, sorted_boxes
from framelake.operators.lookup import small_or_shuffled
from framelake.operators.rules import (
    MAX_TARGETS_PER_FRAME,
    Rule,
    RuleViolation,
    box_rule,
    clock_rule,
    confidence_rule,
    fail_if_any,
    plane_rules,
    quarantine,
    run_status,
    strict,
)
from framelake.operators.targets import attach_targets, nest_targets, ordinal_targets
from framelake.operators.windows import contiguity, crowded_keys, window_summary

FRAME_KEYS = ["source", "frame_id"]


def navigation_records(lines: DataFrame, height: int, stride: int, frame_limit: int | None = None) -> DataFrame:
    """One concise record per frame from its first complete sample; zeros when it has none.

    Reads telemetry columns only. A window without a valid line fails the job; frames from
    ``frame_limit`` on are not looked at.
    """
    summary = window_summary(lines, height, stride, F.col("sample"))
    if frame_limit is not None:
        summary = summary.where(F.col("frame_id") < frame_limit)
    alive = F.when(F.col("n_valid") > 0, F.col("frame_id")).otherwise(
        F.raise_error(F.lit("window contains no valid line")).cast("bigint")
    )
    start = F.col("window_start.sample")
    zeros = F.array(*[F.lit(0.0).cast("float")] * 3)

    def vector(name: str) -> Column:
        return finite_triplet(F.coalesce(start[name], zeros))

    return summary.select(
        "source",
        alive.alias("frame_id"),
        gps_time(F.coalesce(start["gps_week"], F.lit(0)), F.coalesce(start["gps_seconds"], F.lit(0))).alias("gps_time"),
        vector("lla").alias("lla"),
        vector("attitude").alias("rpy"),
        vector("velocity").alias("velocity"),
    )


def _target_rules(role: str) -> list[Rule]:
    geometry = Geometry.of()
    rules = [
        Rule("over_limit", ~F.col("over_limit"), "too many targets in the frame"),
        Rule("frame_known", F.col("frame_known"), "target of a frame that does not exist"),
        box_rule(Box.of()),
        *plane_rules(Box.of(), geometry),
        Rule("class", F.col("type").isNotNull(), "unknown class_index"),
    ]
    if role == "detection":
        rules.insert(2, confidence_rule(F.col("confidence")))
    else:
        rules.insert(2, Rule("track", F.col("track_copy") == 1, "duplicate track_id in the same frame"))
    return rules


def target_records(
    frames: DataFrame,
    targets: DataFrame,
    categories: DataFrame,
    order: list[str],
    role: str = "detection",
    mode: str = "strict",
    keys: list[str] = FRAME_KEYS,
    limit: int = MAX_TARGETS_PER_FRAME,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(frame records, image metadata, rejects) of a detection or tracking product.

    ``frames`` carries geometry, camera clock and exposure per frame; ``targets`` the boxes
    in the filter plane. In strict mode the first bad record fails the job. In quarantine mode
    bad targets are returned as the third table, among them all targets of a frame over the
    target limit, which then has no record at all, and targets whose frame does not exist.
    """
    item_name = "targets" if role == "detection" else "tracks"
    geometry = [*Geometry._fields]
    crowded = crowded_keys(targets, keys, limit)
    placed = ordinal_targets(targets, keys, order, limit, crowded)
    if role == "tracking":
        # Partitioned within the frame, so the rows are where they already are; frames over the limit spread.
        spread = [] if crowded is None else [F.when(F.col("over_limit"), F.xxhash64(*order)).otherwise(F.lit(0))]
        same_track = Window.partitionBy(*keys, "track_id", *spread).orderBy("target_index")
        placed = placed.withColumn("track_copy", F.when(F.col("over_limit"), 1).otherwise(F.row_number().over(same_track)))
    labelled = (
        placed.join(frames.select(*keys, *geometry, F.lit(True).alias("frame_known")), keys, "left")
        .withColumn("frame_known", F.coalesce("frame_known", F.lit(False)))
        .join(small_or_shuffled(categories), "class_index", "left")
    )
    rules, rejects = _target_rules(role), None
    if mode == "strict":
        good = strict(labelled, rules, "target_index")
        frames = strict(frames, [clock_rule(F.col("valid"), F.col("camera_microseconds"))], "frame_id")
    else:
        good, rejects = quarantine(labelled, rules)
        frames = frames if crowded is None else frames.join(crowded, keys, "left_anti")
    box = inverse_map(Box.of(), Geometry.of())
    klass = target_class(F.col("class_index"), F.col("mapping_id"), F.col("type"))
    if role == "detection":
        item = detection_item(box, klass, F.col("confidence"), F.col("frame_id"), F.col("target_index"))
    else:
        item = track_item(box, klass, F.col("track_id"))
    nested = nest_targets(good, keys, item, item_name)
    attached = attach_targets(frames, nested, keys, item_name)
    clock = camera_time(F.col("camera_seconds"), F.col("camera_microseconds"))
    shutter = exposure(F.col("exposure_time_ns"))
    records = attached.select(
        "source", shutter.alias("exposure_duration"), "frame_id", clock.alias("observation_time"), item_name
    )
    count_name = "target_count" if role == "detection" else "tracked_target_count"
    planes = F.struct("filter_height", "filter_width", "geometry_id", "original_height", "original_width")
    meta = attached.select(
        "source",
        image_meta(
            F.col("sensor_id"),
            F.col("acquisition_mode"),
            F.col("frame_id"),
            planes,
            clock,
            shutter,
            F.size(item_name),
            count_name,
        ).alias("meta"),
    ).select("source", "meta.*")
    return records, meta, rejects


def check_sequence(frames: DataFrame) -> None:
    """Frame ids of each source must be exactly 0..n-1."""
    fail_if_any(contiguity(frames).where(~F.col("contiguous")), "frame ids are not contiguous from 0")


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines, one row per frame, below an output path that must not exist yet. Compressed files are read back by their names."""
    records.write.mode("errorifexists").option("ignoreNullFields", "false").json(path, compression=compression)


def crop_records(frames: DataFrame, detections: DataFrame, keys: list[str] = FRAME_KEYS) -> DataFrame:
    """Chips of all detections, cut in the task that holds the frame.

    ``detections`` has boxes in the frame's pixels, class type and the ordinal ``target_index``. They are
    written sorted by frame and read by the tasks that need them, so no pixel is shuffled at any number of boxes.
    """
    return named_chips(cut_chips(frames, sorted_boxes(detections, keys)), keys)


def named_chips(chips: DataFrame, keys: list[str] = FRAME_KEYS) -> DataFrame:
    """Chips with the folder of their class and their name, in place of index and type."""
    folder, name = class_folder(F.col("type")).alias("class_dir"), crop_name(F.col("frame_id"), F.col("target_index")).alias("name")
    return chips.select(*keys, folder, name, "width", "height", "pixels")


def write_crops(crops: DataFrame, path: str) -> None:
    crops.write.mode("errorifexists").partitionBy("class_dir").parquet(path)


def run_row(frames: DataFrame, max_frames: int, keys: list[str] = ["source"]) -> DataFrame:
    """Status and counts of each run; written last, so readers see only finished products."""
    counted = frames.groupBy(*keys).agg(*run_metrics(frames, F.col("size_bytes")))
    return counted.withColumn("over_limit", F.col("frame_count") > max_frames).withColumn(
        "status", run_status(F.col("frame_count"), F.col("over_limit"))
    )


def require_reconciled(records: DataFrame, meta: DataFrame, frame_count: int) -> None:
    """Both outputs hold exactly one record per processed frame."""
    counts = (records.count(), meta.count())
    if counts != (frame_count, frame_count):
        raise RuleViolation(f"record counts {counts} differ from {frame_count} frames")


__all__ = [
    "check_sequence",
    "crop_records",
    "named_chips",
    "navigation_records",
    "require_reconciled",
    "run_row",
    "target_records",
    "write_crops",
    "write_records",
]
