"""Ordered data-quality rules: the first failing rule names the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.boxes import Box, Geometry, finite, inside, inverse_map, well_formed
from framelake.functions.names import valid_geometry_id

# ---- fixed values: record limits -----------------------------------------------------------
MAX_TARGETS_PER_FRAME = 256
MAX_MICROSECONDS = 999_999
SCHEMA_VERSION = 1
SUPPORTED_CHANNEL = 0
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``holds`` must be true for a good record; null counts as a failure."""

    id: str
    holds: Column
    message: str


class RuleViolation(ValueError):
    """A strict run met a bad record."""


def first_failure(rules: list[Rule]) -> Column:
    """Id of the first rule that does not hold, null when all hold."""
    return F.coalesce(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.id)) for r in rules])


def failure_message(rules: list[Rule], rule_id: Column) -> Column:
    branches = None
    for rule in rules:
        text = F.lit(rule.message)
        hit = rule_id == rule.id
        branches = F.when(hit, text) if branches is None else branches.when(hit, text)
    return branches


def flag(df: DataFrame, rules: list[Rule], name: str = "failed_rule") -> DataFrame:
    return df.withColumn(name, first_failure(rules))


def strict(df: DataFrame, rules: list[Rule], carrier: str) -> DataFrame:
    """Fail the job at the first bad record.

    The check is folded into ``carrier``, a column the sink writes, so that column pruning
    cannot drop it.
    """
    failed = first_failure(rules)
    message = F.concat(F.lit("record rejected: "), failure_message(rules, failed))
    checked = F.when(failed.isNotNull(), F.raise_error(message).cast(df.schema[carrier].dataType))
    return df.withColumn(carrier, checked.otherwise(F.col(carrier)))


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``failed_rule``)."""
    flagged = flag(df, rules)
    good = flagged.where(F.col("failed_rule").isNull()).drop("failed_rule")
    return good, flagged.where(F.col("failed_rule").isNotNull())


# ---- rule sets over the usual column names ---------------------------------------------------


def box_rule(box: Box) -> Rule:
    return Rule("box", well_formed(box), "box must be finite with min < max")


def confidence_rule(value: Column) -> Rule:
    return Rule("confidence", finite(value) & value.between(0.0, 1.0), "confidence must lie in [0, 1]")


def version_rule(version: Column) -> Rule:
    return Rule("schema_version", version == SCHEMA_VERSION, "unsupported record version")


def geometry_rules(g: Geometry, geometry_id: Column) -> list[Rule]:
    sizes = (g.original_width, g.original_height, g.filter_width, g.filter_height)
    positive = sizes[0] >= 1
    for size in sizes[1:]:
        positive = positive & (size >= 1)
    numbers = finite(g.scale_x) & finite(g.scale_y) & finite(g.offset_x) & finite(g.offset_y)
    return [
        Rule("plane_size", positive, "plane sizes must be at least 1"),
        Rule("scale", numbers & (g.scale_x > 0) & (g.scale_y > 0), "scale must be positive and finite"),
        Rule("geometry_id", valid_geometry_id(geometry_id), "geometry id is malformed"),
    ]


def plane_rules(box: Box, g: Geometry) -> list[Rule]:
    """The box lies in the filter plane and its inverse lies in the original image."""
    original = inverse_map(box, g)
    return [
        Rule("filter_plane", inside(box, g.filter_width, g.filter_height), "box is outside the filter plane"),
        Rule(
            "original_plane",
            well_formed(original) & inside(original, g.original_width, g.original_height),
            "mapped box is not inside the original image",
        ),
    ]


def clock_rule(valid: Column, microseconds: Column) -> Rule:
    return Rule(
        "camera_clock",
        valid & (microseconds <= MAX_MICROSECONDS),
        "camera clock is missing or out of range",
    )


def plane_match_rule(g: Geometry, width: Column, height: Column) -> Rule:
    return Rule(
        "plane_match",
        (g.filter_width == width) & (g.filter_height == height),
        "filter plane differs from the frame size",
    )


def role_rules(mode: Column, has_detection: Column, has_telemetry: Column) -> list[Rule]:
    """A pushbroom frame carries a detection record, any other a tracking record; every frame has telemetry."""
    return [
        Rule("role", (mode == "pushbroom") == has_detection, "mode does not match the role record"),
        Rule("telemetry", has_telemetry, "telemetry record is missing"),
    ]


def channel_rule(channel: Column) -> Rule:
    return Rule("channel", channel == SUPPORTED_CHANNEL, "channel is not supported")


def tile_rule(width: Column, height: Column, tile: int) -> Rule:
    return Rule("tile_size", (width >= tile) & (height >= tile), "frame is smaller than the model input")


# ---- rules over sets of records --------------------------------------------------------------


def crowded_frames(targets: DataFrame, keys: list[str], limit: int = MAX_TARGETS_PER_FRAME) -> DataFrame:
    """Frames over the target limit; the whole frame is rejected."""
    return targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_targets")).where(F.col("n_targets") > limit)


def repeated(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (records per frame and kind, tracks per frame, members)."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def role_conflicts(frames: DataFrame, detections: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Frames that carry both a detection and a tracking record, or neither.

    All sides are reduced to presence bits before they meet, so no frame is gathered.
    """

    def presence(df: DataFrame, detection: bool, tracking: bool) -> DataFrame:
        return df.select(*keys, F.lit(detection).alias("d"), F.lit(tracking).alias("t"))

    sides = presence(frames, False, False).unionByName(presence(detections, True, False)).unionByName(
        presence(tracks, False, True)
    )
    seen = sides.groupBy(*keys).agg(F.bool_or("d").alias("has_detection"), F.bool_or("t").alias("has_tracking"))
    return seen.where(F.col("has_detection") == F.col("has_tracking"))


def over_frame_limit(frames: DataFrame, keys: list[str], limit: Column | int) -> DataFrame:
    """Frame count per run and whether it exceeds the limit, which fails the run."""
    counted = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"))
    return counted.withColumn("over_limit", F.col("frame_count") > limit)


def run_status(frame_count: Column, over_limit: Column) -> Column:
    """A run over its limit fails; a run without frames has no result."""
    return (
        F.when(over_limit, F.lit("failed")).when(frame_count == 0, F.lit("no_result")).otherwise(F.lit("completed"))
    )


def empty_windows(summary: DataFrame) -> DataFrame:
    """Frames without a single valid line, which is an error rather than an empty image."""
    return summary.where(F.col("n_valid") == 0)


def fail_if_any(bad: DataFrame, message: str) -> None:
    """Raise when the violation table has a row; only one row reaches the driver."""
    rows = bad.limit(1).collect()
    if rows:
        raise RuleViolation(f"{message}: {rows[0].asDict()}")
