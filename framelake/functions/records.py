"""Nested product and telemetry records.

Struct fields are declared in alphabetical order, so serialised JSON keys come out sorted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.boxes import Box, center, finite_triplet
from framelake.functions.names import source_id, target_id

# ---- fixed values: tags carried by the records -------------------------------------------
CAMERA_SCALE = "camera"
GPS_SCALE = "GPS"
EXPOSURE_UNIT = "ns"
SOURCE_UNIT = "source"
ATTITUDE_ORDER = "roll-pitch-yaw_3-2-1"
# -------------------------------------------------------------------------------------------


def camera_time(seconds: Column, microseconds: Column) -> Column:
    return F.struct(
        microseconds.alias("microseconds"), F.lit(CAMERA_SCALE).alias("scale"), seconds.alias("seconds")
    )


def exposure(nanoseconds: Column) -> Column:
    return F.struct(F.lit(EXPOSURE_UNIT).alias("unit"), nanoseconds.alias("value"))


def gps_time(week: Column, seconds: Column) -> Column:
    return F.struct(F.lit(GPS_SCALE).alias("scale"), seconds.alias("seconds"), week.alias("week"))


def _vector(values: Column, frame: bool = True, order: str | None = None) -> Column:
    fields = []
    if frame:
        fields.append(F.lit(SOURCE_UNIT).alias("frame"))
    fields.append(F.lit(False).alias("normalized"))
    if order:
        fields.append(F.lit(order).alias("order"))
    fields.append(F.array(*[F.lit(SOURCE_UNIT)] * 3).alias("units"))
    fields.append(finite_triplet(values).alias("values"))
    return F.struct(*fields)


def telemetry(sample: Column, convention: str = "line-scan") -> Column:
    """Full nested record of one telemetry sample."""
    return F.struct(
        _vector(sample["attitude"], order=ATTITUDE_ORDER).alias("attitude"),
        camera_time(sample["camera_seconds"], sample["camera_microseconds"]).alias("camera_time"),
        sample["channel_id"].alias("channel_id"),
        exposure(sample["exposure_time_ns"]).alias("exposure"),
        gps_time(sample["gps_week"], sample["gps_seconds"]).alias("gps_time"),
        _vector(sample["lla"], frame=False).alias("lla"),
        sample["row_number"].alias("row_number"),
        F.lit(convention).alias("source_convention"),
        sample["strip_number"].alias("strip_number"),
        sample["time_sync_status"].alias("time_sync_status"),
        _vector(sample["velocity"]).alias("velocity"),
    )


def navigation(frame_id: Column, start: Column) -> Column:
    """Concise navigation record, taken from the first sample of a window only."""
    return F.struct(
        frame_id.alias("frame_id"),
        gps_time(start["gps_week"], start["gps_seconds"]).alias("gps_time"),
        finite_triplet(start["lla"]).alias("lla"),
        finite_triplet(start["attitude"]).alias("rpy"),
        finite_triplet(start["velocity"]).alias("velocity"),
    )


# Columns of an area-array frame kept from a telemetry sample.
AREA_FIELDS = (
    "valid",
    "channel_id",
    "strip_number",
    "time_sync_status",
    "row_number",
    "camera_seconds",
    "camera_microseconds",
    "exposure_time_ns",
)


def area_frame(sample: Column) -> Column:
    return F.struct(*[sample[name].alias(name) for name in AREA_FIELDS])


def target_class(index: Column, mapping_id: Column, kind: Column) -> Column:
    return F.struct(index.alias("index"), mapping_id.alias("mapping_id"), kind.alias("type"))


def detection_item(box: Box, klass: Column, confidence: Column, frame_id: Column, index: Column) -> Column:
    x, y = center(box)
    return F.struct(
        box.struct().alias("bbox"),
        klass.alias("class"),
        confidence.alias("confidence"),
        F.struct(y.alias("line"), x.alias("pixel")).alias("geolocation_sample"),
        source_id(frame_id, index).alias("source_id"),
        target_id(index).alias("target_id"),
    )


def track_item(box: Box, klass: Column, track_id: Column) -> Column:
    x, y = center(box)
    return F.struct(
        box.struct().alias("bbox"),
        klass.alias("class"),
        F.struct(x.alias("column"), y.alias("row")).alias("image_sample"),
        track_id.alias("track_id"),
    )


def frame_metadata(
    index: Column,
    pts_ns: Column,
    duration_ns: Column,
    width: Column,
    height: Column,
    pixel_format: Column,
    size_bytes: Column,
    kinds: dict[str, Column],
) -> Column:
    """Per-frame description; ``kinds`` maps a metadata kind to a presence predicate."""
    present = F.array_compact(F.array(*[F.when(flag, F.lit(kind)) for kind, flag in kinds.items()]))
    return F.struct(
        duration_ns.alias("duration_ns"),
        index.alias("index"),
        present.alias("meta_kinds"),
        pts_ns.alias("pts_ns"),
        size_bytes.alias("size_bytes"),
        F.struct(pixel_format.alias("format"), height.alias("height"), width.alias("width")).alias("video"),
    )


def image_meta(
    sensor_id: Column,
    mode: Column,
    frame_id: Column,
    geometry: Column,
    observation: Column,
    exposure_duration: Column,
    count: Column,
    count_name: str,
) -> Column:
    fields = [
        mode.alias("acquisition_mode"),
        exposure_duration.alias("exposure_duration"),
        geometry["filter_height"].alias("filter_height"),
        geometry["filter_width"].alias("filter_width"),
        frame_id.alias("frame_id"),
        geometry["geometry_id"].alias("geometry_id"),
        observation.alias("observation_time"),
        geometry["original_height"].alias("original_height"),
        geometry["original_width"].alias("original_width"),
        sensor_id.alias("sensor_id"),
        count.alias(count_name),
    ]
    return F.struct(*fields)


def redact_input(record: Column, fields: list[str]) -> Column:
    """Struct without ``path``, with the file name as ``basename`` instead."""
    path = record["path"]
    kept = [record[name].alias(name) for name in fields if name != "path"]
    base = F.element_at(F.split(path, "/"), -1).alias("basename")
    return F.struct(base, *kept)
