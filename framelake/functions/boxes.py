"""Box geometry as column arithmetic. Boxes are half-open, zero-origin, in doubles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four edge columns. ``Box.of(df_prefix)`` reads the usual column names."""

    x_min: Column
    y_min: Column
    x_max: Column
    y_max: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(prefix + edge) for edge in cls._fields))

    def columns(self, prefix: str = "") -> list[Column]:
        return [column.alias(prefix + edge) for edge, column in zip(self._fields, self)]

    def struct(self) -> Column:
        """Edges in alphabetical order, as product records carry them."""
        return F.struct(
            self.x_max.alias("x_max"),
            self.x_min.alias("x_min"),
            self.y_max.alias("y_max"),
            self.y_min.alias("y_min"),
        )


class Geometry(NamedTuple):
    """Affine map filter = scale * original + offset, and both plane sizes."""

    scale_x: Column
    scale_y: Column
    offset_x: Column
    offset_y: Column
    original_width: Column
    original_height: Column
    filter_width: Column
    filter_height: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Geometry":
        return cls(*(F.col(prefix + name) for name in cls._fields))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(finite(value), value)


def finite_triplet(values: Column) -> Column:
    return F.transform(values, finite_or_null)


def forward_map(box: Box, geometry: Geometry) -> Box:
    return Box(
        geometry.scale_x * box.x_min + geometry.offset_x,
        geometry.scale_y * box.y_min + geometry.offset_y,
        geometry.scale_x * box.x_max + geometry.offset_x,
        geometry.scale_y * box.y_max + geometry.offset_y,
    )


def inverse_map(box: Box, geometry: Geometry) -> Box:
    """Filter plane to original plane.

    The map is axis aligned, so two opposite corners give the extremes of all four.
    """
    xs = [(x - geometry.offset_x) / geometry.scale_x for x in (box.x_min, box.x_max)]
    ys = [(y - geometry.offset_y) / geometry.scale_y for y in (box.y_min, box.y_max)]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def center(box: Box) -> tuple[Column, Column]:
    """(x, y) of the middle."""
    return (box.x_min + box.x_max) / 2.0, (box.y_min + box.y_max) / 2.0


def clamp(box: Box, width: Column, height: Column) -> Box:
    """Put the corners in order and cut the box to a plane; may end up degenerate."""
    zero = F.lit(0.0)
    return Box(
        F.greatest(zero, F.least(box.x_min, box.x_max)),
        F.greatest(zero, F.least(box.y_min, box.y_max)),
        F.least(width.cast("double"), F.greatest(box.x_min, box.x_max)),
        F.least(height.cast("double"), F.greatest(box.y_min, box.y_max)),
    )


def crop_window(box: Box, width: Column, height: Column) -> Box:
    """Integer pixel window covering the box inside the plane; empty when max <= min."""
    zero = F.lit(0).cast("bigint")
    return Box(
        F.greatest(zero, F.floor(box.x_min)),
        F.greatest(zero, F.floor(box.y_min)),
        F.least(width.cast("bigint"), F.ceil(box.x_max)),
        F.least(height.cast("bigint"), F.ceil(box.y_max)),
    )


def area(box: Box) -> Column:
    return (box.x_max - box.x_min) * (box.y_max - box.y_min)


def ordered(box: Box) -> Column:
    return (box.x_min < box.x_max) & (box.y_min < box.y_max)


def well_formed(box: Box) -> Column:
    return finite(box.x_min) & finite(box.y_min) & finite(box.x_max) & finite(box.y_max) & ordered(box)


def inside(box: Box, width: Column, height: Column) -> Column:
    return (box.x_min >= 0) & (box.y_min >= 0) & (box.x_max <= width) & (box.y_max <= height) & ordered(box)


def iou(a: Box, b: Box) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a.x_max, b.x_max) - F.greatest(a.x_min, b.x_min))
    height = F.greatest(F.lit(0.0), F.least(a.y_max, b.y_max) - F.greatest(a.y_min, b.y_min))
    shared = width * height
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
