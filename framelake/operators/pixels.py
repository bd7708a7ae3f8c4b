"""Pixel operators.

Three shapes of the same image are served: an array column (expressions, no shuffle), a
dense BINARY column (numpy over Arrow batches) and the long form (frame, y, x, v).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.boxes import Box
from framelake.functions.imaging import bilinear, image, nearest

# BT.601 luma weights in 14-bit fixed point.
LUMA_BITS = 14
LUMA_RED, LUMA_GREEN, LUMA_BLUE = 4899, 9617, 1868


def _positions(count: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.when(count > 0, F.sequence(zero, count - 1)).otherwise(F.array().cast("array<bigint>"))


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside a lambda an inlined expression would be computed again for every pixel.
    """
    return F.get(F.transform(F.array(value), body), 0)


def resample_nearest(
    pixels: Column,
    width: Column,
    height: Column,
    scale: tuple[Column, Column],
    offset: tuple[Column, Column],
    out_width: Column,
    out_height: Column,
) -> Column:
    """Affine resample of an array image; the source index is truncated, outside is 0."""

    def sample(i: Column, source: Column) -> Column:
        x = ((i % out_width).cast("double") - offset[0]) / scale[0]
        y = (F.floor(i / out_width).cast("double") - offset[1]) / scale[1]
        covered = (x >= 0) & (y >= 0) & (x < width) & (y < height)
        at = F.floor(y) * width + F.floor(x)
        return F.when(covered, F.get(source, at.cast("int"))).otherwise(F.lit(0)).cast("smallint")

    places = _positions((out_width * out_height).cast("bigint"))
    return _once(pixels, lambda source: F.transform(places, lambda i: sample(i, source)))


def cut(pixels: Column, width: Column, window: Box) -> Column:
    """Rectangle of an array image, row-major; ``window`` holds integer edges."""
    w = window.x_max - window.x_min
    some = (w > 0) & (window.y_max > window.y_min)
    none = F.array().cast("array<bigint>")
    rows = F.when(some, F.sequence(window.y_min.cast("bigint"), window.y_max.cast("bigint") - 1)).otherwise(none)

    def strip(y: Column) -> Column:
        return F.slice(pixels, (y * width + window.x_min + 1).cast("int"), F.greatest(w, F.lit(0)).cast("int"))

    return F.flatten(F.transform(rows, strip))


def block_mean(pixels: Column, width: int, height: int, factor: int) -> Column:
    """Downscale an array image by a whole factor, averaging each block."""
    out_width = width // factor
    cells = F.sequence(F.lit(0), F.lit(out_width * (height // factor) - 1))

    def mean(i: Column, source: Column) -> Column:
        corner = F.floor(i / out_width) * (factor * width) + (i % out_width) * factor
        picks = [
            F.get(source, (corner + dy * width + dx).cast("int")).cast("double")
            for dy in range(factor)
            for dx in range(factor)
        ]
        total = picks[0]
        for pick in picks[1:]:
            total = total + pick
        return total / float(factor * factor)

    return _once(pixels, lambda source: F.transform(cells, lambda i: mean(i, source)))


def gray_to_channels(pixels: Column) -> Column:
    """Repeat a gray value for three channels, interleaved (the same for both orders)."""
    return F.flatten(F.transform(pixels, lambda v: F.array_repeat(v, 3)))


def swap_red_blue(pixels: Column) -> Column:
    """Interleaved three-channel array with first and third channel exchanged."""
    return _once(pixels, lambda source: F.transform(source, lambda _, i: F.get(source, (i + 2 - 2 * (i % 3)).cast("int"))))


def rgb_to_gray(pixels: Column) -> Column:
    def luma(i: Column, source: Column) -> Column:
        r, g, b = (F.get(source, (i * 3 + c).cast("int")).cast("bigint") for c in range(3))
        weighted = r * LUMA_RED + g * LUMA_GREEN + b * LUMA_BLUE + (1 << (LUMA_BITS - 1))
        return F.shiftright(weighted, LUMA_BITS).cast("smallint")

    def convert(source: Column) -> Column:
        return F.transform(_positions(F.floor(F.size(source) / 3)), lambda i: luma(i, source))

    return _once(pixels, convert)


def to_long(df: DataFrame, pixels: str, width: Column, keys: list[str]) -> DataFrame:
    """Array image to rows (keys, y, x, v)."""
    return df.select(*keys, width.alias("_w"), F.posexplode(pixels).alias("_p", "v")).select(
        *keys, F.floor(F.col("_p") / F.col("_w")).alias("y"), (F.col("_p") % F.col("_w")).cast("bigint").alias("x"), "v"
    )


def unpack_long(df: DataFrame, packed: str, keys: list[str]) -> DataFrame:
    """Packed 10-bit pixels to rows (keys, x, v) with expressions only."""
    from framelake.functions.binary import be_uint, unpack_quad

    packs = F.sequence(F.lit(0), F.floor(F.length(packed) / 5).cast("int") - 1)
    five = df.select(*keys, F.posexplode(F.transform(packs, lambda i: F.substring(F.col(packed), i * 5 + 1, F.lit(5)))).alias("pack", "b"))
    values = F.array(*unpack_quad(*[be_uint(F.col("b"), i, 1) for i in range(5)]))
    return five.select(*keys, "pack", F.posexplode(values).alias("slot", "v")).select(
        *keys, (F.col("pack") * 4 + F.col("slot")).cast("bigint").alias("x"), F.col("v").cast("smallint").alias("v")
    )


def resample_long(pixels: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Destination pixels with inverse coordinates ``src_x, src_y`` joined to source pixels.

    Equi-join on frame and truncated coordinate; uncovered pixels become 0.
    """
    wanted = targets.withColumns({"_sx": F.floor("src_x"), "_sy": F.floor("src_y")})
    source = pixels.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"), "v")
    return wanted.join(source, [*keys, "_sx", "_sy"], "left").select(
        *keys, "y", "x", F.coalesce("v", F.lit(0)).cast("smallint").alias("v")
    )


# ---- dense frames: Arrow functions over the numpy helpers ------------------------------------------


def _resample(
    p: pd.Series,
    width: pd.Series,
    height: pd.Series,
    scale_x: pd.Series,
    scale_y: pd.Series,
    offset_x: pd.Series,
    offset_y: pd.Series,
    out_width: pd.Series,
    out_height: pd.Series,
) -> pd.Series:
    rows = zip(p, width, height, scale_x, scale_y, offset_x, offset_y, out_width, out_height)
    return pd.Series(
        [nearest(image(d, w, h), (sx, sy), (ox, oy), ow, oh).tobytes() for d, w, h, sx, sy, ox, oy, ow, oh in rows]
    )


def _resize(
    p: pd.Series, width: pd.Series, height: pd.Series, out_width: pd.Series, out_height: pd.Series
) -> pd.Series:
    rows = zip(p, width, height, out_width, out_height)
    return pd.Series([bilinear(image(d, w, h), ow, oh).tobytes() for d, w, h, ow, oh in rows])


def _cut(p: pd.Series, width: pd.Series, height: pd.Series, windows: pd.Series) -> pd.Series:
    out = []
    for data, w, h, rects in zip(p, width, height, windows):
        full = image(data, w, h)
        out.append([full[r["y_min"] : r["y_max"], r["x_min"] : r["x_max"]].tobytes() for r in rects])
    return pd.Series(out)


def resample_dense(*columns) -> Column:
    """pixels, width, height, scale_x, scale_y, offset_x, offset_y, out_width, out_height."""
    return F.pandas_udf(_resample, "binary")(*columns)


def resize_dense(*columns) -> Column:
    """pixels, width, height, out_width, out_height."""
    return F.pandas_udf(_resize, "binary")(*columns)


def cut_dense(*columns) -> Column:
    """pixels, width, height, windows: several rectangles of each frame in one pass."""
    return F.pandas_udf(_cut, "array<binary>")(*columns)


def normalise_frames(
    frames: DataFrame, scale, offset, out_width: int | None = None, out_height: int | None = None
) -> DataFrame:
    """Resample dense frames; the identity map that keeps the size leaves the pixels alone."""
    if out_width is None and out_height is None and scale == (1.0, 1.0) and offset == (0.0, 0.0):
        return frames
    width = F.lit(out_width) if out_width else F.col("width")
    height = F.lit(out_height) if out_height else F.col("height")
    mapped = resample_dense(
        "pixels", "width", "height", *[F.lit(float(v)) for v in (*scale, *offset)], width, height
    )
    return frames.withColumns({"pixels": mapped, "width": width, "height": height})
