"""Tile grids, model calls per tile, box decoding and the detector's row rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.boxes import Box, clamp, ordered
from framelake.operators.pixels import cut_dense
from framelake.operators.rules import MAX_TARGETS_PER_FRAME
from framelake.operators.windows import first_ranked

# Fixed value: share of the tile size that separates neighbouring tiles.
TILE_STEP = 0.78125


def tile_stride(tile: int) -> int:
    return int(tile * TILE_STEP + 0.5)


def tiles_along(length: Column, tile: int) -> Column:
    return F.ceil((length - tile) / tile_stride(tile)).cast("bigint") + 1


def tile_grid(frames: DataFrame, tile: int, width: str = "width", height: str = "height") -> DataFrame:
    """One row per frame and tile, row-major, edge tiles pulled back inside.

    The grid follows from the frame's own size: no join.
    """
    w, h = F.col(width).cast("bigint"), F.col(height).cast("bigint")
    columns, rows = tiles_along(w, tile), tiles_along(h, tile)
    step, index = tile_stride(tile), F.col("tile_index")
    return (
        frames.withColumn("tile_index", F.explode(F.sequence(F.lit(0).cast("bigint"), columns * rows - 1)))
        .withColumn("x_offset", F.least((index % columns) * step, w - tile))
        .withColumn("y_offset", F.least(F.floor(index / columns) * step, h - tile))
    )


def tile_windows(width: Column, height: Column, tile: int) -> Column:
    """The grid of one frame as an array of windows, row-major, for cutting all tiles in one pass."""
    w, h, step = width.cast("bigint"), height.cast("bigint"), tile_stride(tile)
    columns = tiles_along(w, tile)

    def window(i: Column) -> Column:
        x, y = F.least((i % columns) * step, w - tile), F.least(F.floor(i / columns) * step, h - tile)
        corners = {"x_min": x, "y_min": y, "x_max": x + tile, "y_max": y + tile}
        return F.struct(i.alias("tile_index"), *[v.cast("int").alias(k) for k, v in corners.items()])

    return F.transform(F.sequence(F.lit(0).cast("bigint"), columns * tiles_along(h, tile) - 1), window)


def cut_tiles(frames: DataFrame, tile: int, pixels: str = "pixels") -> DataFrame:
    """Tiles of dense (BINARY) frames with ``width`` and ``height``: adds tile_index, x_offset, y_offset and ``tile``.

    A frame's tiles are cut in one pass and only they are exploded; the frame itself is neither copied nor shuffled.
    """
    cut = frames.withColumn("_windows", tile_windows(F.col("width"), F.col("height"), tile))
    cut = cut.withColumn("_tiles", cut_dense(pixels, "width", "height", "_windows")).drop(pixels)
    each = cut.withColumn("_t", F.explode(F.arrays_zip("_windows", "_tiles"))).drop("_windows", "_tiles")
    place = {"tile_index": "tile_index", "x_offset": "x_min", "y_offset": "y_min"}
    return each.withColumns({k: F.col(f"_t._windows.{v}").cast("bigint") for k, v in place.items()} | {"tile": F.col("_t._tiles")}).drop("_t")


def score_dense_tiles(tiles: DataFrame, make_predict, schema, pixels: str = "tile", name: str = "raw", batch_size: int = 32) -> DataFrame:
    """Call a user model on batches of BINARY tiles (one row of float32 values per tile); it is loaded once per task."""

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_predict()
        for tiles in batches:
            parts = [tiles.iloc[a : a + batch_size] for a in range(0, len(tiles), batch_size)]
            yield pd.Series([row for part in parts for row in model(np.stack([np.frombuffer(t, np.uint8) for t in part]).astype(np.float32))])

    return tiles.withColumn(name, predict(F.col(pixels)))


def untile(detections: DataFrame) -> DataFrame:
    """Move boxes from tile to frame coordinates by the tile offsets they carry."""
    return detections.withColumns(
        {
            "x_min": F.col("x_min") + F.col("x_offset"),
            "x_max": F.col("x_max") + F.col("x_offset"),
            "y_min": F.col("y_min") + F.col("y_offset"),
            "y_max": F.col("y_max") + F.col("y_offset"),
        }
    )


def score_tiles(
    tiles: DataFrame,
    make_predict,
    schema,
    tile: int,
    pixels: str = "pixels",
    name: str = "raw",
    batch_size: int = 32,
) -> DataFrame:
    """Call a user model on tile pixels; the model is loaded once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(
        make_predict, return_type=schema, batch_size=batch_size, input_tensor_shapes=[[tile * tile]]
    )
    return tiles.withColumn(name, predict(F.col(pixels)))


def decode_boxes(df: DataFrame, raw: str, n_classes: int, threshold: float) -> DataFrame:
    """Raw vector (cx, cy, w, h, score per class) to corner box, best class and score.

    The first of equal maxima wins; rows at or below the threshold are dropped.
    """
    scores = F.slice(F.col(raw), 5, n_classes)
    cx, cy, w, h = (F.col(raw)[i].cast("double") for i in range(4))
    best = F.array_max(scores)
    return (
        df.withColumn("score", best)
        .where(F.col("score") > F.lit(threshold).cast("float"))
        .withColumns(
            {
                "class_index": F.array_position(scores, F.col("score")) - 1,
                "x_min": cx - w / 2.0,
                "y_min": cy - h / 2.0,
                "x_max": cx + w / 2.0,
                "y_max": cy + h / 2.0,
            }
        )
    )


def detector_rows(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Keep rows with a class, a score in [0, 1] and a box that is not empty after clamping."""
    box = clamp(Box.of(), width, height)
    clamped = dict(zip(Box._fields, box))
    return (
        detections.where((F.col("class_index") >= 0) & F.col("confidence").between(0.0, 1.0))
        .withColumns(clamped)
        .where(ordered(Box.of()))
    )


def cap_kept(kept: DataFrame, frame: list[str], order: list[Column], limit: int = MAX_TARGETS_PER_FRAME) -> DataFrame:
    """The detector stops at the record limit, in suppression order."""
    return first_ranked(kept, frame, order, limit)
