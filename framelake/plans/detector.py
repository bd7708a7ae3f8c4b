"""The detector from frames to target rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.spatial import suppress
from framelake.operators.tiles import cap_kept, cut_tiles, decode_boxes, detector_rows, score_dense_tiles, untile


def detect(
    frames: DataFrame,
    make_predict,
    tile: int,
    n_classes: int,
    keys: list[str],
    score_above: float = 0.25,
    overlap_above: float = 0.45,
    candidates: int = 500,
    ties: list[Column] | None = None,
) -> DataFrame:
    """Boxes (keys, class_index, confidence, edges in frame coordinates, rank) of dense frames.

    Frames are cut into overlapping tiles; ``make_predict`` gives a model that turns a batch of tiles into lists of raw
    vectors (centre, size, class scores), one list per tile. Candidates of all tiles of a frame compete by score, the best
    ``candidates`` enter the suppression, and boxes are clamped and cut at the record limit. Pixels stay in
    the task that reads them; only boxes are shuffled.
    """
    tiles = cut_tiles(frames.select(*keys, "pixels", "width", "height"), tile)
    scored = score_dense_tiles(tiles, make_predict, "array<array<float>>").drop("tile")
    vectors = scored.withColumn("raw", F.explode("raw"))
    boxes = untile(decode_boxes(vectors, "raw", n_classes, score_above).drop("raw"))
    boxes = boxes.withColumn("confidence", F.col("score").cast("double")).drop("score")
    order = [-F.col("confidence"), *(ties or [F.col("tile_index")])]
    kept = suppress(boxes, keys, order, overlap_above, candidates, "class_index")
    rows = detector_rows(kept, F.col("width"), F.col("height"))
    edges = ["x_min", "y_min", "x_max", "y_max"]
    return cap_kept(rows, keys, order).select(*keys, "class_index", "confidence", *edges, "rank")
