"""Operators offered to SQL users as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from framelake.operators.tiles import TILE_STEP


def register_functions(spark: SparkSession) -> None:
    """``tile_grid(width, height, tile)``: tile_index, x_offset, y_offset, as SQL the planner inlines."""
    step = f"CAST(floor(tile * {TILE_STEP}D + 0.5D) AS BIGINT)"
    columns = f"(CAST(ceil((width - tile) / {step}) AS BIGINT) + 1)"
    rows = f"(CAST(ceil((height - tile) / {step}) AS BIGINT) + 1)"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION tile_grid(width BIGINT, height BIGINT, tile BIGINT)
        RETURNS TABLE (tile_index BIGINT, x_offset BIGINT, y_offset BIGINT)
        RETURN SELECT i, least(i % {columns} * {step}, width - tile), least(i div {columns} * {step}, height - tile)
               FROM (SELECT explode(sequence(0L, {columns} * {rows} - 1)) AS i)"""
    )
