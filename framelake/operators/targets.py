"""Per-frame nesting of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.rules import MAX_TARGETS_PER_FRAME
from framelake.operators.windows import bounded_ordinals


def ordinal_targets(
    targets: DataFrame, keys: list[str], order: list[str], limit: int = MAX_TARGETS_PER_FRAME, crowded: DataFrame | None | bool = True
) -> DataFrame:
    """Targets with their ordinal; frames over the limit come out marked ``over_limit``."""
    return bounded_ordinals(targets, keys, order, limit, crowded=crowded)


def nest_targets(targets: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """One array per frame in ordinal order. Frames hold at most the record limit here."""
    placed = F.struct(F.col("target_index").alias("i"), item.alias("item"))
    return targets.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(placed)), lambda p: p["item"]).alias(name)
    )


def attach_targets(frames: DataFrame, nested: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keep frames without targets, with an empty array.

    Targets are nested first, so this join is one row to one row and cannot skew.
    """
    empty = F.array().cast(nested.schema[name].dataType)
    return frames.join(nested, keys, "left").withColumn(name, F.coalesce(F.col(name), empty))


def observation_count(product: DataFrame, name: str) -> DataFrame:
    return product.agg(F.coalesce(F.sum(F.size(name)), F.lit(0)).cast("bigint").alias("observations"))
