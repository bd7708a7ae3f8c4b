"""Joins of frames and targets with dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task of ``both_sides`` counts, and rows that one array stands for.
ROWS_A_TASK, RUN = 500_000, 1 << 16
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def small_or_shuffled(dimension: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a dimension for broadcast only after measuring that it stays under both bounds.

    The count stops at the bound; bytes are those of the rows as JSON. Larger dimensions are left unmarked: they join by shuffle,
    where adaptive execution splits skewed partitions of the fact side.
    """
    measured = dimension.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
    rows, size = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(dimension)
    return dimension


def settled(keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A table of keys computed now: None where it has no row, broadcast rows up to the bound, itself above.

    Joining it does not compute it again as long as it is small.
    """
    rows = keys.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return keys
    return F.broadcast(keys.sparkSession.createDataFrame(rows, keys.schema)) if rows else None


def with_category(targets: DataFrame, categories: DataFrame) -> DataFrame:
    """Inner lookup of ``class_index``."""
    return targets.join(small_or_shuffled(categories), "class_index")


def unknown_classes(targets: DataFrame, categories: DataFrame) -> DataFrame:
    return targets.join(small_or_shuffled(categories.select("class_index").distinct()), "class_index", "left_anti")


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only (multiset difference both ways), tagged with the side.

    Both sides are summed once, in tasks of about ROWS_A_TASK rows however large the sides are.
    """
    names = left.columns
    both = left.withColumn("_more", F.lit(1)).union(right.withColumn("_more", F.lit(-1)))
    tasks = 1 + (left.count() + right.count()) // ROWS_A_TASK
    counted = both.repartition(tasks, *names).groupBy(*names).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    sided = counted.select(*names, F.expr("if(_more > 0, 'left', 'right')").alias("side"), F.abs("_more").alias("_more"))
    # A row comes as often as it is missing, in runs, so that no array is long.
    runs = sided.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_more - 1) DIV {RUN})")))
    return runs.withColumn("_run", F.explode(F.expr(f"sequence(1L, least({RUN}L, _more - _run * {RUN}))"))).select(*names, "side")
