"""Line windows, ordinals and sequence checks.

No operator here sorts a whole source in one task: work is keyed by (source, block) where a
block spans a fixed number of lines, and only per-block totals are combined per source.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import GROUP_LINES
from framelake.operators.lookup import settled
from framelake.session import cut_lineage

BLOCK_LINES = 65536


def frame_ids(position: Column, height: int, stride: int) -> Column:
    """Ids of all frames [k*stride, k*stride + height) that cover a line; may be empty."""
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((position - height) / stride) + 1)
    last = F.floor(position / stride)
    return F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )


def assign_frames(lines: DataFrame, height: int, stride: int, line: str = "line") -> DataFrame:
    """One row per (line, covering frame). Only ids multiply: keep wide columns out of it."""
    return lines.withColumn("frame_id", F.explode(frame_ids(F.col(line), height, stride)))


def frame_count(n_lines: Column, stride: int) -> Column:
    return F.ceil(n_lines / stride).cast("bigint")


def window_summary(
    lines: DataFrame,
    height: int,
    stride: int,
    sample: Column,
    keys: tuple[str, ...] = ("source",),
) -> DataFrame:
    """Lines, valid lines, first and last complete telemetry sample of every frame.

    ``lines`` has keys, ``line``, ``source_lines`` (lines in the source), ``valid`` and
    ``nibble``. A sample begins at a valid line with nibble 0 and needs its whole 16-line
    group inside the window. Lines are first reduced to panes (greatest common divisor of
    height and stride), so the overlap of windows multiplies panes, not lines. Only numbers
    are aggregated (hash aggregation, no sort); the two samples of a frame are then fetched by
    line from the group starts, one line in sixteen.
    """
    pane_lines = gcd(height, stride)
    line, end_of_group = F.col("line"), F.col("line") + GROUP_LINES
    begins = F.col("valid") & (F.col("nibble") == 0) & (end_of_group <= F.col("source_lines"))
    frame_keys = [*keys, "frame_id"]

    pane = F.floor(line / pane_lines)
    any_at = F.when(begins, line)
    own_at = F.when(begins & (end_of_group <= (pane + 1) * pane_lines), line)
    panes = lines.groupBy(*keys, pane.alias("pane")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("valid").alias("n_valid"),
        F.min(any_at).alias("first_any"),
        F.max(any_at).alias("last_any"),
        F.min(own_at).alias("first_own"),
        F.max(own_at).alias("last_own"),
    )
    per_frame = panes.withColumn("frame_id", F.explode(frame_ids(F.col("pane") * pane_lines, height, stride)))
    # In the last pane of a window only groups that end in that pane are complete.
    closing = (F.col("pane") + 1) * pane_lines >= F.col("frame_id") * stride + height
    counts = [F.sum("n_lines").alias("n_lines"), F.sum("n_valid").alias("n_valid")]
    if pane_lines < GROUP_LINES:
        # Groups cross panes: only the ids of group starts meet their frames.
        starts = assign_frames(lines.where(begins).select(*keys, "line"), height, stride)
        fits = starts.where(end_of_group <= F.col("frame_id") * stride + height).groupBy(*frame_keys)
        ends = fits.agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
        frames = per_frame.groupBy(*frame_keys).agg(*counts).join(ends, frame_keys, "left")
    else:
        first = F.when(closing, F.col("first_own")).otherwise(F.col("first_any"))
        last = F.when(closing, F.col("last_own")).otherwise(F.col("last_any"))
        frames = per_frame.groupBy(*frame_keys).agg(*counts, F.min(first).alias("first_line"), F.max(last).alias("last_line"))

    samples = lines.where(begins).select(*keys, "line", F.struct(line.alias("line"), sample.alias("sample")).alias("_point"))
    for at, name in (("first_line", "window_start"), ("last_line", "window_end")):
        frames = frames.join(samples.withColumnsRenamed({"line": at, "_point": name}), [*keys, at], "left")
    return frames.select(*frame_keys, "n_lines", "n_valid", "window_start", "window_end")


def compact_rows(
    lines: DataFrame, height: int, stride: int, keys: tuple[str, ...] = ("source",)
) -> DataFrame:
    """Output row of every valid line in every frame that covers it.

    Invalid lines take no row, so the row is the rank among valid lines of the frame: rank
    inside the line's pane plus the valid lines in earlier panes of the same frame. Both
    rankings work on groups bounded by the pane and the frame height.
    """
    pane_lines = gcd(height, stride)
    valid = lines.where("valid").withColumn("pane", F.floor(F.col("line") / pane_lines))
    in_pane = Window.partitionBy(*keys, "pane").orderBy("line")
    ranked = valid.withColumn("pane_row", F.row_number().over(in_pane).cast("bigint") - 1)
    totals = valid.groupBy(*keys, "pane").agg(F.count(F.lit(1)).alias("pane_valid"))
    earlier = (
        Window.partitionBy(*keys, "frame_id").orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        totals.withColumn("frame_id", F.explode(frame_ids(F.col("pane") * pane_lines, height, stride)))
        .withColumn("frame_row", F.coalesce(F.sum("pane_valid").over(earlier), F.lit(0)))
        .select(*keys, "pane", "frame_id", "frame_row")
    )
    return (
        ranked.join(offsets, [*keys, "pane"])
        .withColumn("out_row", F.col("frame_row") + F.col("pane_row"))
        .drop("pane", "pane_row", "frame_row")
    )


def look_ahead(
    lines: DataFrame,
    value: str,
    distances: tuple[int, ...],
    keys: tuple[str, ...] = ("source",),
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """``value`` of the line ``d`` lines further on, for every ``d``; null past the end.

    Each block borrows a halo of max(d) lines from its follower, so one shuffle on
    (source, block) suffices and no task sees more than block + halo lines.
    """
    halo = max(distances)
    block = F.floor(F.col("line") / block_lines)
    home = F.struct(block.alias("block"), F.lit(True).alias("own"))
    lent = F.struct((block - 1).alias("block"), F.lit(False).alias("own"))
    borrowed = (F.col("line") % block_lines < halo) & (block > 0)
    placed = lines.withColumn(
        "_place", F.explode(F.when(borrowed, F.array(home, lent)).otherwise(F.array(home)))
    ).withColumn("_block", F.col("_place.block"))
    window = Window.partitionBy(*keys, "_block").orderBy("line")
    result = placed
    for distance in distances:
        frame = window.rangeBetween(distance, distance)
        result = result.withColumn(f"{value}_{distance}", F.first(value).over(frame))
    return result.where("_place.own").drop("_place", "_block")


def sequence_number(
    df: DataFrame,
    keys: tuple[str, ...],
    order: str,
    name: str,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """0-based position by an integer order column that is unique within a key.

    Rank inside a block of order values, plus the rows of earlier blocks. A key holding a
    third of the data spreads over its blocks; only block totals meet per key.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_lines))
    totals = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.withColumn("_rank", F.row_number().over(inside).cast("bigint") - 1)
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_rank"))
        .drop("_block", "_before", "_rank")
    )


def global_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """0-based position in a total order, without a single-task sort.

    Rows are range partitioned and sorted, then fixed by a reliable checkpoint so that
    positions cannot shift when a lost partition is computed again. The offsets table has
    one row per partition, which bounds the broadcast.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    chunk = F.shiftright("_at", 33)
    sizes = placed.groupBy(chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_chunk", chunk)
        .join(F.broadcast(offsets), "_chunk")
        .withColumn(name, F.col("_before") + inside)
        .drop("_chunk", "_before", "_at")
    )


def crowded_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys of more than ``limit`` rows, counted now; None where there are none."""
    return settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys))


def bounded_ordinals(
    df: DataFrame, keys: list[str], order: list[str], limit: int, name: str = "target_index", crowded: DataFrame | None | bool = True
) -> DataFrame:
    """0-based ordinal inside each frame, for frames of at most ``limit`` rows.

    Larger frames are over the record limit and are rejected as a whole: all their rows come back with ``over_limit`` set
    and no ordinal. Frames are counted first (pre-aggregated; pass ``crowded`` where that was done); then the rows are read
    once. Crowded ones spread over a salt in the window, so a hot frame is never gathered.
    """
    crowded = crowded_keys(df, keys, limit) if crowded is True else crowded
    ordinal = F.row_number()
    if crowded is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({"over_limit": F.lit(False), name: ordinal.over(window).cast("bigint") - 1})
    marked = df.join(crowded.withColumn("over_limit", F.lit(True)), keys, "left").withColumn("over_limit", F.coalesce("over_limit", F.lit(False)))
    salt = F.when(F.col("over_limit"), F.xxhash64(*order)).otherwise(F.lit(0))
    placed = ordinal.over(Window.partitionBy(*keys, salt).orderBy(*order)).cast("bigint") - 1
    return marked.withColumn(name, F.when(~F.col("over_limit"), placed))


def first_ranked(df: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """Best ``limit`` rows of each group (top-k before suppression, or the record cap)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def _distinct_ids(df: DataFrame, keys: tuple[str, ...], frame: str) -> DataFrame:
    return df.groupBy(*keys, F.col(frame).cast("bigint").alias("frame_id")).agg(
        F.count(F.lit(1)).alias("copies")
    )


def contiguity(df: DataFrame, keys: tuple[str, ...] = ("source",), frame: str = "frame_id") -> DataFrame:
    """Per key: is the set of frame ids exactly 0, 1, .., n-1, each once?"""
    grouped = (
        _distinct_ids(df, keys, frame)
        .groupBy(*keys)
        .agg(
            F.min("frame_id").alias("first_id"),
            F.max("frame_id").alias("last_id"),
            F.count(F.lit(1)).alias("n_ids"),
            F.sum("copies").alias("n_rows"),
        )
    )
    ok = (
        (F.col("first_id") == 0)
        & (F.col("last_id") == F.col("n_ids") - 1)
        & (F.col("n_ids") == F.col("n_rows"))
    )
    return grouped.withColumn("contiguous", ok)


def gaps(
    df: DataFrame,
    keys: tuple[str, ...] = ("source",),
    frame: str = "frame_id",
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Every hole in the frame ids of a key as (after_id, next_id); a late start has after_id -1."""
    ids = _distinct_ids(df, keys, frame).withColumn("_block", F.floor(F.col("frame_id") / block_lines))
    inside = Window.partitionBy(*keys, "_block").orderBy("frame_id")
    within = (
        ids.withColumn("after_id", F.lag("frame_id").over(inside))
        .where(F.col("frame_id") - F.col("after_id") > 1)
        .select(*keys, "after_id", F.col("frame_id").alias("next_id"))
    )
    edges = ids.groupBy(*keys, "_block").agg(F.min("frame_id").alias("next_id"), F.max("frame_id").alias("_max"))
    between = (
        edges.withColumn(
            "after_id",
            F.coalesce(F.lag("_max").over(Window.partitionBy(*keys).orderBy("_block")), F.lit(-1)),
        )
        .where(F.col("next_id") - F.col("after_id") > 1)
        .select(*keys, "after_id", "next_id")
    )
    return within.unionByName(between)
