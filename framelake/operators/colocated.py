"""Frame tables kept by frame, so that their rows join without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from framelake.session import scratch_path

FRAME_KEYS = ("source", "frame_id")


def write_by_frame(df: DataFrame, name: str, path: str, buckets: int, keys: tuple[str, ...] = FRAME_KEYS) -> DataFrame:
    """Write a table in ``buckets`` files by the hash of the frame keys, each sorted by them; read it back.

    The one shuffle of a table's life: later joins and aggregations by frame need none. Tables that are to meet must have
    the same number of buckets. A frame lies in one bucket, and no key is a source alone, so a large source is spread.
    """
    placed = df.repartition(buckets, *keys)
    placed.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def by_frame(tables: dict[str, DataFrame], buckets: int | None = None, keys: tuple[str, ...] = FRAME_KEYS) -> dict[str, DataFrame]:
    """``write_by_frame`` for several tables, in the shared folder under new names; by default as many buckets as shuffle partitions."""
    found = {}
    for name, df in tables.items():
        spark = df.sparkSession
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        found[name] = write_by_frame(df, f"{name}_{uuid.uuid4().hex}", scratch_path(spark, name), count, keys)
    return found


def frame_rows(frames: DataFrame, geometry: DataFrame, telemetry: DataFrame, targets: DataFrame, keys: tuple[str, ...] = FRAME_KEYS) -> DataFrame:
    """One row per target with the columns of its frame, geometry and telemetry; a frame that lacks one of the four has none.

    Merge joins on the frame keys: tables written ``by_frame`` are read bucket by bucket, others are shuffled first. Rows
    with a null key meet nothing. Columns besides the keys must have different names in the four tables.
    """
    sides = [frames, geometry, telemetry, targets]
    names = [c.lower() for side in sides for c in side.columns if c not in keys]
    if len(names) != len(set(names)):
        raise ValueError(f"columns of several tables: {sorted({c for c in names if names.count(c) > 1})}")
    joined = sides[0]
    for side in sides[1:]:
        joined = joined.join(side.hint("merge"), list(keys))
    return joined
