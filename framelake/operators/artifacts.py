"""Files and products: digests, manifests, reconciliation, run metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DIGEST_FANOUT = 1024
DIGEST_LEVELS = 4
READ_CHUNK = 4 * 1024 * 1024


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Regular files below a folder with their sizes; file content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size_bytes"))
    )


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from framelake.sources.paths import resolve

    for batch in batches:
        digests = []
        for path in batch["path"]:
            filesystem, inner = resolve(path)
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while chunk := stream.read(READ_CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 of each listed file, streamed in chunks: files may exceed a row's size limit."""
    return files.select("path", "size_bytes").mapInPandas(
        _hash_files, "path string, size_bytes bigint, sha256 string"
    )


def reconcile(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of each path: missing, unexpected, duplicate, size, digest or ok.

    Both sides are tagged and grouped by path, which pre-aggregates before the shuffle; a
    path repeated very often does not pile up in a join.
    """
    def side(df: DataFrame, is_manifest: bool) -> DataFrame:
        return df.select("path", "size_bytes", "sha256", F.lit(is_manifest).alias("expected"))

    expected, found = F.col("expected"), ~F.col("expected")
    grouped = (
        side(manifest, True)
        .unionByName(side(actual, False))
        .groupBy("path")
        .agg(
            F.count_if(expected).alias("n_expected"),
            F.count_if(found).alias("n_actual"),
            F.max(F.when(expected, F.col("size_bytes"))).alias("expected_size"),
            F.max(F.when(found, F.col("size_bytes"))).alias("actual_size"),
            F.max(F.when(expected, F.col("sha256"))).alias("expected_sha256"),
            F.max(F.when(found, F.col("sha256"))).alias("actual_sha256"),
        )
    )
    status = (
        F.when(F.col("n_actual") == 0, "missing")
        .when(F.col("n_expected") == 0, "unexpected")
        .when((F.col("n_actual") > 1) | (F.col("n_expected") > 1), "duplicate")
        .when(F.col("expected_size") != F.col("actual_size"), "size")
        .when(F.col("expected_sha256") != F.col("actual_sha256"), "digest")
        .otherwise("ok")
    )
    return grouped.withColumn("status", status)


def tree_digest(
    members: DataFrame, index: str, digest: str, keys: list[str] | None = None, fanout: int = DIGEST_FANOUT
) -> DataFrame:
    """Digest of an ordered set of member digests, as a tree of fixed fan-out.

    Equal members in equal order give an equal root whatever the partitioning, and no task
    sees more than ``fanout`` digests of one node. ``index`` is the contiguous 0-based
    member position. The default fan-out has four levels, enough for 10**12 members; a smaller
    one gets as many as its members need.
    """
    keys = keys or []
    levels = DIGEST_LEVELS
    if fanout < DIGEST_FANOUT:
        last = members.agg(F.max(index)).first()[0] or 0
        while fanout**levels <= last:
            levels += 1
    level = members.select(*keys, F.col(index).cast("bigint").alias("node"), F.col(digest).alias("digest"))
    for _ in range(levels):
        placed = F.sort_array(F.collect_list(F.struct("node", "digest")))
        level = (
            level.withColumn("parent", F.floor(F.col("node") / fanout))
            .groupBy(*keys, "parent")
            .agg(F.sha2(F.array_join(F.transform(placed, lambda m: m["digest"]), ""), 256).alias("digest"))
            .withColumnRenamed("parent", "node")
        )
    return level.select(*keys, F.col("digest").alias("bundle_sha256"))


def frames_per_second(frame_count: Column, wall_seconds: Column) -> Column:
    return F.when(wall_seconds > 0, frame_count / wall_seconds).otherwise(F.lit(0.0))


def run_metrics(frames: DataFrame, size: Column) -> list[Column]:
    """Aggregates of a run: frame count, bytes."""
    return [F.count(F.lit(1)).alias("frame_count"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")]


def observed(frames: DataFrame, size: Column, name: str) -> tuple[DataFrame, Observation]:
    """Collect the run metrics while the job that writes the frames runs, without a second pass."""
    observation = Observation(name)
    return frames.observe(observation, *run_metrics(frames, size)), observation
