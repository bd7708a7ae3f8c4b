"""Frame bundles: frames and their descriptions as files, with a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.functions.names import file_name
from framelake.functions.records import frame_metadata
from framelake.operators.artifacts import tree_digest
from framelake.operators.rules import RuleViolation, fail_if_any
from framelake.operators.windows import contiguity, global_index
from framelake.sources.bundles import CLAIM, LIST_SCHEMA, MANIFEST, RECEIPTS, FrameBundle, put, remove
from framelake.sources.paths import claim, qualified, resolve

SCHEMA_VERSION = "1.0"
METADATA_TYPE = (
    "duration_ns bigint, index bigint, meta_kinds array<string>, pts_ns bigint, size_bytes bigint, "
    "video struct<format: string, height: int, width: int>"
)


class NoBundle(FileNotFoundError):
    """There is no finished bundle at a path."""


def source_folder(source: Column) -> Column:
    """Folder of a source inside a bundle: the file's name behind a digest of the whole path, so that equal names do not meet."""
    plain = F.regexp_replace(F.coalesce(file_name(source), F.lit("")), "[^A-Za-z0-9._-]", "_")
    return F.concat(F.substring(F.sha2(source, 256), 1, 16), F.lit("-"), F.substring(plain, 1, 64))


def members_of(
    frames: DataFrame, kinds: dict[str, Column] | None = None, pts_ns: Column | None = None, duration_ns: Column | None = None, pixel_format: str = "GRAY8"
) -> DataFrame:
    """Rows of the bundle writer: frames (source, frame_id, width, height, pixels) with their description as JSON."""
    nothing = F.lit(None).cast("bigint")
    described = frame_metadata(
        F.col("frame_id").cast("bigint"),
        nothing if pts_ns is None else pts_ns,
        nothing if duration_ns is None else duration_ns,
        F.col("width").cast("int"),
        F.col("height").cast("int"),
        F.lit(pixel_format),
        F.octet_length("pixels").cast("bigint"),
        kinds or {},
    )
    return frames.select(
        "source",
        F.col("frame_id").cast("bigint").alias("frame_id"),
        source_folder(F.col("source")).alias("folder"),
        F.to_json(described, {"ignoreNullFields": "false"}).alias("metadata"),
        "pixels",
    )


def write_bundle(members: DataFrame, path: str, described: dict | None = None) -> dict:
    """Write a bundle below a path that holds none yet; returns its manifest.

    Members are written by tasks, checked as a table (each frame once, ids of every source 0 to n-1), and named by a
    manifest that appears last: without it there is no bundle. Where anything fails, all that was written is removed. Of two writers
    only the one that claims the path first goes on. ``described`` (request, run, sensor) goes into the manifest.
    """
    spark = members.sparkSession
    spark.dataSource.register(FrameBundle)
    root = qualified(spark, path)
    if not claim(spark, f"{root}/{CLAIM}"):
        raise FileExistsError(f"a bundle exists, or is being written, at {path}")
    try:
        members.write.format("framebundle").mode("append").save(root)
        manifest = _manifest(spark, root, described or {})
        filesystem, inner = resolve(root)
        put(filesystem, f"{inner}/{MANIFEST}", json.dumps(manifest, sort_keys=True, indent=1).encode())
    except BaseException:
        remove(root)
        raise
    return manifest


def _listed(spark: SparkSession, root: str) -> DataFrame:
    filesystem, inner = resolve(root)
    with filesystem.open_input_stream(f"{inner}/{RECEIPTS}") as stream:
        lists = [f"{root}/{r['name']}" for r in json.loads(stream.read()) if r["members"]]
    if not lists:
        return spark.createDataFrame([], LIST_SCHEMA)
    return spark.read.schema(LIST_SCHEMA).json(lists)


def _manifest(spark: SparkSession, root: str, described: dict) -> dict:
    listed = _listed(spark, root)
    twice = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    fail_if_any(twice, "a frame is in the bundle twice")
    fail_if_any(contiguity(listed).where(~F.col("contiguous")), "frame ids are not contiguous from 0")
    sources = source_summaries(listed)
    kept = f"{root}/sources"
    sources.write.mode("errorifexists").json(kept)
    sources = spark.read.schema(sources.schema).json(kept)
    sums = sources.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frames"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    if sums["frames"] == 0:
        raise RuleViolation("a bundle needs at least one frame")
    ends = {n: sources.orderBy(F.desc("source") if n == "last" else "source").select(f"{n}_frame_metadata").first()[0] for n in ("first", "last")}
    return {
        "schema_version": SCHEMA_VERSION,
        **described,
        "source_count": sums["sources"],
        "frame_count": sums["frames"],
        "size_bytes": sums["bytes"],
        "sha256": bundle_sha256(sources),
        "first_frame_metadata": json.loads(ends["first"]),
        "last_frame_metadata": json.loads(ends["last"]),
    }


def source_summaries(listed: DataFrame) -> DataFrame:
    """One row per source: frames, bytes, digest over its members in frame order, description of its first and last frame."""
    sums = listed.groupBy("source").agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.sum("size_bytes").alias("size_bytes"),
        F.min_by("metadata", "frame_id").alias("first_frame_metadata"),
        F.max_by("metadata", "frame_id").alias("last_frame_metadata"),
    )
    # A member counts with its pixels and its description.
    digest = F.sha2(F.concat_ws(":", "sha256", "metadata"), 256)
    return sums.join(tree_digest(listed.withColumn("digest", digest), "frame_id", "digest", ["source"]), "source")


def bundle_sha256(sources: DataFrame) -> str:
    """Digest of the whole bundle: of its sources' digests in order of the sources."""
    keyed = sources.select("source", F.sha2(F.concat_ws(":", file_name(F.col("source")), "bundle_sha256"), 256).alias("digest"))
    return tree_digest(global_index(keyed, ["source"]), "index", "digest").first()["bundle_sha256"]


def read_manifest(spark: SparkSession, path: str) -> dict:
    filesystem, inner = resolve(qualified(spark, path))
    try:
        with filesystem.open_input_stream(f"{inner}/{MANIFEST}") as stream:
            return json.loads(stream.read())
    except FileNotFoundError as error:
        raise NoBundle(path) from error


def bundle_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of a finished bundle: source, frame, name, size, digest and the parsed description."""
    read_manifest(spark, path)
    listed = _listed(spark, qualified(spark, path))
    return listed.withColumn("metadata", F.from_json("metadata", StructType.fromDDL(METADATA_TYPE)))


def bundle_sources(spark: SparkSession, path: str) -> DataFrame:
    read_manifest(spark, path)
    kinds = "source string, frame_count bigint, size_bytes bigint, first_frame_metadata string, last_frame_metadata string, bundle_sha256 string"
    return spark.read.schema(kinds).json(f"{qualified(spark, path)}/sources")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Members whose file is missing or has another size or digest than the manifest says; empty for a sound bundle."""
    members = bundle_members(spark, path)
    root = qualified(spark, path)

    def check(batches):
        import hashlib

        filesystem, inner = resolve(root)
        for batch in batches:
            found = []
            for name, size, sha in zip(batch["name"], batch["size_bytes"], batch["sha256"], strict=True):
                try:
                    with filesystem.open_input_stream(f"{inner}/{name}") as stream:
                        data = stream.read()
                    found.append("ok" if len(data) == size and hashlib.sha256(data).hexdigest() == sha else "changed")
                except FileNotFoundError:
                    found.append("missing")
            yield batch.assign(status=found)[["name", "status"]]

    return members.select("name", "size_bytes", "sha256").mapInPandas(check, "name string, status string").where("status <> 'ok'")


__all__ = ["NoBundle", "bundle_members", "bundle_sources", "members_of", "read_manifest", "verify_bundle", "write_bundle"]
