"""Small JSON documents as tables: profile registry, category maps, requests, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STEP_TYPE = "struct<factory: string, role: string, properties: map<string, string>>"
PROFILE_TYPE = (
    "struct<evidence_class: string, sensor_id: string, acquisition_mode: string, output_mode: string, "
    "filter_backend: string, category_map: string, max_frames: bigint, timeout_sec: bigint, "
    f"source: {STEP_TYPE}, geometry: {STEP_TYPE}, filter: {STEP_TYPE}>"
)
REGISTRY_TYPE = f"struct<schema_version: string, profiles: map<string, {PROFILE_TYPE}>>"
CATEGORY_TYPE = "struct<id: string, classes: array<struct<index: bigint, type: string>>>"


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, document)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")
    )


def profiles_of(documents: DataFrame, document: str = "document") -> DataFrame:
    """Registry documents to one row per profile."""
    parsed = documents.select(F.from_json(document, REGISTRY_TYPE).alias("r"))
    return parsed.select(F.explode("r.profiles").alias("profile_id", "p")).select("profile_id", "p.*")


def categories_of(documents: DataFrame, document: str = "document") -> DataFrame:
    """Category maps to (mapping_id, class_index, type); a later repeat of an index wins.

    A map without id or classes, or a class without index or type, fails the job.
    """
    parsed = documents.select(F.from_json(document, CATEGORY_TYPE).alias("m"))
    # Both checks sit in the exploded value, so a map without classes cannot slip through.
    incomplete = F.col("m.id").isNull() | F.col("m.classes").isNull()
    classes = F.when(incomplete, F.raise_error(F.lit("category map is missing id or classes"))).otherwise(
        F.col("m.classes")
    )
    rows = parsed.select(F.col("m.id").alias("mapping_id"), F.posexplode(classes).alias("place", "c"))
    return rows.groupBy(
        "mapping_id", _required("c.index", "category map class is missing its index").alias("class_index")
    ).agg(F.max_by(_required("c.type", "category map class is missing its type"), "place").alias("type"))


def _required(name: str, message: str) -> Column:
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(message))).otherwise(F.col(name))


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return profiles_of(json_documents(spark, path))


def load_category_map(spark: SparkSession, path: str) -> DataFrame:
    return categories_of(json_documents(spark, path))


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path)


def read_products(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Product records written as JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
