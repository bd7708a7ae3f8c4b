"""Exact deduplication as a stream with disk-backed keyed state."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import documents, stored, told_apart
from framelake.session import scratch_path

#: State lives in RocksDB on the executors' disks and in the stream's checkpoint in the shared folder.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each of the many small stores reserves 4 MB of disk for its manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BATCH_BYTES = 8 << 30
SALTS = 16


def normalised(text: str = "text"):
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_stream(arrivals: DataFrame, checkpoint: str) -> DataFrame:
    """Feed new (digest, doc_id, locator) rows of a stream into the state and return the whole state as a table.

    One state row per digest: the row with the smallest id, its locator, and the number of rows seen. The state never
    expires, and a later call with the same checkpoint goes on where the last one ended.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, STATE_CONF):
        writer = state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        writer.option("checkpointLocation", checkpoint).start().awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
        first, count = held.schema["value"].dataType.fieldNames()
        return held.select(
            F.col("key.digest").alias("digest"),
            F.col(f"value.`{first}`.doc_id").alias("keep_id"),
            F.col(f"value.`{first}`.locator").alias("locator"),
            F.col(f"value.`{count}`").alias("group_size"),
        )


def stream_dedup(docs: DataFrame, text: str = "text", digest_bytes: int = 32, checkpoint: str | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept. Equal texts keep the row with the smallest id.

    Digests of all rows are appended to a table of arrivals in the shared folder, which a stream reads into keyed state.
    A digest seen again is only a hit: the full bytes of all rows of hit digests are then compared, by grouping them on the
    text itself (salted, pre-aggregated before the shuffle). Should texts differ under one digest (tests use short
    digests), their rows are told apart by text.

    Null texts count as empty, and all empty texts are equal. Rows that repeat an id are members of a group like any
    other; each comes back as its own row, and ``kept`` is true for one id per group. A null id is never smaller than
    another, and is kept only if its group has no other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.unhex(F.substring(F.sha2(F.col("norm"), 256), 1, 2 * digest_bytes))
    rows = docs.select(F.col("doc_id"), normalised(text).alias("norm"), F.input_file_name().alias("locator"))
    rows = rows.withColumn("digest", key)
    path = scratch_path(spark, "arrivals")
    # A null id sorts first in a minimum; the largest long stands in for it.
    arrived = rows.select("digest", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "locator", F.sha2("norm", 256).alias("sha256"))
    arrived.write.parquet(path)
    arrivals = spark.read.schema(arrived.schema).parquet(path)
    stream = spark.readStream.schema(arrived.schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(path)
    state = stored(run_stream(stream, checkpoint or scratch_path(spark, "dedup-state")), "dedup-groups")

    again = stored(state.where("group_size > 1").select("digest"), "dedup-hits")
    hits = again.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = told_apart(rows.drop("locator"), again, ["digest"])[1].withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    held = held.join(hits, ["digest", "salt"], "left_semi").withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    whole = held.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    whole = whole.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    whole = stored(whole.withColumn("sha256", F.sha2("norm", 256)).drop("norm"), "dedup-checked")
    clashing = whole.groupBy("digest").count().where("count > 1").select("digest")

    columns = ["doc_id", "digest", "keep_id", "group_size", "sha256"]
    if clashing.isEmpty():
        out = arrivals.drop("locator").join(state.drop("locator"), "digest").select(*columns)
    else:
        plain = arrivals.drop("locator").join(clashing, "digest", "left_anti")
        plain = plain.join(state.drop("locator"), "digest").select(*columns)
        apart = rows.join(clashing, "digest", "left_semi").withColumn("sha256", F.sha2("norm", 256))
        apart = apart.withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
        out = plain.union(apart.join(whole, ["digest", "sha256"]).select(*columns))
    null_id = lambda c: F.nullif(F.col(c), F.lit(2**63 - 1)).alias(c)
    return out.select(null_id("doc_id"), null_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def op4_stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return stream_dedup(documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY norm)"""
