"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.session import scratch_path

MIX = np.uint64(0x9E3779B97F4A7C15)
ARROW_BYTES = 4 << 20
#: Bits of the filter of ``told_apart``: so many for each listed row, in blocks of one bitmap, 8 MB in all at most.
FILTER_SHARE, FILTER_BLOCK, FILTER_BITS = 32, 1 << 15, 1 << 26


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that sums and high bits behave like hashes."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def as_bytes(text: str | Column) -> Column:
    """The text as UTF-8 bytes, empty where it is null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told_apart(rows: DataFrame, listed: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that surely are not in ``listed`` (a stored table) by ``columns``, and all others.

    For joins of long rows with a list that holds a small part of them: only the others need a shuffle and the exact join. A
    bitmap of hashes of the list tells them apart. Its size is bounded; a list too long for it makes the others more, never wrong.
    """
    bits = FILTER_BLOCK
    wanted = min(FILTER_BITS, FILTER_SHARE * listed.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    block, bit = F.floor(place / FILTER_BLOCK).alias("_block"), F.pmod(place, F.lit(FILTER_BLOCK))
    maps = listed.select(block, bit.alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    maps = stored(maps, "filter")
    met = rows.withColumns({"_block": block, "_bit": bit}).join(F.broadcast(maps), "_block", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_bit DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    return met.where(~maybe).select(rows.columns), met.where(maybe).select(rows.columns)


def over_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows through ``function`` in batches of about ARROW_BYTES: a task holds several copies of one, in the JVM and in Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def row_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bucket_count(rows: int, per_bucket: int = 50_000, least: int = 16) -> int:
    """A power of two that leaves about ``per_bucket`` rows in each bucket of an even hash."""
    return 1 << max((least - 1).bit_length(), int(rows // per_bucket).bit_length())


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Row number from 0 within ``group``, never holding a whole group in one task.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside (group, bucket); buckets get their start
    from a running sum over one row per (group, bucket). Group columns must not be null.
    """
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_bucket", bucket)
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - F.lit(1).cast("long"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return local.join(starts, keys).withColumn(name, F.col(name) + F.col("_start")).drop("_bucket", "_start")


class RecentCache:
    """A dictionary of bounded size: when the young half is full it becomes the old half."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node of an edge.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its smallest one, then
    its smaller ones. Rounds grow with the logarithm of the longest chain. Each round is written to the shared folder;
    only one number per round reaches the driver.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), label
    )
    seen = None
    while True:
        both = now.select("node", "root").union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        large = large.distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node")
        small = small.select("node", F.col("least").alias("root")).union(small.select(F.col("root").alias("node"), F.col("least").alias("root")))
        now = stored(small.where("node <> root").distinct(), label)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first())
        if state == seen:
            return now
        seen = state


def hashed_words(words: list[bytes], cache: RecentCache, digest: Callable[[bytes], int]) -> np.ndarray:
    """64-bit hash of each word, remembered between texts."""
    young, out = cache.young, []
    for word in words:
        h = young.get(word)
        if h is None:
            h = cache.get(word)
            if h is None:
                h = digest(word)
                cache.put(word, h)
            young = cache.young
        out.append(h)
    return np.array(out, np.uint64)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one stay within ``limit`` bytes, or are a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)], np.int64)
        part = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def flat_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of a column of texts in one list, with the first place and the number of words of each text."""
    words: list[bytes] = []
    counts = []
    for value in column:
        found = value.as_py().split()
        counts.append(len(found))
        words += found
    counts = np.array(counts, np.int64)
    return words, np.cumsum(counts) - counts, counts


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values; wraps modulo 2**64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n]
    return mixed(total)
