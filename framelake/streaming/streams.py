"""Incremental twins of the sequence and uniqueness checks.

Rows are reduced in the tasks that read them (to runs of ids, to counts), so a source with most of the rows sends a few
rows per task to its state. State is bounded: intervals instead of ids, one number per source, tracks of open frames only.
Results go to a folder per batch id, overwritten when a batch is repeated, so that a failed and restarted query leaves the
same tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from framelake.operators.rules import RuleViolation, fail_if_any
from framelake.operators.windows import sequence_number
from framelake.sources.paths import claim, qualified

# State of the Python operators lives in RocksDB on the executors' disks and in the stream's checkpoint.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Where state expires by the clock, batches without data would follow each other for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
SNAPSHOT_EVERY = 16


def read_files(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive; ``files_per_trigger`` bounds what one batch takes in."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is available in batches, then stop (end of stream)."""
    for key, value in STATE_CONF.items():
        stream.sparkSession.conf.set(key, value)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def to_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that writes each batch to its own folder, replacing a partial one."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(path, batch))

    return write


class KeyedTable:
    """Values per key below a path: each batch writes the keys it changed, every SNAPSHOT_EVERY batches all are written once.

    Reading takes the last snapshot and the changes behind it, however many batches there were. A batch that is repeated
    replaces what it wrote.
    """

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def _read(self, spark: SparkSession, kind: str, wanted: Callable[[int], bool]) -> DataFrame | None:
        try:
            rows = spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException:  # nothing was written yet
            return None
        batches = [f for f in rows.select("batch").distinct().collect() if wanted(f["batch"])] if kind == "snapshots" else None
        if batches is not None:
            last = max((f["batch"] for f in batches), default=None)
            return None if last is None else rows.where(F.col("batch") == last)
        return rows

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """Value of every key, from batches before a given one; None where nothing was written."""
        early = lambda batch: before is None or batch < before
        snapshot = self._read(spark, "snapshots", early)
        since = -1 if snapshot is None else snapshot.first()["batch"]
        changes = self._read(spark, "changes", early)
        if changes is not None:
            changes = changes.where((F.col("batch") > since) & (F.lit(True) if before is None else F.col("batch") < before))
        parts = [p for p in (snapshot, changes) if p is not None]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        values = [c for c in rows.columns if c not in (*self.keys, "batch")]
        newest = F.max_by(F.struct(*values), "batch").alias("v")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "v.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(f"{self.path}/changes", batch))
        if (batch + 1) % SNAPSHOT_EVERY == 0:
            self.read(rows.sparkSession, batch + 1).write.mode("overwrite").parquet(batch_folder(f"{self.path}/snapshots", batch))


def to_table(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch handler of an update stream: keeps the last value of every key."""
    return KeyedTable(path, keys).write


# ---- contiguity of frame ids --------------------------------------------------------------------


def id_runs(stream: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Runs of consecutive ids in what a task reads, as (keys, first, last, n); an id that is there n > 1 times is a run of its own."""
    rows = stream.select(*keys, F.col(frame).cast("bigint").alias("first")).where("first IS NOT NULL")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for key, group in batch.groupby(keys, dropna=False, sort=False):
                ids, n = np.unique(group["first"].to_numpy(), return_counts=True)
                cut = np.flatnonzero((np.diff(ids) != 1) | (n[1:] > 1) | (n[:-1] > 1)) + 1
                starts, ends = np.append(0, cut), np.append(cut, len(ids)) - 1
                runs = {"first": ids[starts], "last": ids[ends], "n": np.add.reduceat(n, starts)}
                parts.append(pd.DataFrame({**dict(zip(keys, key, strict=True)), **runs}))
            if parts:
                yield pd.concat(parts)

    types = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(reduce, f"{types}, first bigint, last bigint, n bigint")


def merged_intervals(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last) of the union of closed intervals, and (first, last) of what lies in more than one of them."""
    if not len(first):
        return first, last, first, last
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    so_far = np.maximum.accumulate(last)
    before = np.append(np.iinfo(np.int64).min // 2, so_far[:-1])
    starts = np.flatnonzero(first > before + 1)
    again = first <= before
    return first[starts], so_far[np.append(starts[1:], len(first)) - 1], first[again], np.minimum(last, before)[again]


ID_BLOCK = 65536


def pack_ids(there: np.ndarray) -> bytes:
    """Ids of one block as intervals (pairs of 16 bits), or as a bitmap where that is shorter."""
    edges = np.flatnonzero(np.diff(there, prepend=False, append=False))
    if 2 * len(edges) < ID_BLOCK // 8:
        return (edges.reshape(-1, 2) - [0, 1]).astype("<u2").tobytes()
    return np.packbits(there).tobytes()


def unpack_ids(data: bytes | None) -> np.ndarray:
    if data is not None and len(data) == ID_BLOCK // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    there = np.zeros(ID_BLOCK, bool)
    for first, last in np.frombuffer(data or b"", "<u2").reshape(-1, 2).tolist():
        there[first : last + 1] = True
    return there


class _Block:
    """Ids of one block while a batch adds to them."""

    def __init__(self, held: bytes | None):
        self.there = unpack_ids(held)
        self.before = self._shape()

    def _shape(self) -> tuple[bool, bool, int, int]:
        """(is the first id there, the last one, intervals, ids)"""
        there = self.there
        return bool(there[0]), bool(there[-1]), int(there[0]) + int((there[1:] & ~there[:-1]).sum()), int(there.sum())

    def add(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add closed intervals; (first, last) of what was there or is in more than one of them."""
        times = np.bincount(first, minlength=ID_BLOCK + 1) - np.bincount(last + 1, minlength=ID_BLOCK + 1)
        times = np.cumsum(times)[:ID_BLOCK]
        again = (times + self.there) > 1
        again &= times > 0
        self.there |= times > 0
        edges = np.flatnonzero(np.diff(again, prepend=False, append=False))
        return edges[::2], edges[1::2] - 1

    def after(self) -> tuple[bool, bool, int, int]:
        return self._shape()


class IdIntervals(StatefulProcessor):
    """Ids of one source in blocks of ``ID_BLOCK`` ids, as intervals or a bitmap; a batch reads and writes the blocks it has ids of.

    A block takes 8 KB at most, and one interval where it has no hole, so what a batch costs goes with its own ids.
    """

    HELD_BLOCKS = 512

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "first bigint, last bigint, n_ids bigint, n_rows bigint, intervals bigint")
        self.blocks = handle.getMapState("blocks", "block bigint", "ids binary")

    def _stored(self, block: int) -> bytes | None:
        return bytes(self.blocks.getValue((block,))[0]) if self.blocks.containsKey((block,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, _Block] = {}
        low, high, n_ids, n_rows, intervals = self.total.get() if self.total.exists() else (None, None, 0, 0, 0)
        twice = []
        for runs in rows:
            first, last, n = (runs[c].to_numpy(np.int64) for c in ("first", "last", "n"))
            if not len(first):
                continue
            low = int(first.min()) if low is None else min(low, int(first.min()))
            high = int(last.max()) if high is None else max(high, int(last.max()))
            n_rows += int(n.sum())
            many = n > last - first + 1
            twice.append((first[many], last[many]))
            for block, begins, ends in _by_block(first, last):
                if block not in held:
                    if len(held) >= self.HELD_BLOCKS:
                        n_ids, intervals = self._store(held, n_ids, intervals)
                    held[block] = _Block(self._stored(block))
                again, until = held[block].add(begins, ends)
                twice.append((again + block * ID_BLOCK, until + block * ID_BLOCK))
        n_ids, intervals = self._store(held, n_ids, intervals)
        if low is None:
            return
        self.total.update((low, high, n_ids, n_rows, intervals))
        again, until, *_ = merged_intervals(*(np.concatenate(part) for part in zip(*twice, strict=True)))
        row = dict(zip(self.keys, key, strict=True)) | {
            "first_id": low,
            "last_id": high,
            "n_ids": n_ids,
            "n_rows": n_rows,
            "n_holes": intervals - 1,
            "contiguous": low == 0 and intervals == 1 and n_ids == n_rows,
            "repeated": [{"first": a, "last": b} for a, b in zip(again.tolist(), until.tolist(), strict=True)],
        }
        yield pd.DataFrame([row])

    def _store(self, held: dict[int, _Block], n_ids: int, intervals: int) -> tuple[int, int]:
        """Write the blocks and empty ``held``; the totals with what was added. Intervals that meet at a border of blocks are one."""
        shapes = {block: (ids.before, ids.after()) for block, ids in held.items()}
        n_ids += sum(now[3] - old[3] for old, now in shapes.values())
        intervals += sum(now[2] - old[2] for old, now in shapes.values())
        for right in {b for block in shapes for b in (block, block + 1)}:
            for block in (right - 1, right):
                if block not in shapes:
                    there = _Block(self._stored(block)).before
                    shapes[block] = there, there
            (left_old, left_now), (right_old, right_now) = shapes[right - 1], shapes[right]
            intervals -= int(left_now[1] and right_now[0]) - int(left_old[1] and right_old[0])
        for block, ids in held.items():
            self.blocks.updateValue((block,), (pack_ids(ids.there),))
        held.clear()
        return n_ids, intervals

    def close(self) -> None:
        pass


def _by_block(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Closed intervals cut at the borders of blocks: (block, first, last) with places inside the block."""
    spans = last // ID_BLOCK - first // ID_BLOCK + 1
    block = np.repeat(first // ID_BLOCK, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    low = np.maximum(np.repeat(first, spans), block * ID_BLOCK) - block * ID_BLOCK
    high = np.minimum(np.repeat(last, spans), (block + 1) * ID_BLOCK - 1) - block * ID_BLOCK
    order = np.argsort(block, kind="stable")
    block, low, high = block[order], low[order], high[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
        if end > start:
            yield int(block[start]), low[start:end], high[start:end]


def contiguity_stream(stream: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Update stream of the contiguity verdict per key, equal to the batch check at the end of the stream.

    ``repeated`` names the intervals of ids that came again in this batch, however late. The state of a key has an entry
    per block of 65536 ids, short where the block has few holes and 8 KB at most; a batch touches the blocks of its own ids.
    """
    types = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{types}, first_id bigint, last_id bigint, n_ids bigint, n_rows bigint, n_holes bigint, contiguous boolean, repeated array<struct<first: bigint, last: bigint>>"
    return id_runs(stream, keys, frame).groupBy(*keys).transformWithStateInPandas(IdIntervals(keys), outputStructType=out, outputMode="Update", timeMode="None")


# ---- frame numbers --------------------------------------------------------------------------------


def number_batches(path: str, keys: list[str], order: str, name: str = "frame_id") -> Callable[[DataFrame, int], None]:
    """Batch handler that numbers rows per key in arrival order, from 0.

    Numbers continue from the counts of earlier batches, a keyed table beside the output: a batch writes the counts of its
    own keys only. A repeated batch starts from the same counts and writes the same numbers.
    """
    counts = KeyedTable(f"{path}/counts", keys)

    def handle(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            ranked = sequence_number(rows, tuple(keys), order, "_position")
            changed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_new"))
            before = counts.read(rows.sparkSession, batch)
            if before is None:
                before = changed.select(*keys, F.lit(0).cast("bigint").alias("seen")).where("false")
            start = F.coalesce("seen", F.lit(0))
            numbered = ranked.join(before, keys, "left").withColumn(name, F.col("_position") + start)
            numbered.drop("_position", "seen").write.mode("overwrite").parquet(batch_folder(f"{path}/rows", batch))
            counts.write(changed.join(before, keys, "left").select(*keys, (F.col("_new") + start).alias("seen")), batch)
        finally:
            rows.unpersist()

    return handle


# ---- limits and duplicates ---------------------------------------------------------------------------


class FrameCounter(StatefulProcessor):
    """Rows of one source; over its limit the stream fails. Sources that fell silent are forgotten after ``idle_ms``."""

    def __init__(self, keys: list[str], limit: int | None, idle_ms: int):
        self.keys, self.limit, self.idle_ms = keys, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = sum(int(part["n"].sum()) for part in rows) + (self.count.get()[0] if self.count.exists() else 0)
        if self.limit is not None and n > self.limit:
            raise RuleViolation(f"source {key} has {n} frames, more than {self.limit} frames")
        self.count.update((n,))
        yield pd.DataFrame([dict(zip(self.keys, key, strict=True)) | {"frame_count": n}])

    def close(self) -> None:
        pass


def frame_counts(stream: DataFrame, keys: list[str], limit: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Update stream of rows per key. With a ``limit`` the batch that breaks it fails, and so does its repetition.

    The state is one number per key, a streaming aggregate; with ``idle_ms`` it is kept by a stateful operator and goes when a
    key had no rows for so long.
    """
    if idle_ms is None:
        counted = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"))
        if limit is None:
            return counted
        said = F.concat(F.lit("source "), F.to_json(F.struct(*keys)), F.lit(" has "), "frame_count", F.lit(f" frames, more than {limit} frames"))
        return counted.withColumn("frame_count", F.when(F.col("frame_count") > limit, F.raise_error(said)).otherwise(F.col("frame_count")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(keys, dropna=False, sort=False)["n"].sum().reset_index()

    types = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    counted = stream.select(*keys, F.lit(1).cast("bigint").alias("n")).mapInPandas(count, f"{types}, n bigint").groupBy(*keys)
    return counted.transformWithStateInPandas(FrameCounter(keys, limit, idle_ms), outputStructType=f"{types}, frame_count bigint", outputMode="Update", timeMode="ProcessingTime")


def limit_violations(counts: DataFrame, keys: list[str], limit: Column | int) -> DataFrame:
    """First batch in which each key went over its limit."""
    over = counts.where(F.col("frame_count") > limit)
    window = Window.partitionBy(*keys).orderBy("batch")
    return over.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def limited_batches(path: str, keys: list[str], limit: int, count: str = "frame_count") -> Callable[[DataFrame, int], None]:
    """Handler of an update stream of counts: records the batch, then fails the stream if a key is over its limit.

    Unlike a limit in the state operator, the batch that breaks the limit is on record. Later ones are not taken in, and a
    restart fails again.
    """
    table = KeyedTable(path, keys)

    def handle(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            table.write(rows, batch)
            fail_if_any(rows.where(F.col(count) > limit), f"more than {limit} frames")
        finally:
            rows.unpersist()

    return handle


def track_counts(stream: DataFrame, keys: list[str], frame: str, track: str, clock: str, delay: str) -> DataFrame:
    """Update stream of rows per (keys, frame, track) of open frames.

    ``clock`` is the time of a frame, the same for all its rows. A frame is open until rows later by more than ``delay``
    were seen; then its state goes. Rows that come even later are dropped by the watermark (and counted in the query's progress).
    """
    return stream.withWatermark(clock, delay).groupBy(*keys, frame, track, clock).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_batches(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Handler of ``track_counts``: records tracks that are in a frame more than once; most batches write nothing."""
    table = KeyedTable(path, keys)
    return lambda rows, batch: table.write(rows.where("copies > 1").select(*keys, "copies"), batch)


# ---- all or nothing publication ----------------------------------------------------------------------


def publish(spark: SparkSession, staging: str, runs: str, run_id: str) -> None:
    """Mark a finished run. Written once, after the stream ended without error; a second publication of a run id fails."""
    written = spark.read.parquet(staging).agg(F.count(F.lit(1)).alias("rows"))
    status = F.when(F.col("rows") > 0, "completed").otherwise("no_result")
    row = written.select(F.lit(run_id).alias("run_id"), F.lit(staging).alias("path"), status.alias("status"), "rows").first()
    claim_run(spark, runs, run_id)
    spark.createDataFrame([row], "run_id string, path string, status string, rows bigint").coalesce(1).write.mode("append").parquet(runs)


def claim_run(spark: SparkSession, runs: str, run_id: str) -> None:
    """Of all that publish a run id, one gets past this point."""
    safe = re.sub(r"[^A-Za-z0-9.-]", lambda m: f"%{ord(m[0]):x}%", run_id)
    if not claim(spark, f"{qualified(spark, runs)}/_published/_{safe}"):
        raise RuleViolation(f"run {run_id} is published already and exists below {runs}")


def published(spark: SparkSession, runs: str, run_id: str) -> DataFrame | None:
    """Rows of a run, or None while it is not published."""
    found = spark.read.parquet(runs).where((F.col("run_id") == run_id) & (F.col("status") == "completed"))
    paths = [row.path for row in found.select("path").limit(1).collect()]
    return spark.read.parquet(paths[0]) if paths else None
