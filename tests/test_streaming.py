"""Streams resume where they stopped and repeated batches change nothing."""

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from framelake.functions.binary import MAGIC_HEX, RECORD_BYTES
from framelake.operators.rules import RuleViolation
from framelake.sources.scanlines import FileChangedError, _LineStream, scan_lines, scan_lines_stream
from framelake.streaming import streams


def test_numbering_continues_after_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    handler = streams.number_batches(out, ["source"], "event_id", "n")

    def arrive(low, high):
        spark.range(low, high).selectExpr("CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS source", "id AS event_id").write.mode(
            "append"
        ).parquet(source)
        stream = streams.read_files(spark, source, "source string, event_id bigint")
        streams.run_to_end(stream, str(tmp_path / "state"), handler)

    arrive(0, 40)
    arrive(40, 70)
    rows = spark.read.parquet(f"{out}/rows")
    # The handler of the last batch runs again, as after a failure behind the write.
    repeated = rows.where("batch = 1").select("source", "event_id").collect()
    last = spark.createDataFrame(repeated, "source string, event_id bigint")
    handler(last, 1)
    got = {}
    for row in spark.read.parquet(f"{out}/rows").orderBy("event_id").collect():
        got.setdefault(row.source, []).append(row.n)
    assert got == {"a": list(range(46)), "b": list(range(24))}


def test_limit_violation_names_the_first_batch(spark, tmp_path):
    counts = spark.createDataFrame([("a", 2, 0), ("a", 5, 1), ("a", 9, 2), ("b", 1, 0)], "source string, frame_count bigint, batch int")
    over = streams.limit_violations(counts, ["source"], 4).collect()
    assert [(r.source, r.batch) for r in over] == [("a", 1)]


def test_unpublished_run_is_not_visible(spark, tmp_path):
    staging, runs = str(tmp_path / "staging"), str(tmp_path / "runs")
    spark.range(3).write.parquet(staging)
    streams.publish(spark, staging, runs, "one")
    assert streams.published(spark, runs, "two") is None
    assert streams.published(spark, runs, "one").count() == 3


def test_stream_over_its_limit_fails(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).selectExpr("'a' AS source", "id AS frame_id").coalesce(1).write.mode("append").parquet(source)
    rows = streams.read_files(spark, source, "source string, frame_id bigint", 1)
    for _ in range(2):  # a restart fails again at the same batch
        with pytest.raises(StreamingQueryException, match="more than 15 frames"):
            streams.run_to_end(streams.frame_counts(rows, ["source"]), str(tmp_path / "state"), streams.limited_batches(out, ["source"], 15), "update")
        assert streams.KeyedTable(out, ["source"]).read(spark).first().frame_count == 20
    for _ in range(2):  # the same in the state operator: the batch is not taken in
        with pytest.raises(StreamingQueryException, match="more than 15 frames"):
            streams.run_to_end(streams.frame_counts(rows, ["source"], 15), str(tmp_path / "state2"), streams.to_table(f"{out}2", ["source"]), "update")
        assert streams.KeyedTable(f"{out}2", ["source"]).read(spark).first().frame_count == 10


def test_two_publications_of_one_run(spark, tmp_path):
    """Of writers that start at the same time one wins."""
    staging, runs = str(tmp_path / "staging"), str(tmp_path / "runs")
    spark.range(3).write.parquet(staging)

    def attempt(_):
        try:
            streams.publish(spark, staging, runs, "a/b run")
        except RuleViolation:
            return 0
        return 1

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(attempt, range(4))) == 1
    assert spark.read.parquet(runs).count() == 1


# ---- bounded state ------------------------------------------------------------------------------------


def test_keyed_table_reads_the_last_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "SNAPSHOT_EVERY", 4)
    table = streams.KeyedTable(str(tmp_path / "t"), ["k"])
    assert table.read(spark) is None
    want = {}
    for batch in range(11):
        rows = [(k, batch * 10 + k) for k in {batch % 3, batch % 5}]
        for _ in range(2):  # a batch that is repeated changes nothing
            table.write(spark.createDataFrame(rows, "k int, v int"), batch)
        before = {r.k: r.v for r in table.read(spark, batch).collect()} if batch else {}
        assert before == want
        want |= dict(rows)
        assert {r.k: r.v for r in table.read(spark).collect()} == want
        changed = spark.read.parquet(f"{tmp_path}/t/changes/batch={batch}")
        assert changed.count() == len(rows)  # only the keys of the batch


def test_intervals_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        first = rng.integers(0, 60, rng.integers(1, 12))
        last = first + rng.integers(0, 6, len(first))
        low, high, again, until = streams.merged_intervals(first, last)
        seen = Counter(i for a, b in zip(first, last) for i in range(a, b + 1))
        assert {i for a, b in zip(low, high) for i in range(a, b + 1)} == set(seen)
        assert (low[1:] > high[:-1] + 1).all()
        assert {i for a, b in zip(again, until) for i in range(a, b + 1)} == {i for i, n in seen.items() if n > 1}


def test_contiguity_state_has_intervals_not_ids(spark, tmp_path):
    """Ten thousand ids with two holes, then late and repeated ones; a hole that is filled leaves the state."""
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    verdicts = []

    def arrive(*parts):
        ids = [i for low, high in parts for i in range(low, high)]
        spark.createDataFrame([("a", i) for i in ids], "source string, frame_id bigint").repartition(3).write.mode("append").parquet(source)
        stream = streams.contiguity_stream(streams.read_files(spark, source, "source string, frame_id bigint"), ["source"])
        streams.run_to_end(stream, state, streams.to_table(out, ["source"]), "update")
        row = streams.KeyedTable(out, ["source"]).read(spark).first()
        verdicts.append((row.n_ids, row.n_rows, row.n_holes, row.contiguous, sorted((r.first, r.last) for r in row.repeated)))

    arrive((0, 100), (200, 5000), (6000, 10_000))
    arrive((100, 200), (50, 60))
    arrive((5000, 6000))
    assert verdicts == [(8900, 8900, 2, False, []), (9000, 9010, 1, False, [(50, 59)]), (10_000, 10_010, 0, False, [])]


def test_tracks_of_closed_frames_leave_the_state(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(6):
        frames = spark.range(part * 100, part * 100 + 100)
        rows = frames.selectExpr("id AS frame_id", "explode(array(1L, 2L, if(id % 50 = 0, 2L, 3L))) AS track_id")
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_files(spark, source, "frame_id bigint, track_id bigint", 1).withColumn("clock", F.expr("timestamp_seconds(1700000000 + frame_id)"))
    counts = streams.track_counts(stream, [], "frame_id", "track_id", "clock", "20 seconds")
    query = counts.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    query = query.foreachBatch(streams.duplicate_batches(out, ["frame_id", "track_id"])).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) <= 2 * 3 * 120  # frames of two batches, not of all
    rows = streams.KeyedTable(out, ["frame_id", "track_id"]).read(spark).collect()
    assert sorted((r.frame_id, r.track_id, r.copies) for r in rows) == [(f, 2, 2) for f in range(0, 600, 50)]


def test_idle_sources_are_forgotten(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for name in ("a", "b", "a"):
        spark.range(5).selectExpr(f"'{name}' AS source").coalesce(1).write.mode("append").parquet(source)
        stream = streams.frame_counts(streams.read_files(spark, source, "source string"), ["source"], idle_ms=1)
        streams.run_to_end(stream, state, streams.to_table(out, ["source"]), "update")
    rows = streams.KeyedTable(out, ["source"]).read(spark).collect()
    assert sorted((r.source, r.frame_count) for r in rows) == [("a", 5), ("b", 5)]  # "a" began anew


# ---- camera files that grow ---------------------------------------------------------------------------


def _records(first, last, invalid=()):
    """Raw 6448-byte records of lines first..last-1; every 16th line begins a group."""
    out = []
    for line in range(first, last):
        record = bytearray(RECORD_BYTES)
        record[:5] = b"\0" * 5 if line in invalid else bytes.fromhex(MAGIC_HEX)
        record[9] = line % 16
        record[16:20] = line.to_bytes(4, "big")  # seconds of a group start, roll of others
        out.append(bytes(record))
    return b"".join(out)


def _rows(frame):
    rows = frame.select("source", "line", "valid", "nibble", F.to_json("sample").alias("sample")).collect()
    return sorted((r.source, r.line, r.valid, r.nibble, r.sample) for r in rows)


def _grow(path, before, after):
    with path.open("ab") as file:
        file.truncate(before * RECORD_BYTES)
        file.write(_records(before, after, {5, 48}) + b"half")


def test_growing_files_give_each_line_once(spark, tmp_path):
    """One query over files that grow between its batches, by whole and half records and through groups; a restart takes the tails."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    stream = scan_lines_stream(spark, str(folder), "telemetry", partitionBytes=20 * RECORD_BYTES)
    query = stream.writeStream.foreachBatch(streams.to_batches(out)).option("checkpointLocation", state).start()
    seen = []
    try:
        for a, b in (((0, 40), None), ((40, 47), (0, 15)), (None, (15, 33)), ((47, 100), (33, 64))):
            for name, lines in (("a.dat", a), ("b.dat", b)):
                if lines:
                    _grow(folder / name, *lines)
            query.processAllAvailable()
            seen.append(spark.read.parquet(out).count())
    finally:
        query.stop()
    assert seen == [25, 32, 32 + 18, 85 + 49]  # the last 15 lines of a file wait
    streams.run_to_end(scan_lines_stream(spark, str(folder), "telemetry", endOfStream="true"), state, streams.to_batches(out))
    assert _rows(spark.read.parquet(out)) == _rows(scan_lines(spark, str(folder), "telemetry"))


def _stream(folder, **options):
    return _LineStream({"path": str(folder), "columns": "telemetry", **options})


def test_offsets_of_camera_files(tmp_path):
    for name, lines in (("a", 40), ("b", 10), ("c", 20)):
        (tmp_path / name).write_bytes(b"\0" * (lines * RECORD_BYTES + 7))
    plain, ordered = _stream(tmp_path), _stream(tmp_path, ordered="true")
    path = str(tmp_path) + "/"
    assert plain.latestOffset()["files"] == {path + n: {"lines": k, "closed": False} for n, k in (("a", 25), ("b", 0), ("c", 5))}
    now = ordered.latestOffset()
    assert now == {"done": path + "b", "files": {path + "c": {"lines": 5, "closed": False}}}
    parts = ordered.partitions(ordered.initialOffset(), now)
    assert sorted((p.path[-1], p.start, p.end, p.total) for p in parts) == [("a", 0, 40, 40), ("b", 0, 10, 10), ("c", 0, 5, 20)]
    (tmp_path / "d").write_bytes(b"\0" * RECORD_BYTES)
    (tmp_path / "a").unlink()  # finished files may be taken away
    later = ordered.latestOffset()
    assert later["done"] == path + "c" and [(p.path[-1], p.start, p.end) for p in ordered.partitions(now, later)] == [("c", 5, 20)]
    ends = _stream(tmp_path, endOfStream="true", closeAfterSeconds="0").latestOffset()
    assert all(f["closed"] for f in ends["files"].values())


def test_files_that_change_fail_the_stream(tmp_path):
    file = tmp_path / "a"
    file.write_bytes(b"\0" * 40 * RECORD_BYTES)
    stream, closing = _stream(tmp_path), _stream(tmp_path, closeAfterSeconds="0")
    open_at, closed_at = stream.latestOffset(), closing.latestOffset()
    file.write_bytes(b"\0" * 60 * RECORD_BYTES)
    with pytest.raises(FileChangedError, match="grew"):
        stream.partitions(closed_at, stream.latestOffset())
    file.write_bytes(b"\0" * 20 * RECORD_BYTES)
    with pytest.raises(FileChangedError, match="fewer"):
        stream.partitions(open_at, stream.latestOffset())
    file.unlink()
    with pytest.raises(FileChangedError, match="went away"):
        stream.partitions(open_at, stream.latestOffset())
