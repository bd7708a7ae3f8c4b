from collections import Counter, defaultdict
from itertools import groupby
import hashlib
import re
import zlib

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from framelake.llm.op02_interleave import ORACLE as SHARDS, interleave, op2_interleave
from framelake.llm.op04_stream_dedup import ORACLE, op4_stream_dedup, run_stream, stream_dedup
from framelake.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def check_shards(rows, n, shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_match_mixture(spark):
    rows = op2_interleave(spark, SMALL).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_shards(rows, len(docs))
    share = Counter(r["source"] for r in docs.values())
    held = Counter((r["shard"], r["source"]) for r in rows)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    for (_, source), n in held.items():
        assert abs(n - share[source] / 16) <= 1.01


def test_shards_by_brute_force(spark):
    """Order by seeded hash within the source, by fraction over all, cut into equal runs."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source").collect()
    key = lambda d: int(hashlib.md5(f"20240607-{d['doc_id']}".encode()).hexdigest()[:12], 16)
    places = []
    for source, group in groupby(sorted(docs, key=lambda d: (d["source"], key(d))), lambda d: d["source"]):
        group = list(group)
        places += [((k + 0.5) / len(group), "=" + source, d["doc_id"]) for k, d in enumerate(group)]
    want = {i: k * 16 // len(docs) for k, (_, _, i) in enumerate(sorted(places))}
    assert {r["doc_id"]: r["shard"] for r in op2_interleave(spark, SMALL).collect()} == want


def test_shards_oracle(spark):
    assert difference(op2_interleave(spark, SMALL), connect(SMALL), SHARDS) is None


def test_shards_odd_rows(odd, empty):
    check_shards(interleave(odd).collect(), odd.count())
    assert interleave(odd).columns.count("shard") == 1
    assert interleave(empty).count() == 0
    hot = odd.sparkSession.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', concat('s', id % 40)) AS source")
    check_shards(interleave(hot).collect(), 3000)


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(odd, empty, digest_bytes):
    """One byte of digest makes most hits false; full bytes tell them apart."""
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = Counter(tuple(r) for r in stream_dedup(odd, digest_bytes=digest_bytes).select(*columns).collect())
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    # A null id is kept where its group has no other.
    assert got == Counter({(i, k, n, True if i is None and k is None else kept, s): c for (i, k, n, kept, s), c in want.items()})
    assert stream_dedup(empty, digest_bytes=digest_bytes).count() == 0


def test_exact_dedup_short_digest_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(
        spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    )
    got = Counter(tuple(r) for r in stream_dedup(docs, digest_bytes=1).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_exact_dedup_oracle(spark):
    assert difference(op4_stream_dedup(spark, SMALL), connect(SMALL), ORACLE) is None


def test_state_survives_restart(spark):
    """A second run with the same checkpoint sees only new files and goes on with the old state."""
    path, checkpoint = scratch_path(spark, "t-arrivals"), scratch_path(spark, "t-state")
    rows = spark.range(20).selectExpr("CAST(CAST(id % 5 AS STRING) AS BINARY) AS digest", "100 - id AS doc_id", "'f' AS locator")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(path)
        return {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in run_stream(stream, checkpoint).collect()}

    rows.repartition(3).write.parquet(path)
    assert run() == {str(k).encode(): (100 - 15 - k, 4) for k in range(5)}
    rows.withColumn("doc_id", F.col("doc_id") - 50).write.mode("append").parquet(path)
    assert run() == {str(k).encode(): (50 - 15 - k, 8) for k in range(5)}
