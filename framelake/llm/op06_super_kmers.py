"""Removal of repeated passages: super-k-mers partitioned by minimiser."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import as_bytes, documents, flat_words, over_batches, rolling, row_batch, small_batches, stored, word_hashes

WINDOW, MER = 50, 8
#: Buckets with more super-k-mers than this are not sorted in one task; their windows are grouped one by one.
HOT = 20_000


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    step, now = 1, values
    while 2 * step <= width:
        now = np.minimum(now[:-step], now[step:])
        step *= 2
    rest = width - step
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


class Windows:
    """All windows of a batch of texts, and their cuts into super-k-mers (runs of windows of one text with one minimiser)."""

    def __init__(self, column: pa.Array, window: int, mer: int):
        self.words, self.first, self.counts = flat_words(column)
        hashes = word_hashes(self.words)
        n = len(hashes) - window + 1
        self.start = self.length = self.doc = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.int64)
        if n <= 0:
            return
        least = _least_of(rolling(hashes, mer), window - mer + 1).astype(np.int64)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        same = doc[:n] == doc[window - 1 :]
        at = np.flatnonzero(same)
        if not len(at):
            return
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]) | (least[at[1:]] != least[at[:-1]])
        runs = np.flatnonzero(fresh)
        self.start = at[runs]
        self.length = np.diff(np.append(runs, len(at)))
        self.doc, self.minimiser = doc[self.start], least[self.start]


#: What travels: packed super-k-mers by bucket, digests of windows of hot buckets, and ranges that are settled already.
MOVED = pa.schema([(c, pa.int64()) for c in ("key", "low", "doc_id", "tag", "start", "windows")] + [("packed", pa.binary())])
MOVED_KIND = "key long, low long, doc_id long, tag long, start long, windows long, packed binary"
RANGES = pa.schema([(c, pa.int64()) for c in ("doc_id", "tag", "start", "windows")])
RANGES_KIND = "doc_id long, tag long, start long, windows long"


def _sorted_bucket(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, packed: list[bytes], buckets: np.ndarray, window: int) -> pa.RecordBatch:
    """Ranges of windows that also start in a smaller document, of whole buckets. Equal hashes are checked word by word."""
    numbers: dict[bytes, int] = {}
    words = [p.split(b" ") for p in packed]
    counts = np.array([len(w) for w in words], np.int64)
    ids = np.array([numbers.setdefault(w, len(numbers)) for p in words for w in p], np.int64)
    windows = counts - window + 1
    row = np.repeat(np.arange(len(counts)), windows)
    within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(counts) - counts)[row] + within
    key = rolling(ids.astype(np.uint64) + np.uint64(1), window)[at]
    order = np.lexsort((docs[row], key, buckets[row]))
    b, k, d = buckets[row][order], key[order], docs[row][order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    leader = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    removed = np.zeros(len(order), bool)
    hit = np.flatnonzero(d > d[leader])
    for part in np.array_split(hit, max(1, len(hit) // 50_000)):
        mine, theirs = at[order[part]], at[order[leader[part]]]
        equal = np.ones(len(part), bool)
        for j in range(window):
            equal &= ids[mine + j] == ids[theirs + j]
        removed[part] = equal
        for odd in part[~equal]:  # two sequences under one hash: look for an equal one among those before
            mine = ids[at[order[odd]] : at[order[odd]] + window]
            removed[odd] = any(
                d[o] < d[odd] and np.array_equal(mine, ids[at[order[o]] : at[order[o]] + window]) for o in range(leader[odd], odd)
            )
    flag = np.zeros(len(order), bool)
    flag[order] = removed
    edge = np.flatnonzero(flag)
    if not len(edge):
        return row_batch(RANGES, [[], [], [], []])
    fresh = np.ones(len(edge), bool)
    fresh[1:] = (edge[1:] != edge[:-1] + 1) | (row[edge[1:]] != row[edge[:-1]])
    begin = edge[fresh]
    length = np.diff(np.append(np.flatnonzero(fresh), len(edge)))
    return row_batch(RANGES, [docs[row[begin]], tags[row[begin]], starts[row[begin]] + within[begin], length])


def repeated_ranges(texts: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT) -> DataFrame:
    """(doc_id, tag, start, windows): runs of windows whose words also start in a document with a smaller id. ``tag`` is the
    hash of the text and tells rows under one id apart.

    ``texts`` has doc_id (not null) and text in bytes. First only minimisers travel, one row per document and minimiser. A window
    that occurs in two documents has one minimiser in both, so super-k-mers whose minimiser is in one document stay behind.
    The others travel as packed strings to the bucket of their minimiser, where windows are sorted. Windows of very
    frequent minimisers travel as 128-bit digests, spread by digest: of those in one batch only the smallest document's,
    since the others' fate is known; where they meet, rows pass one by one in order of the document.
    """

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64())])
        for batch in small_batches(batches, 1):
            found = Windows(batch.column(1), window, mer)
            pairs = np.unique(np.stack([batch.column(0).to_numpy()[found.doc], found.minimiser], 1), axis=0) if len(found.doc) else np.zeros((0, 2), np.int64)
            yield row_batch(schema, [pairs[:, 1], pairs[:, 0]])

    pairs = stored(over_batches(texts, minimisers, "bucket long, doc_id long"), "minimisers")
    counts = pairs.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = counts.where("a < b").select("bucket", (F.col("n") > hot).alias("hot"))
    wanted = pairs.join(shared, "bucket").groupBy("doc_id")
    wanted = wanted.agg(
        F.collect_set(F.when(~F.col("hot"), F.col("bucket"))).alias("buckets"), F.collect_set(F.when(F.col("hot"), F.col("bucket"))).alias("hot")
    )
    held = texts.join(wanted, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("tag"), "buckets", "hot")

    def chosen(found: Windows, lists: pa.ListArray) -> np.ndarray:
        lengths = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(lists)), lengths)
        values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        kind = np.dtype([("d", np.int64), ("m", np.int64)])
        have, want = np.empty(len(found.doc), kind), np.empty(len(values), kind)
        have["d"], have["m"] = found.doc, found.minimiser
        want["d"], want["m"] = owner, values
        return np.flatnonzero(np.isin(have, want))

    def super_kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = Windows(batch.column(1), window, mer)
            ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at = chosen(found, batch.column(3))
            if len(at):
                a, n, doc = found.start[at], found.length[at] + window - 1, found.doc[at]
                packed = [b" ".join(found.words[i : i + k]) for i, k in zip(a.tolist(), n.tolist(), strict=True)]
                yield row_batch(MOVED, [found.minimiser[at], pa.nulls(len(at), pa.int64()), ids[doc], tags[doc], a - found.first[doc], np.zeros(len(at), np.int64), packed])
            at = chosen(found, batch.column(4))
            if len(at):
                hashes = word_hashes(found.words)
                doc = np.repeat(found.doc[at], found.length[at])
                place = np.concatenate([np.arange(x, x + k) for x, k in zip(found.start[at], found.length[at], strict=True)])
                high = rolling(hashes, window)[place].astype(np.int64)
                low = rolling(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), window)[place].astype(np.int64)
                order = np.lexsort((ids[doc], low, high))
                high, low, doc, place = high[order], low[order], doc[order], place[order]
                first = np.ones(len(order), bool)
                first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                leader = ids[doc][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
                settled = (ids[doc] > leader).astype(np.int64)
                start = place - found.first[doc]
                key = np.where(settled == 1, ids[doc], high)
                yield row_batch(MOVED, [key, low, ids[doc], tags[doc], start, settled, pa.nulls(len(order), pa.binary())])

    def settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        smallest: tuple[int, int, int] | None = None

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            return _sorted_bucket(*(table[c].to_numpy() for c in ("doc_id", "tag", "start")), table["packed"].to_pylist(), table["key"].to_numpy(), window)

        for every in small_batches(batches, 6):
            is_packed = every.column(6).is_valid()
            other = every.filter(pc.invert(is_packed))
            if other.num_rows:
                key, low, ids, tags, start, settled = (other.column(k).to_numpy() for k in range(6))
                ready, open_ = np.flatnonzero(settled == 1), np.flatnonzero(settled == 0)
                yield row_batch(RANGES, [ids[ready], tags[ready], start[ready], settled[ready]])
                if len(open_):
                    key, low, ids, tags, start = (x[open_] for x in (key, low, ids, tags, start))
                    first = np.ones(len(open_), bool)
                    first[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
                    leader = ids[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
                    if smallest is not None:
                        leader = np.where((key == smallest[0]) & (low == smallest[1]), smallest[2], leader)
                    smallest = (int(key[-1]), int(low[-1]), int(leader[-1]))
                    gone = np.flatnonzero(ids > leader)
                    yield row_batch(RANGES, [ids[gone], tags[gone], start[gone], np.ones(len(gone), np.int64)])
            batch = every.filter(is_packed)
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut or (waiting and waiting[-1].column(0)[-1].as_py() != keys[0]):
                done = [*waiting, batch.slice(0, cut)] if cut else waiting
                yield settle(done)
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield settle(waiting)

    moved = over_batches(held, super_kmers, MOVED_KIND).repartition("key").sortWithinPartitions("key", "low", "doc_id")
    return over_batches(moved, settle_buckets, RANGES_KIND)


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, tag (hash of the text) of every row: words covered by a window that also starts in a document with a
    smaller id are removed, the others are joined by one space.

    Null and empty texts have no words. Rows that share an id do not remove from each other. A
    row with a null id neither removes nor loses words. An empty table gives no rows.
    """
    every = docs.select("doc_id", as_bytes(text).alias("text"))
    texts = every.where("doc_id IS NOT NULL")  # the same rows for both joins, so that Spark shuffles the texts once
    ranges = repeated_ranges(texts, window, mer, hot).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "windows")).alias("ranges"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("tag", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            rows = ([], [], [])
            for value, tag, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = value.as_py().split()
                n = len(words)
                if found.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    for r in found.as_py():
                        if r["tag"] != tag:
                            continue
                        edge[r["start"]] += 1
                        edge[r["start"] + r["windows"] + window - 1] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                for column, x in zip(rows, (n, n - len(words), b" ".join(words).decode("utf-8", "replace")), strict=True):
                    column.append(x)
            yield row_batch(schema, [batch.column(0), *rows, batch.column(2)])

    rows = texts.join(ranges, "doc_id", "left").union(every.where("doc_id IS NULL").withColumn("ranges", F.lit(None)))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tag"), "ranges")
    return over_batches(rows, cut, "doc_id long, n_words long, n_removed long, kept_text string, tag long")


def op6_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# Windows are lists of words; the smallest id of each is compared with the document's own.
ORACLE = r"""
    WITH d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
    win AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 50], ' ') AS w
            FROM (SELECT doc_id, words, unnest(range(len(words) - 49)) AS i FROM d WHERE len(words) >= 50)),
    bad AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)),
    cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN bad USING (w) WHERE doc_id > least),
    gone AS (SELECT doc_id, list(p) AS ps FROM cov GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN ps IS NULL THEN words
                  ELSE [words[p + 1] FOR p IN range(len(words)) IF NOT list_contains(ps, p)] END, ' ')) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)"""
