"""Ranked lexical search by NRA: impact-sorted lists are only read forward, documents carry score intervals."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelake.llm.common import as_bytes, documents, over_batches, row_batch, small_batches, stored

K = 50
QUERY_TERMS = 200_000  # (item, term) pairs searched in one pass over the documents; more items take more passes
PIECE = 1 << 22  # bytes of a text whose words are held at once
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 14  # what one set of lists in a task holds
FIRST_READ, GROWTH = 256, 4  # entries read of each list before bounds are looked at, then times GROWTH
SALTS = 64

# Terms are what stands between these bytes; only A-Z change their case. Bytes of 0x80 and more belong to terms.
_TERM = [c for c in range(128) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A]
FOLD = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c >= 128 or c in _TERM else 0x20 for c in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """The folded text in pieces cut between terms, so that a very long text is never a single list of words."""
    folded = text.translate(FOLD)
    start = 0
    while len(folded) - start > PIECE:
        cut = folded.find(b" ", start + PIECE)
        if cut < 0:
            break
        yield folded[start:cut]
        start = cut
    yield folded[start:]


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term) pairs, each once. Rows of one item are one query; null texts have no terms."""

    def split(batches):
        for batch in batches:
            for part in small_batches([batch], 1):
                rows, terms = [], []
                for row, value in enumerate(part.column(1)):
                    found = {w for piece in pieces(value.as_py()) for w in piece.split()}
                    rows += [row] * len(found)
                    terms += found
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())], ["item", "term"])

    kind = items.schema[item].dataType.simpleString()
    return over_batches(items.select(item, as_bytes(text)), split, f"item {kind}, term binary").distinct()


def term_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document: its id, the number of all its terms, and how often it holds which terms of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by QUERY_TERMS

    def count(batches):
        number = known.value.get
        for batch in batches:
            for part in small_batches([batch], 1, PIECE):
                rows, n = part.num_rows, np.zeros(part.num_rows, np.int64)
                keys, times = [], []
                for row, value in enumerate(part.column(1)):
                    for piece in pieces(value.as_py()):
                        words = piece.split()
                        n[row] += len(words)
                        found = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                        term, tf = np.unique(found[found >= 0], return_counts=True)
                        keys.append(term + (row << 32))
                        times.append(tf)
                keys, at = np.unique(np.concatenate(keys), return_inverse=True)
                tf = np.bincount(at, np.concatenate(times), len(keys)).astype(np.int64)
                offsets = np.searchsorted(keys, np.arange(rows + 1) << 32).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((keys & 0xFFFFFFFF).astype(np.int32), tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["doc", "n", "terms", "tfs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return over_batches(docs.select(doc_id, as_bytes(text)), count, f"doc {kind}, n long, terms array<int>, tfs array<long>")


class Shard:
    """Lists of some documents, sorted by falling impact inside each term."""

    def __init__(self, parts: list[pa.RecordBatch], n_docs: int, n_terms: int):
        table = pa.Table.from_batches(parts)
        self.ids, n = table.column("doc"), table.column("n").to_numpy()
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy()
        m = 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])  # at most 10**6
        order = np.argsort(term << 20 | ((1 << 20) - 1 - impact), kind="stable")
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))

    def lists(self, terms: np.ndarray, weights: np.ndarray):
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        hit = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        return self.starts[at[hit]], self.ends[at[hit]], weights[hit]


def no_random_access(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of all documents of the shard that can be among the ``k`` best, scores final.

    Each round reads the next entries of every list that still matters. A document's lower bound is what was read of it;
    its upper bound adds the next impact of every list in which it was not seen. Documents whose upper bound is under the
    k-th lower bound (or under ``floor``, a score that k others have already) are out; equal ones stay, since ids break ties. Reading
    ends when no unseen document can enter and the bounds of all that stay have met.
    """
    at, ends, weights = shard.lists(terms, weights)
    lower = np.zeros(len(shard.ids), np.int64)
    seen = np.zeros((len(at), len(shard.ids)), bool)
    at, head = at.copy(), np.zeros(len(at), np.int64)
    # A list matters while it can bring a new document or holds an unseen entry of one that stays.
    matters, step, stay = np.ones(len(at), bool), FIRST_READ, None
    while True:
        for i in np.flatnonzero(matters):
            stop = min(at[i] + step, ends[i])
            docs = shard.doc[at[i] : stop]
            lower[docs] += weights[i] * shard.impact[at[i] : stop]
            seen[i, docs] = True
            at[i] = stop
            head[i] = weights[i] * shard.impact[stop] if stop < ends[i] else 0
        step *= GROWTH
        unseen = int(head.sum())
        # k positive scores of this shard, or k of earlier ones, whatever is more.
        least = max(floor, int(np.partition(lower, -k)[-k]) if len(lower) >= k else 0, 1)
        pool = np.flatnonzero(lower + unseen >= least) if stay is None else stay
        pool = pool[lower[pool] > 0]
        upper = lower[pool] + unseen - head @ seen[:, pool]
        kept = upper >= least
        pool, upper = pool[kept], upper[kept]
        if trace is not None:
            trace.append((pool.copy(), lower[pool].copy(), upper, least, unseen))
        if unseen < least:
            stay = pool
            if (upper == lower[pool]).all():
                return pool, lower[pool]
            matters = (head > 0) & ~seen[:, pool].all(axis=1)
        else:
            matters = head > 0


def best_of_lists(batches: Iterator[pa.RecordBatch], queries: list[tuple[np.ndarray, np.ndarray]], k: int, n_docs: int, n_terms: int):
    """The k best documents of one task for each query, shard after shard; later shards start from the scores of earlier ones."""
    best: list[list] = [[] for _ in queries]

    def order(found):
        return (-found[0], found[1] is None, found[1] if found[1] is not None else 0)

    def search(parts):
        shard = Shard(parts, n_docs, n_terms)
        for number, (terms, weights) in enumerate(queries):
            held = best[number]
            docs, scores = no_random_access(shard, terms, weights, k, held[k - 1][0] if len(held) == k else 0)
            if len(docs):
                ids = shard.ids.take(pa.array(docs)).to_pylist()
                best[number] = sorted([*held, *zip(scores.tolist(), ids, strict=True)], key=order)[:k]

    parts, docs, postings = [], 0, 0
    for batch in batches:
        for part in [batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)]:
            parts.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                search(parts)
                parts, docs, postings = [], 0, 0
    if parts:
        search(parts)
    for number, found in enumerate(best):
        if found:
            yield number, [f[1] for f in found], [f[0] for f in found]


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, document, score): the ``k`` best documents with a score above 0 for every item.

    Two passes: the terms of all documents are counted once, whole, and the counts of terms that items use are written to
    the shared folder; then each task sorts its part of them by impact and runs NRA for every item, keeping k documents an
    item. Only those are shuffled. Corpus statistics are sums over all rows. Items are taken in blocks of about
    ``QUERY_TERMS`` (item, term) pairs, so what is broadcast does not grow with them.

    Equal scores rank by ascending id, null ids last. Null and empty texts have no terms and never match; rows that repeat a
    document's id are separate documents, rows that repeat an item's id are one item. Empty tables give an empty result.
    Other columns are left out.
    """
    pairs = stored(item_terms(items, item, item_text), "items")
    blocks = max(1, -(-pairs.count() // QUERY_TERMS))
    found = [_search_block(docs, pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else pairs, k, doc_id, text) for b in range(blocks)]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("item").alias(item), "rank", F.col("doc").alias(doc_id), "score")


def _search_block(docs: DataFrame, pairs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    held = pairs.toArrow()
    vocabulary = {t: i for i, t in enumerate(sorted(set(held.column("term").to_pylist())))}
    by_item: dict = {}
    for i, t in zip(held.column("item").to_pylist(), held.column("term").to_pylist(), strict=True):
        by_item.setdefault(i, []).append(vocabulary[t])
    counts = stored(term_counts(docs, doc_id, text, vocabulary), "terms")
    sums = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held = held.select("term", weight.cast("long").alias("w")).toArrow()  # a row for each term of the block
    weights[held.column("term").to_numpy()] = held.column("w").to_numpy()
    terms = [np.array(sorted(t), np.int64) for t in by_item.values()]
    queries = spark.sparkContext.broadcast([(t, weights[t]) for t in terms])
    kind = docs.schema[doc_id].dataType
    out = pa.schema([("number", pa.int32()), ("doc", to_arrow_type(kind)), ("score", pa.int64())])

    def rank(batches):
        for number, ids, scores in best_of_lists(batches, queries.value, k, n_docs, n_terms):
            yield row_batch(out, [[number] * len(ids), ids, scores])

    local = over_batches(counts, rank, f"number int, doc {kind.simpleString()}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    salted = Window.partitionBy("number", "salt").orderBy(*order)
    local = local.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    local = local.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k).drop("rank", "salt")
    local = local.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(zip(by_item, range(len(by_item)), strict=True)), f"item {pairs.schema['item'].dataType.simpleString()}, number int")
    return local.join(F.broadcast(names), "number").select("item", "rank", "doc", "score")


def op11_nra(spark: SparkSession, folder: str) -> DataFrame:
    return search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    s AS (SELECT count(*) FILTER (len(words) > 0)::BIGINT AS nd, coalesce(sum(len(words)), 0)::BIGINT AS nt FROM d),
    i AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
    p AS (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d),
    t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, nd),
    c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::BIGINT AS score
          FROM i JOIN t USING (term) JOIN w USING (term), s GROUP BY 1, 2)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM c WHERE score > 0
    QUALIFY rank <= {K}"""
