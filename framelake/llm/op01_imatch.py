"""Document fingerprints: I-Match over several randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import as_bytes, documents, mixed, over_batches, row_batch, stored, word_hashes

#: A term belongs to the lexicon if this share of all documents has it. The lower bound also bounds the lexicon: at most
#: (mean distinct terms of a document) / LEAST_SHARE terms, whatever the corpus.
LEAST_SHARE, MOST_SHARE = 2.0**-13, 2.0**-4
#: Lexicon subsets: for each rate, so many subsets that hold each term with that probability.
RATES, PER_RATE = (1 / 8, 1 / 32, 1 / 128, 1 / 512), 24
FLUSH_TERMS = 400_000
# ASCII characters that are not part of terms.
BREAKS = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'", b" " * 32)

SUBSETS = len(RATES) * PER_RATE
SALTS = mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64))
LIMITS = np.repeat(np.array([int(r * 2**32) for r in RATES], np.uint64), PER_RATE)
POWERS = mixed(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)


def terms_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(BREAKS).split())


def fingerprint(text: str, lexicon: np.ndarray) -> np.ndarray:
    """One 16-bit hash per subset of the sorted distinct terms that are in the lexicon and the subset; 0 without terms.

    A text with terms but none in the lexicon keeps all its terms.
    """
    out = np.zeros(SUBSETS, np.uint16)
    found = terms_of(text)
    if not found:
        return out
    terms = np.sort(word_hashes(list(found)))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        known = terms[lexicon[at] == terms]
        terms = known if len(known) else terms
    total, rank = np.zeros(SUBSETS, np.uint64), np.zeros(SUBSETS, np.int64)
    for a in range(0, len(terms), 4096):
        part = terms[a : a + 4096]
        draw = part[:, None] ^ SALTS[None, :]
        draw *= np.uint64(0xBF58476D1CE4E5B9)
        member = (draw >> np.uint64(32)) < LIMITS
        row, subset = np.nonzero(member.T)[::-1]
        counts = np.bincount(subset, minlength=SUBSETS)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + rank[subset]
        value = part[row] * POWERS[place & 4095] + (place >> 12).astype(np.uint64)
        some = np.flatnonzero(counts)
        if len(some):
            total[some] += np.add.reduceat(value, (np.cumsum(counts) - counts)[some])
        rank += counts
    hashed = mixed(total + SALTS)
    return np.where(rank > 0, hashed % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets that hold a term of either text, at the rate where it is largest (a rate
    counts at least 8 subsets). For sparse subsets this estimates the Jaccard coefficient of the terms; 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    some, same = ((a > 0) | (b > 0)).reshape(-1, PER_RATE).sum(1), ((a == b) & (a > 0)).reshape(-1, PER_RATE).sum(1)
    return float((same / np.maximum(some, 8)).max())


def lexicon_of(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms whose document frequency over all rows lies in the band."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            terms = word_hashes(list(sums)).astype(np.int64)
            order = np.argsort(terms)
            yield row_batch(schema, [terms[order], np.fromiter(sums.values(), np.int64, len(sums))[order]])

        for batch in batches:
            for value in batch.column(0):
                sums.update(terms_of(value.as_py().decode("utf-8", "replace")))
                if len(sums) > FLUSH_TERMS:
                    yield from rows()
                    sums.clear()
        yield from rows()

    n = docs.count()
    counts = over_batches(docs.select(as_bytes(text).alias("text")), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n").between(least * n, most * n)).select("term").toArrow()["term"].to_numpy().astype(np.uint64))


PAIR = pa.schema(
    [("part", pa.int64()), ("end", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
    + [("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.binary())]
)
PAIR_KIND = (
    "part long, end string, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, text binary"
)


def fingerprints(docs: DataFrame, lexicon: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id and the fingerprint (two bytes per subset) of every row; null counts as empty, an empty text has zeros only."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(v.as_py().decode("utf-8", "replace"), shared.value).astype(">u2").tobytes() for v in batch.column(1)]
            yield row_batch(schema, [batch.column(0), prints])

    return over_batches(docs.select("doc_id", as_bytes(text).alias("text")), work, "doc_id long, fingerprint binary")


def compared_with_next(docs: DataFrame, lexicon: np.ndarray, text: str = "text") -> DataFrame:
    """Every text, its edited form and its successor by falling doc_id, with fingerprints and likeness.

    Texts are range partitioned by doc_id, compressed for the one shuffle they take. Tasks walk their sorted rows with
    one row of look-ahead. The first and the last row of each task are kept whole, and a second, small job joins the
    last row of a task to the first of the next (one pair per task).

    Null texts are empty. Rows that repeat an id follow each other by text. A single row is its own successor; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])
        for batch in batches:
            yield row_batch(schema, [batch.column(0), [packer.compress(v.as_py()) for v in batch.column(1)]])

    def finish(doc_id, own: str, own_print: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        edited_print = fingerprint(edited, shared.value)
        digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        prints = (own_print.astype(">u2").tobytes(), edited_print.astype(">u2").tobytes())
        return (doc_id, len(own), digest, *prints, likeness(own_print, edited_print), likeness(own_print, next_print))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        part, held, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = unpacker.decompress(value.as_py())
                now = (doc_id, raw.decode("utf-8", "replace"))
                now = (*now, fingerprint(now[1], shared.value))
                if held is None:
                    rows.append((part, "first", doc_id, *[None] * 6, raw))
                else:
                    rows.append((part, None, *finish(*held, now[1], now[2]), None))
                held, last = now, raw
            if rows:
                yield row_batch(PAIR, [list(c) for c in zip(*rows, strict=True)])
        if held is not None:
            yield row_batch(PAIR, [[x] for x in (part, "last", held[0], *[None] * 6, last)])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, own, following in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own, following = (v.as_py().decode("utf-8", "replace") for v in (own, following))
                prints = (fingerprint(t, shared.value) for t in (own, following))
                own_print, next_print = prints
                rows.append((0, None, *finish(doc_id, own, own_print, following, next_print), None))
            yield row_batch(PAIR, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in PAIR])

    packed = over_batches(docs.select("doc_id", as_bytes(text).alias("text")), shrink, "doc_id long, packed binary")
    ordered = packed.repartitionByRange(F.desc("doc_id"), "packed").sortWithinPartitions(F.desc("doc_id"), "packed")
    done = stored(over_batches(ordered, walk, PAIR_KIND), "pairs")
    ends = done.where("end IS NOT NULL").select("part", "end", "doc_id", "text")
    firsts = ends.where("end = 'first'").select("part", F.col("text").alias("first_text"))
    lasts = ends.where("end = 'last'").select("part", "doc_id", "text")
    tasks = firsts.select("part")  # one row per task of the job above
    order = tasks.withColumn("following", F.lead("part").over(Window.orderBy("part")))
    order = order.withColumn("following", F.coalesce("following", F.min("part").over(Window.orderBy("part"))))
    pairs = lasts.join(order, "part").join(firsts.withColumnRenamed("part", "following"), "following").select("doc_id", "text", "first_text")
    return done.where("end IS NULL").union(over_batches(pairs, join_ends, PAIR_KIND)).drop("part", "end", "text")


def op1_imatch(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    out = compared_with_next(docs, lexicon_of(docs))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
