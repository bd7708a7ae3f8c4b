"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import over_batches, row_batch, stored

K, QUERY_STEP = 20, 20
BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
FIT_ROWS = 8192  # distinct vectors with the smallest hashes, from which the rotation is learned
PROBE_ROWS = 192  # distinct queries with the smallest hashes, searched exactly to fix the radius
COVER = 0.97  # share of their true neighbours that must lie within the radius
WIDER = 4  # added to the radius of queries that found too few
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096  # what one task holds of a bucket and of its queries
PAIRS, SCORED = 1 << 21, 1 << 16  # candidate pairs looked at, and scored, together


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): vectors with an id that are not null, zero or of another length than most, with finite components only."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(finite)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("v") == (sizes["size"] if sizes else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, ids, v): each different vector once, with its smallest ids in order, ``keep`` of them.

    Equal vectors score the same for every query and rank by id, so no result can hold more of them.
    """
    ranked = rows.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= keep)
    held = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most ``keep`` ids
    return held.select(F.col("ids")[0].alias("rep"), "ids", "v")


# ---- codes -------------------------------------------------------------------------------------------


class Codes:
    """Signs of rotated coordinates. Inner product becomes an angle by one more coordinate that levels the lengths."""

    def __init__(self, sample: np.ndarray, longest: float, rounds: int = 40, seed: int = 7):
        self.longest = longest
        x = self._levelled(sample)
        self.centre = x.mean(axis=0)
        x = x - self.centre
        rng, turns = np.random.default_rng(seed), []
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        while sum(t.shape[1] for t in turns) < BITS:
            width = min(BITS - sum(t.shape[1] for t in turns), axes.shape[1])
            main = axes[:, :width]
            flat = x @ main
            turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
            for _ in range(rounds):  # the rotation that brings the points nearest to corners of the cube
                signs = np.where(flat @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(flat.T @ signs)
                turn = left @ right
            turns.append(main @ turn)
        self.turn = np.concatenate(turns, axis=1)

    def _levelled(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, 1 - np.minimum(1.0, (x * x).sum(axis=1) / self.longest**2)))
        return np.concatenate([x / self.longest, rest[:, None]], axis=1)

    def _pack(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.centre) @ self.turn >= 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._pack(self._levelled(x))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._pack(np.concatenate([unit, np.zeros((len(x), 1))], axis=1))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_rows(query: np.ndarray, rep: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best (score down, id up) of each query."""
    order = np.lexsort((rep, -score, query))
    starts = np.flatnonzero(np.diff(query[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < keep]


def allowed(radius: int) -> list[int]:
    """Pigeonhole: a code within ``radius`` lies within the given distance in one part at least."""
    low, rest = divmod(radius, PARTS)
    return [low if part <= rest else low - 1 for part in range(PARTS)]


def part_of(codes: np.ndarray, part: int) -> np.ndarray:
    return (codes >> np.uint64(WIDTH * part)).astype(np.uint16)


def probe(codes: np.ndarray, queries: np.ndarray, part: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) places of all rows within the radius that this part is the first to find.

    The rows' values of the part are the index; a query takes the runs of all values within its distance.
    """
    near = allowed(radius)
    if near[part] < 0 or not len(codes) or not len(queries):
        return
    order = np.argsort(part_of(codes, part), kind="stable")
    values, starts, sizes = np.unique(part_of(codes, part)[order], return_index=True, return_counts=True)
    wanted = part_of(queries, part)
    step = max(1, PAIRS // len(codes))
    for first in range(0, len(queries), step):
        block = wanted[first : first + step]
        q, run = np.nonzero(np.bitwise_count(block[:, None] ^ values[None, :]) <= near[part])
        n = sizes[run]
        row = order[np.repeat(starts[run] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        q = np.repeat(q, n) + first
        apart = queries[q] ^ codes[row]
        found = np.bitwise_count(apart) <= radius
        for earlier in range(part):
            found &= np.bitwise_count(part_of(apart, earlier)) > near[earlier]
        yield q[found], row[found]


def nearest_in_block(rep, x, codes, q_x, q_codes, q_floor, part: int, radius: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the best by inner product among the codes found by one part, none under the query's floor."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for q, row in probe(codes, q_codes, part, radius):
        chunks = [slice(a, a + SCORED) for a in range(0, len(q), SCORED)]
        score = np.concatenate([np.einsum("ij,ij->i", q_x[q[c]], x[row[c]]) for c in chunks] or [np.zeros(0)])
        over = score >= q_floor[q]
        q, row, score = q[over], row[over], score[over]
        top = best_rows(q, rep[row], score, keep)
        held = [np.concatenate([h, v[top]]) for h, v in zip(held, (q, row, score), strict=True)]
    return tuple(held)


# ---- jobs --------------------------------------------------------------------------------------------


def _coded(rows: DataFrame, codes: Codes) -> DataFrame:
    """Adds ``code``, the binary code as a signed long."""

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("code", pa.array(codes.of_rows(matrix(batch.column("v"))).view(np.int64)))

    return over_batches(rows, add, "rep long, ids array<long>, v array<double>, code long")


def _asked(queries: DataFrame, codes: Codes, sample: np.ndarray, keep: int) -> DataFrame:
    """Adds ``code`` and ``floor``: the ``keep``-th largest inner product with the sample, which is part of the index."""
    known = queries.sparkSession.sparkContext.broadcast(sample)  # FIT_ROWS vectors at most

    def add(batches):
        for batch in batches:
            for part in [batch.slice(a, 512) for a in range(0, batch.num_rows, 512)]:
                x, sample = matrix(part.column("v")), known.value
                floor = np.full(len(x), -np.inf)
                if len(sample) >= keep:
                    # Sums of another order may differ in the last digits.
                    slack = 1e-9 * np.linalg.norm(x, axis=1) * codes.longest
                    floor = np.partition(x @ sample.T, -keep, axis=1)[:, -keep] - slack
                yield part.append_column("code", pa.array(codes.of_queries(x).view(np.int64))).append_column("floor", pa.array(floor))

    return over_batches(queries, add, "v array<double>, rep long, code long, floor double")


def _fit(index: DataFrame) -> tuple[Codes | None, np.ndarray]:
    longest = index.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = index.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("v").toArrow()  # at most FIT_ROWS vectors
    sample = matrix(sample.column(0).combine_chunks())
    return Codes(sample, longest) if len(sample) else None, sample


def fitted_radius(index: DataFrame, queries: DataFrame, keep: int, cover: float) -> int:
    """Smallest radius that holds ``cover`` of the true neighbours of PROBE_ROWS queries, searched exactly over all rows."""
    held = queries.orderBy(F.xxhash64("rep"), "rep").limit(PROBE_ROWS).select("rep", "v", "code").toArrow()
    rep, x = held.column("rep").to_numpy(), matrix(held.column("v").combine_chunks())
    codes = held.column("code").to_numpy().view(np.uint64)

    def exact(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score, ids = x @ matrix(batch.column("v")).T, batch.column("rep").to_numpy()
            q = np.repeat(np.arange(len(x)), len(ids))
            top = best_rows(q, np.tile(ids, len(x)), score.reshape(-1), keep)
            q, row = q[top], top % len(ids)
            own = ids[row] != rep[q]
            q, row = q[own], row[own]
            apart = np.bitwise_count(codes[q] ^ batch.column("code").to_numpy().view(np.uint64)[row]).astype(np.int32)
            yield row_batch(EXACT, [q, ids[row], score[q, row], apart])

    found = over_batches(index.select("rep", "v", "code"), exact, "q long, rep long, score double, apart int")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    apart = found.withColumn("nth", nth).where(F.col("nth") < keep).groupBy("apart").agg(F.count(F.lit(1)).alias("n")).orderBy("apart").collect()
    total, so_far = sum(r["n"] for r in apart), 0
    for r in apart:  # at most BITS + 1 rows
        so_far += r["n"]
        if so_far >= cover * total:
            return r["apart"]
    return 0


EXACT = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("apart", pa.int32())])
FOUND = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def neighbours(index: DataFrame, queries: DataFrame, radius: int, keep: int) -> DataFrame:
    """(query, ids, score): for each query vector the ``keep`` best different vectors with codes within ``radius``.

    Every part has buckets by the leading bits of its value, about BLOCK_ROWS rows each. Rows go to their bucket of each
    part, queries to the buckets whose leading bits are near enough. A bucket is split into blocks of rows and its
    queries into blocks of queries, so neither a common value nor many queries meet in one task.
    """
    rows = index.count()
    lead = min(WIDTH - 4, max(0, math.ceil(math.log2(max(1, rows) / BLOCK_ROWS))))
    bucket = F.expr(f"CAST(shiftrightunsigned(code, part * {WIDTH} + {WIDTH - lead}) & {(1 << lead) - 1} AS INT)")
    parts = F.explode(F.array(*[F.lit(p) for p, near in enumerate(allowed(radius)) if near >= 0])).alias("part")
    near = F.element_at(F.array(*[F.lit(n) for n in allowed(radius)]), F.col("part") + 1)

    dealt = index.select("*", parts).withColumn("bucket", bucket)
    asked = queries.select("*", parts).withColumn("own", bucket)
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit((1 << lead) - 1))))
    asked = asked.where(F.bit_count(F.col("own").bitwiseXOR(F.col("bucket"))) <= near).drop("own")
    size = lambda df, per: df.groupBy("part", "bucket").agg(F.ceil(F.count(F.lit(1)) / per).alias("n"))  # noqa: E731  a row for each bucket
    blocks = size(dealt, BLOCK_ROWS).withColumnRenamed("n", "rows").join(size(asked, BLOCK_QUERIES).withColumnRenamed("n", "asks"), ["part", "bucket"])
    blocks = F.broadcast(stored(blocks, "blocks"))  # PARTS << (WIDTH - 4) rows at most
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    share = lambda n: F.pmod(F.xxhash64("rep", F.lit(n)), F.col(n))
    key = ["part", "bucket", "row_block", "query_block"]
    dealt = dealt.join(blocks, ["part", "bucket"]).withColumn("row_block", share("rows")).withColumn("query_block", spread("asks"))
    asked = asked.join(blocks, ["part", "bucket"]).withColumn("query_block", share("asks")).withColumn("row_block", spread("rows"))

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (rep, x, codes), (q_rep, q_x, q_codes) = (
                (t.column("rep").to_numpy(), matrix(t.column("v").combine_chunks()), t.column("code").to_numpy().view(np.uint64)) for t in (left, right)
            )
            q, row, score = nearest_in_block(rep, x, codes, q_x, q_codes, right.column("floor").to_numpy(), key[0].as_py(), radius, keep)
            ids = left.column("ids").combine_chunks().take(pa.array(row)).cast(FOUND.field("ids").type)
            out = [pa.RecordBatch.from_arrays([pa.array(q_rep[q]), ids, pa.array(score)], schema=FOUND)]
        return pa.Table.from_batches(out, FOUND)

    dealt = dealt.select(*key, "rep", "ids", "v", "code").groupBy(*key)
    asked = asked.select(*key, "rep", "v", "code", "floor").groupBy(*key)
    found = dealt.cogroup(asked).applyInArrow(search, "query long, ids array<long>, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))
    return found.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, cover: float = COVER, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product found for each query, its own row left out.

    Codes are learned from FIT_ROWS vectors, the radius from PROBE_ROWS queries that are searched exactly over all rows;
    both samples are fixed by hash. Everything else covers all rows: each is indexed in every part, pigeonhole probing
    finds every code within the radius, and the inner products are taken from the vectors themselves in double precision.
    Queries that find fewer than ``k`` rows look again within wider radii, until they have them or have seen every row.
    Equal vectors are one entry with their smallest ids, equal query vectors are searched once.

    Equal scores rank by id. Vectors that are null, zero, hold null or non-finite components, have no id, or another
    length than most vectors take no part, neither as rows nor as queries. Rows that repeat id and vector count once. A query whose
    vector is not in the table is answered as well. Empty tables give an empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    keep = k + 1
    index = stored(distinct_vectors(usable(vectors, vec_id, embedding), keep), "vectors")
    asked = usable(queries, vec_id, embedding).distinct()
    same = asked.groupBy("v").agg(F.min("id").alias("rep"))
    codes, sample = _fit(index)
    same = same.where(F.size("v") == sample.shape[1])
    if codes is None or same.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = stored(_asked(same, codes, sample, keep), "queries")
    coded = stored(_coded(index, codes), "coded")
    radius = fitted_radius(coded, same, keep, cover)
    near = stored(neighbours(coded, same, radius, keep), "near")
    while radius < BITS:
        enough = near.groupBy(F.col("query").alias("rep")).agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= keep)
        rest = stored(same.join(enough, "rep", "left_anti"), "rest")
        if rest.isEmpty():
            break
        radius = min(BITS, radius + WIDER)
        near = near.join(rest.select(F.col("rep").alias("query")), "query", "left_anti")
        near = stored(near.unionByName(neighbours(coded, rest, radius, keep)), "near")
    near = near.select("query", "score", F.explode("ids").alias("vec_id"))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= keep)
    # The nearest of a vector serve all queries that carry it, each without itself.
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    lists = lists.join(same.select(F.col("rep").alias("query"), "v"), "query")
    own = asked.join(lists, "v").select(F.col("id").alias("query_id"), F.filter("near", lambda n: n["vec_id"] != F.col("id")).alias("near"))
    ranked = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "n"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op12_mih(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
