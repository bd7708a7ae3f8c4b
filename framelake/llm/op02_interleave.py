"""Proportional stratified interleaving: shards that all carry the mixture of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import bucket_count, documents, ranked

SHARDS, SEED = 16, 20240607


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", stratum: str = "source") -> DataFrame:
    """Deal all rows into ``shards`` whose row counts differ by one at most and whose strata match the whole table.

    Rows of a stratum are ordered by a seeded hash of the key and get the fraction (rank + 0.5) / rows of the stratum. The
    table sorted by fraction is cut into equal runs, so a run holds each stratum's share to within one row. Ranks are
    taken inside hash buckets plus bucket starts, so a stratum with most of the rows is spread over many tasks, and the
    fractions are even, so the second order is too. Rows whose key and stratum are the same may trade places.

    Adds ``shard`` and ``slot`` (from 0 without gaps). Null keys hash as an empty string; null strata form one of their
    own. An empty table gives an empty result. Other columns pass through, those named like the new ones are replaced.
    """
    rows = docs.count()
    nb = bucket_count(rows)
    dealt = docs.drop("shard", "slot").withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = dealt.withColumn("_key", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))
    sizes = dealt.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))
    dealt = ranked(dealt, ["_stratum"], F.expr(f"shiftright(_key, {48 - nb.bit_length() + 1})"), ["_key", key], "_rank")
    dealt = dealt.join(sizes, "_stratum").withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_rows"))
    whole = ranked(dealt, [], F.floor(F.col("_fraction") * nb), ["_fraction", "_stratum"], "_place")
    place = whole.withColumn("shard", F.expr(f"CAST((_place * {shards}L) div {max(rows, 1)}L AS INT)"))
    start = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    return place.withColumn("slot", F.col("_place") - start).drop("_stratum", "_key", "_rank", "_rows", "_fraction", "_place")


def op2_interleave(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, folder).select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def _half_bytes() -> list[int]:
    """CRC-32 remainders (reversed polynomial 0xEDB88320) of half bytes, for the twin in SQL."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_HALF = "xor({0} >> 4, %s[({0} & 15) + 1])" % _half_bytes()
ORACLE = f"""
    WITH b AS (SELECT doc_id, source, coalesce(text, '') AS text, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes FROM documents),
    c AS (SELECT doc_id, source, strlen(text) + 1 AS size,
                 xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || bytes, lambda c, h: {_HALF.format(_HALF.format("xor(c, h)"))})) AS text_crc32,
                 ('0x' || substr(md5('{SEED}' || coalesce('-' || doc_id, '')), 1, 12))::BIGINT AS key FROM b),
    f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY fraction, coalesce('=' || source, '')) - 1 AS place, count(*) OVER () AS n FROM f)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * {SHARDS} // n)::INT AS shard,
           place - (place * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, source FROM p"""
