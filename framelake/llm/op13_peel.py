"""Conversation prefix trie by truncation peeling: from the deepest turns up, strip the last turn and group again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import over_batches, stored
from framelake.llm.op02_interleave import _HALF

SHARED_GROUP, HEADS = 20, 4
SUBTREE_TURNS = 50_000  # a subtree with more turns in a run of levels is peeled by grouped jobs, others in one task
ID_BLOCK = 65_536  # ids of one block are one string before they are hashed

WORDS = r"[^\x20\x09-\x0D]+"
STATE = "depth long, hi long, lo long, conv long, n long, children long, leaves long, saved long"


def _halves(text: Column) -> tuple[Column, Column]:
    """120 bits of the SHA-256 as two longs."""
    digest = F.sha2(text, 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, at, hi, lo, words): turns numbered from 1, their role and text as a digest. Only digests are shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    hi, lo = _halves(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), hi.alias("hi"), lo.alias("lo"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "hi", "lo")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("at"), "hi", "lo", "words")


def shared_heads(turns: DataFrame, group: int = SHARED_GROUP, heads: int = HEADS) -> DataFrame:
    """(conv, depth, hi, lo, words): conversations rebuilt with the first turns of conversation c - c % group; depth 0 marks each."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv").agg(F.max("at").alias("own")).select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    has = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    convs = convs.join(has, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("given"))
    own = turns.join(convs, "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("given")).alias("depth"), "hi", "lo", "words")
    first = turns.where(F.col("at") < heads).withColumnRenamed("conv", "base")
    given = convs.join(first, "base").where("at <= h").select("conv", F.col("at").alias("depth"), "hi", "lo", "words")
    return own.unionByName(given).unionByName(convs.selectExpr("conv", "0L AS depth", "0L AS hi", "0L AS lo", "0L AS words"))


def _level(depth: Column) -> Column:
    """Run of levels of a depth: 1, 2, 3 to 4, 5 to 8, 9 to 16 and so on."""
    return F.when(depth <= 1, 0).otherwise(F.length(F.bin(depth - 1)))


def peel_subtree(rows: list[tuple], top: int) -> Iterator[tuple]:
    """All nodes below ``top`` of one subtree, deepest first, then what is left at ``top``.

    Rows are (depth, hi, lo, conv, n, children, leaves, saved, run); ``run`` holds (hi, lo, words) of the turns from ``top``
    to the depth. Conversations that end at a depth meet the nodes that survive there; each group is a node, loses its last
    turn and goes on.
    """
    waiting: dict[int, dict] = {}

    def meet(depth, key, conv, n, children, leaves, saved, run):
        node = waiting.setdefault(depth, {}).setdefault(key, [conv, 0, 0, 0, 0, run])
        node[0] = min(node[0], conv)
        for at, value in enumerate((n, children, leaves, saved), 1):
            node[at] += value

    for depth, hi, lo, *state in rows:
        meet(depth, (hi, lo), *state)
    for depth in range(max(waiting, default=top), top, -1):
        for (hi, lo), (conv, n, children, leaves, saved, run) in waiting.pop(depth, {}).items():
            last = run[depth - top - 1]
            above, leaves, saved = (hi ^ last[0], lo ^ last[1]), leaves if children else 1, saved + (n - 1) * last[2]
            yield depth, hi, lo, conv, n, children, leaves, saved, *above
            meet(depth - 1, above, conv, n, 1, leaves, saved, run)
    for (hi, lo), (conv, n, children, leaves, saved, _) in waiting.get(top, {}).items():
        yield top, hi, lo, conv, n, children, leaves, saved, None, None


NODE = pa.schema([*[(c.split()[0], pa.int64()) for c in STATE.split(", ")], ("up_hi", pa.int64()), ("up_lo", pa.int64())])


def _peel_in_tasks(rows: DataFrame, top: int) -> DataFrame:
    names = [f.name for f in NODE][:-2]

    def peel(table: pa.Table) -> pa.Table:
        runs = ([(t["hi"], t["lo"], t["words"]) for t in run] for run in table.column("run").to_pylist())
        state = zip(*(table.column(c).to_pylist() for c in names), runs, strict=True)
        found = list(peel_subtree(state, top))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=NODE)

    return rows.groupBy("root_hi", "root_lo").applyInArrow(peel, f"{STATE}, up_hi long, up_lo long")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per node of a depth; all its rows have the same turns, so any run serves."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    return rows.groupBy("depth", "hi", "lo").agg(F.min("conv").alias("conv"), *sums, F.first("run").alias("run"))


def _peel_in_jobs(rows: DataFrame, top: int, deepest: int) -> list[DataFrame]:
    """The same level by level, one job each: counts are summed before the shuffle, so a hot subtree gathers nowhere."""
    out, left = [], None
    for depth in range(deepest, top, -1):
        here = rows.where(F.col("depth") == depth).drop("root_hi", "root_lo")
        nodes = _grouped(here if left is None else here.unionByName(left))
        last = F.element_at("run", F.lit(depth - top))
        nodes = nodes.withColumns({"leaves": F.when(F.col("children") > 0, F.col("leaves")).otherwise(1), "saved": F.col("saved") + (F.col("n") - 1) * last["words"]})
        nodes = stored(nodes.withColumns({"up_hi": F.col("hi").bitwiseXOR(last["hi"]), "up_lo": F.col("lo").bitwiseXOR(last["lo"])}), "nodes")
        out.append(nodes.drop("run"))
        left = nodes.select((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), "conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved", "run")
    nothing = F.lit(None).cast("long")
    return [*out, _grouped(left).drop("run").withColumns({"up_hi": nothing, "up_lo": nothing})]


def peeled(turns: DataFrame, subtree_turns: int = SUBTREE_TURNS) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of rebuilt turns. Nodes have their parent's digest, ends are (conv, depth, hi, lo) of every conversation.

    A prefix is the XOR of digests of its turns, each taken with its place, so the last turn can be stripped from it. Levels
    are taken in runs that double (1, 2, 3-4, 5-8, ...), from the deepest: the number of runs grows with the logarithm of
    the longest conversation. Within a run, subtrees are independent; those of up to ``subtree_turns`` turns are peeled in
    one task, larger ones by one grouped job a level.
    """
    tag = [F.when(F.col("depth") > 0, half).otherwise(0) for half in _halves(F.concat_ws(":", "depth", "hi", "lo"))]
    tagged = turns.select("conv", "depth", tag[0].alias("hi"), tag[1].alias("lo"), "words").withColumn("level", _level(F.col("depth")))
    run = F.sort_array(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "hi", "lo", "words"))))
    parts = stored(tagged.groupBy("conv", "level").agg(run.alias("run"), F.bit_xor("hi").alias("x_hi"), F.bit_xor("lo").alias("x_lo"), F.max("depth").alias("depth")), "turns")
    ends = stored(parts.groupBy("conv").agg(F.max("level").alias("level"), F.max("depth").alias("depth"), F.bit_xor("x_hi").alias("hi"), F.bit_xor("x_lo").alias("lo")), "ends")
    deepest = ends.agg(F.max("level")).first()[0]
    nothing = F.lit(0).cast("long")
    fresh = ends.select("level", "depth", "hi", "lo", "conv", F.lit(1).cast("long").alias("n"), nothing.alias("children"), nothing.alias("leaves"), nothing.alias("saved"))
    out, left = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        top = (1 << level) >> 1
        rows = fresh.where((F.col("level") == level) & (F.col("depth") > 0)).drop("level")
        rows = rows if left is None else rows.unionByName(left)
        rows = rows.join(parts.where(F.col("level") == level).select("conv", "run", "x_hi", "x_lo"), "conv")
        root = {"root_hi": F.col("hi").bitwiseXOR(F.col("x_hi")), "root_lo": F.col("lo").bitwiseXOR(F.col("x_lo"))}
        rows = stored(rows.withColumns(root).drop("x_hi", "x_lo"), "rows")
        sizes = rows.groupBy("root_hi", "root_lo").agg(F.sum(F.col("depth") - top).alias("turns"))
        large = stored(sizes.where(F.col("turns") > subtree_turns).select("root_hi", "root_lo"), "large")
        found = []
        if large.isEmpty():
            found.append(_peel_in_tasks(rows, top))
        else:
            found.append(_peel_in_tasks(rows.join(large, ["root_hi", "root_lo"], "left_anti"), top))
            hot = stored(rows.join(large, ["root_hi", "root_lo"], "left_semi"), "hot")
            found += _peel_in_jobs(hot, top, hot.agg(F.max("depth")).first()[0])
        nodes = stored(reduce(DataFrame.unionByName, found), "nodes")
        out.append(nodes.where(F.col("depth") > top))
        left = nodes.where(F.col("depth") == top).drop("up_hi", "up_lo")
    # The root: everything that is left, and conversations without a turn.
    rest = fresh.where("depth = 0").drop("level")
    rest = rest if left is None else rest.unionByName(left)
    root = rest.groupBy("depth", "hi", "lo").agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    root = root.withColumns({"leaves": F.when(F.col("children") > 0, F.col("leaves")).otherwise(1), "up_hi": F.lit(None).cast("long"), "up_lo": F.lit(None).cast("long")})
    return reduce(DataFrame.unionByName, [root, *out]), ends.drop("level")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256) of nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas.

    Ids of a block of ID_BLOCK numbers are sorted and joined first; one hash runs over a node's blocks in order, holding one
    block at a time, so the members of a common conversation are never gathered.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("depth", "hi", "lo", F.floor(F.col("conv") / ID_BLOCK).alias("block")).agg(ids.alias("ids"))

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "hi", "lo", "ids")), strict=True):
                if key != now:
                    out += [(*now, sha.hexdigest())] if now else []
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(out)
        yield _digests([(*now, sha.hexdigest())] if now else [])

    ordered = blocks.repartition("depth", "hi", "lo").sortWithinPartitions("depth", "hi", "lo", "block")
    return over_batches(ordered, digest, "depth long, hi long, lo long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["depth", "hi", "lo", "ends_sha256"])


def prefix_trie(turns: DataFrame, subtree_turns: int = SUBTREE_TURNS) -> DataFrame:
    """One row per distinct run of first turns of (conv, depth, hi, lo, words) turns; see ``op13_peel`` for the columns."""
    nodes, ends = peeled(turns, subtree_turns)
    nodes = stored(nodes, "trie")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv").alias("parent_conv_id"))
    whole = nodes.join(parents, ["depth", "up_hi", "up_lo"], "left").join(ends_digests(ends), ["depth", "hi", "lo"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_peel(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations.

    Turns are ordered by ``turn``, null first; equal ones by role, then by a digest of role and text, so repeated rows are
    turns of their own. Null roles and texts are empty. Rows without a conversation id take no part. A conversation without
    turns is a member of the root. An empty table has no nodes. Other columns are left out.
    """
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return prefix_trie(shared_heads(stored(turns(conversations, "conv_id", "turn", "role", "text"), "turns")))


_CRC = f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..')], lambda c, h: {_HALF.format(_HALF.format('xor(c, h)'))}))"
ORACLE = rf"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS at FROM r),
    c AS (SELECT conv_id, count(*) AS own, {_CRC} % {HEADS} AS h, conv_id - conv_id % {SHARED_GROUP} AS base FROM t GROUP BY 1),
    b AS (SELECT t.conv_id, t.at - c.h + least(c.h, coalesce(o.own, 0)) AS depth, role, text FROM t JOIN c USING (conv_id) LEFT JOIN c o ON o.conv_id = c.base WHERE t.at > c.h
          UNION ALL SELECT c.conv_id, t.at, role, text FROM c JOIN t ON t.conv_id = c.base AND t.at <= c.h),
    p AS (SELECT conv_id, depth::BIGINT AS depth, list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM b
          UNION ALL SELECT conv_id, 0, [], 0 FROM c),
    l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
    n AS (SELECT p.depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
                 coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.depth), '') AS ends FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY p.depth, path),
    k AS (SELECT u.depth, u.path, count(*) AS n_children FROM n JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[:-2] GROUP BY 1, 2),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
    s AS (SELECT p.depth, p.path, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY 1, 2)
    SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
    FROM m JOIN s USING (depth, path) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.path = m.path[:-2]"""
