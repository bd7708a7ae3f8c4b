"""Lexical search, nearest neighbours and the conversation trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference

from framelake.llm import op11_nra, op12_mih, op13_peel

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- ranked lexical search ------------------------------------------------------------------------


def terms(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def ranked(docs, items, k):
    """(item, rank, doc, score) straight from the formula; nulls rank last among equal scores."""
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc_id, bag in bags:
            score, n = 0, bag.total()
            for w in words & set(bag):
                m = 50 + (50 * n * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 20 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the Quick brown FOX"), (2, "word7 word8 cat dog word7"), (3, None), (4, ""), (5, "日本語 привет éàü"), (6, "nowhere"), (7, "the"), (7, "12 34"), (None, "fox!")]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'clash' AS doc", "1 AS number", "2 AS rank")


@pytest.mark.parametrize("k", [1, 2, 50])
def test_search_by_brute_force(spark, odd, items, k):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows(op11_nra.search(odd, items, k)) == ranked(docs, ITEMS, k)


def test_search_in_blocks_and_pieces(spark, odd, items, monkeypatch):
    """Several passes over items, texts cut into pieces, and many shards in a task change nothing."""
    expected = rows(op11_nra.search(odd, items))
    for name, value in (("QUERY_TERMS", 3), ("PIECE", 16), ("SHARD_DOCS", 2), ("FIRST_READ", 1)):
        monkeypatch.setattr(op11_nra, name, value)
    assert rows(op11_nra.search(odd, items)) == expected


def test_search_of_empty_tables(spark, empty, odd, items):
    assert op11_nra.search(empty, items).count() == 0
    assert op11_nra.search(odd, items.where("false")).count() == 0


def shard_of(bags, n_docs, n_terms):
    lists = [pa.ListArray.from_arrays(np.cumsum([0] + [len(b) for b in bags]).astype(np.int32), pa.array([v for b in bags for v in get(b)], kind)) for get, kind in ((dict.keys, pa.int32()), (dict.values, pa.int64()))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bags))), pa.array([sum(b.values()) for b in bags]), *lists], ["doc", "n", "terms", "tfs"])
    return op11_nra.Shard([batch], n_docs, n_terms)


def test_score_intervals(monkeypatch):
    """Bounds hold the final score in every round, lists stop early, and the k best with all their ties are left."""
    monkeypatch.setattr(op11_nra, "FIRST_READ", 4)
    rng = np.random.default_rng(3)
    bags = [{int(t): int(rng.integers(1, 5)) for t in np.unique(rng.zipf(1.3, 12) % 40)} for _ in range(700)]
    shard = shard_of(bags, 700, sum(sum(b.values()) for b in bags))
    weights = rng.integers(0, 4000, 40)
    stopped = 0
    for _ in range(30):
        query = np.unique(rng.integers(0, 40, 9))
        final = np.zeros(700, np.int64)
        for t, a, b in zip(shard.terms, shard.starts, shard.ends, strict=True):
            if t in query:
                final[shard.doc[a:b]] += weights[t] * shard.impact[a:b]
        for floor in (0, int(np.sort(final)[-3])):
            trace = []
            docs, scores = op11_nra.no_random_access(shard, query, weights[query], 10, floor, trace)
            for pool, lower, upper, least, unseen in trace:
                assert (lower <= final[pool]).all() and (final[pool] <= upper).all()
                out = np.setdiff1d(np.arange(700), pool)
                assert (final[out] < least).all() or unseen >= least
            assert (scores == final[docs]).all()
            edge = max(np.sort(final)[-10], floor, 1)
            assert set(np.flatnonzero(final >= edge)) <= set(docs.tolist())
            stopped += trace[-1][4] > 0
    assert stopped  # some searches ended before the lists did


# ---- nearest neighbours ---------------------------------------------------------------------------


def vectors(n, dims=24, seed=0, lengths=True):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, dims))
    return x * rng.uniform(0.5, 2, (n, 1)) if lengths else x


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        score = np.array([float((x[q] * v).sum()) for v in x])
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
    return out


def by_query(frame):
    out = defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("lengths", [True, False])
def test_recall(spark, lengths, monkeypatch):
    monkeypatch.setattr(op12_mih, "BLOCK_ROWS", 300)  # several buckets and blocks
    monkeypatch.setattr(op12_mih, "BLOCK_QUERIES", 40)
    x = vectors(3000, lengths=lengths)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(5)
    got = by_query(op12_mih.search(table, table.where("vec_id % 20 = 0")))
    want = exact(np.arange(3000), x, range(0, 3000, 20), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / (20 * len(want)) >= 0.9
    for q, near in got.items():
        assert np.allclose([s for _, s in near], [x[q] @ x[i] for i, _ in near], rtol=1e-12)


def test_copies_ties_and_odd_vectors(spark):
    base = vectors(60, dims=8, seed=4)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0].tolist()) for i in range(200)]  # copies: ties go to smaller ids
    rows += [rows[5], (2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0] * 3), (None, [1.0] * 8), (2006, [])]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS code", "1 AS rank", "2 AS part", "3 AS bucket", "'c' AS v").repartition(4)
    got = by_query(op12_mih.search(table, table.where("vec_id % 20 = 0"), cover=1.0))
    ids = np.array([*range(60), *range(1000, 1200)])
    x = np.concatenate([base, np.repeat(base[:1], 200, axis=0)])
    want = exact(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert set(got) == set(want)
    hits = 0
    for q in want:
        hits += len({i for i, _ in got[q]} & {i for i, _ in want[q]})
        if {i for i, _ in got[q]} == {i for i, _ in want[q]}:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert hits / sum(map(len, want.values())) >= 0.9
    copies = [i for i, _ in got[0] if i >= 1000]
    assert copies and copies == list(range(1000, 1000 + len(copies)))


def test_few_vectors_and_empty_tables(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, -1.0]), (20, [0.5, 0.5])], SCHEMA)
    got = by_query(op12_mih.search(table, table.where("vec_id % 20 = 0")))
    assert got == {0: [(20, 1.5), (1, 0.0)], 20: [(0, 1.5), (1, 0.5)]}
    assert op12_mih.search(table.where("false"), table).count() == 0
    assert op12_mih.search(table, table.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 5, 11, 20, 27])
def test_probing_finds_every_code_once(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64) for _ in range(n)])
    codes = rng.choice(base, 2000) ^ flips(1 + radius)
    queries = rng.choice(base, 50)
    found = [(int(q), int(r)) for part in range(op12_mih.PARTS) for a, b in op12_mih.probe(codes, queries, part, radius) for q, r in zip(a, b, strict=True)]
    near = np.bitwise_count(queries[:, None] ^ codes[None, :]) <= radius
    assert len(found) == len(set(found))
    assert set(found) == {(int(q), int(r)) for q, r in np.argwhere(near)}


# ---- conversation trie ----------------------------------------------------------------------------


def trie(conversations):
    convs = defaultdict(list)
    for conv, turn, role, text in conversations:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += gain
    ends = {p: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


CONVERSATION = "conv_id long, turn int, role string, text string"


def odd_conversations():
    out = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of   kind {c % 3 if t > 2 else 0}\x1cx") for c in range(60) for t in range(c % 9)]
    out += [(1000 + c, t, "user", f"same {t}") for c in range(300) for t in range(3)]  # one common conversation
    out += [(2000, t, "user", f"long {t}") for t in range(150)] + [(2001, t, "user", f"long {t if t < 140 else -t}") for t in range(145)]
    out += [(7, None, None, "null turn"), (7, 3, "user", None), (7, 3, "user", None), (7, 3, "a", "tie"), (None, 1, "user", "no id"), (-25, 0, None, None), (-20, 0, "", ""), (5000, 0, "user", "w " * 50_000)]
    out += [(70_000 * c, 0, "user", "far apart") for c in range(1, 6)]
    return out


@pytest.mark.parametrize("bound", [50_000, 40, 0])
def test_trie_by_brute_force(spark, tmp_path, bound, monkeypatch):
    """In one task, partly, and level by level."""
    rows = odd_conversations() if bound else [r for r in odd_conversations() if r[0] is None or r[0] < 1020]
    monkeypatch.setattr(op13_peel.prefix_trie, "__defaults__", (bound,))
    spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "1 AS depth", "'c' AS hi", "2 AS run").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in op13_peel.op13_peel(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(trie(rows), key=str)


def test_trie_of_no_conversations(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x")], CONVERSATION).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_peel.op13_peel(spark, str(tmp_path)).count() == 0


def test_twins_of_odd_tables(spark, odd, tmp_path):
    folder = str(tmp_path)
    odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([i for i in ITEMS if i[0]], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([r for r in odd_conversations() if r[0] is None or r[0] < 1100], CONVERSATION).write.parquet(f"{folder}/conversations.parquet")
    connection = connect("/root/testdata/sf0.001")
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    for query, sql in ((op11_nra.op11_nra, op11_nra.ORACLE), (op13_peel.op13_peel, op13_peel.ORACLE)):
        assert difference(query(spark, folder), connection, sql) is None
