import random
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import op03_trie_join as join
from framelake.llm import op06_super_kmers as kmers
from framelake.llm.common import as_bytes

SMALL = "/root/testdata/sf0.001"


def brute_components(rows, n, share, whole):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and whole * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups=6, copies=12, length=60):
    rng, rows = random.Random(seed), []
    common = [f"c{k}" for k in range(25)]
    for g in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(4, length))] + common * (g % 2)
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
            rows.append((len(rows) * 3 + 1, " ".join(own)))
            if rng.random() < 0.3:
                words = own
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("family_sets", "block"), [(1000, 512), (2, 3)])
@pytest.mark.parametrize(("n", "share"), [(4, 85), (5, 80)])
def test_components_by_brute_force(spark, family_sets, block, n, share):
    """In one task per family, and block by block, which gives the same."""
    rows = near_copies(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.jaccard_components(docs, n, share, 100, family_sets=family_sets, block=block).collect()}
    want = brute_components(rows, n, share, 100)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_join_oracle(spark):
    assert difference(join.op3_trie_join(spark, SMALL), connect(SMALL), join.ORACLE) is None


def test_join_of_odd_rows(odd, empty):
    rows = join.jaccard_components(odd, 4, 85).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert (found[1][1], found[2][1], found[6][1]) == (1, 1, 6)
    assert all(found[i] == (0, i) for i in (3, 4, 5)) and found[7] == (1, 7) and found[9] == (1, 9)
    assert join.jaccard_components(empty, 4, 85).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=14), st.sampled_from([(85, 100), (80, 100), (50, 100)]))
def test_trie_finds_all_links(sets, bound):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    places, width = join.ordered(arrays)
    trie = join.Trie(width, *bound)
    for i, p in enumerate(places):
        trie.add(p, i)
    for i, p in enumerate(places):
        want = [j for j, s in enumerate(sets) if bound[1] * len(s & sets[i]) >= bound[0] * len(s | sets[i])]
        assert sorted(trie.linked(p)) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=18), st.sampled_from([(85, 100), (60, 100), (40, 100)]))
def test_trie_connects_components(sets, bound):
    """Subtrees of the own component may be left out: the components are those of all links."""
    places, width = join.ordered([np.array(sorted(s), np.uint64) for s in sets])
    trie = join.Trie(width, *bound)
    for i, p in enumerate(places):
        trie.connect(p, i)
        trie.add(p, i)
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if bound[1] * len(a & b) >= bound[0] * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert [trie.known.find(i) for i in range(len(sets))] == root


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.sampled_from([(85, 100), (80, 100)]), st.booleans())
def test_linked_sets_share_a_key(seed, size, bound, some_frequent):
    """The most different pair that is still linked has a common key, whatever is frequent."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**64, 3 * size + 4, np.uint64)
    a = np.unique(pool[:size])
    drop = rng.integers(0, len(a) + 1)
    b, k = a, 0
    while True:
        more = np.unique(np.concatenate([np.delete(a, np.s_[: k // 2 if drop % 2 else k]), pool[size : size + (k // 2 if drop % 2 else 0)]]))
        both = len(np.intersect1d(a, more))
        if not len(more) or bound[1] * both < bound[0] * (len(a) + len(more) - both):
            break
        b, k = more, k + 1
        if k > 2 * size:
            break
    sets = object.__new__(join.Sets)
    sets.value, sets.owner = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    sets.size, sets.first = np.array([len(a), len(b)]), np.array([0, len(a)])
    frequent = np.sort(a[::2]) if some_frequent else np.zeros(0, np.uint64)
    owner, key = join.Schemes(*bound).keys(sets, frequent)
    assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def brute_removed(rows, window):
    least, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("hot", [20_000, 0, 2])
@pytest.mark.parametrize("seed", range(2))
def test_repeats_by_brute_force(spark, hot, seed):
    """Passages of few words repeat often; with ``hot`` = 0 all shared windows go the way of very frequent ones."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefg") for _ in range(rng.randint(5, 20))] for _ in range(5)]
    rows = [(rng.randrange(25), " ".join(w for _ in range(rng.randint(0, 5)) for w in (*rng.choice(passages), f"u{rng.randrange(9)}"))) for _ in range(40)]
    rows.append((None, " ".join(passages[0] * 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert_removed(kmers.remove_repeats(docs, 8, 3, hot), docs, brute_removed(rows, 8))


def assert_removed(got, docs, want):
    """The rows are those of brute force, and the tag of each is the hash of the text it was cut from."""
    assert Counter(map(tuple, got.drop("tag").collect())) == want
    tags = docs.select("doc_id", F.xxhash64(as_bytes("text")).alias("tag"))
    assert Counter(map(tuple, got.select("doc_id", "tag").collect())) == Counter(map(tuple, tags.collect()))


def test_repeats_oracle(spark):
    assert difference(kmers.op6_super_kmers(spark, SMALL), connect(SMALL), kmers.ORACLE) is None


def test_repeats_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert_removed(kmers.remove_repeats(odd, 4, 2), odd, brute_removed(rows, 4))
    assert kmers.remove_repeats(empty).count() == 0


def test_places_of_long_sets_take_little_memory():
    """Sets are placed one by one; the n-grams of a family are held about three times, not eight times."""
    import tracemalloc

    import numpy as np

    from framelake.llm.op03_trie_join import Trie, ordered

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 5_000).astype(np.uint64)) for _ in range(100)]
    tracemalloc.start()
    places, width = ordered(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert width == len(np.unique(np.concatenate(sets))) and [len(p) for p in places] == [len(s) for s in sets]
    assert peak < 6 * sum(s.nbytes for s in sets)
    trie = Trie(width, 80, 100)
    for i, p in enumerate(places):
        assert list(trie.linked(p)) == []
        trie.add(p, i)
    assert [list(trie.linked(p)) for p in places] == [[i] for i in range(100)]


def test_sets_are_made_from_a_megabyte_of_text(spark):
    """What a task holds of words, hashes and keys is bounded by that, whatever an Arrow batch holds."""
    import pyarrow as pa

    from framelake.llm.common import row_batch

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("CAST(repeat('a b c ', 500) AS BINARY)").alias("text"))
    schema = pa.schema([("n", pa.int64())])
    rows = join._map_sets(docs, 4, lambda batch, sets: row_batch(schema, [[sum(len(v.as_buffer()) for v in batch.column(1))]]), "n long", 1).collect()
    assert sum(r["n"] for r in rows) == 3000 * 3000 and max(r["n"] for r in rows) <= (1 << 20) + 3000


def long_texts(seed=3, count=14, length=3000, passage=1200):
    """Each long text has a passage in common with the next; some have near copies."""
    rng, rows, last = random.Random(seed), [], []
    for i in range(count):
        words = [*last, *(f"w{rng.randrange(10**6)}" for _ in range(length - len(last)))]
        last = words[-passage:]
        rows.append((i, " ".join(words)))
        for k in range(2 * (i % 4 == 0)):
            own = list(words)
            for _ in range(40):
                own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append((100 + 2 * i + k, " ".join(own)))
    return rows


def test_long_texts_with_passages_in_common_take_no_rounds(spark, monkeypatch):
    """One crowded family by its keys; by half of the keys that linked sets share, only near copies are left together."""
    labels, stored = [], join.stored
    monkeypatch.setattr(join, "stored", lambda df, label: labels.append(label) or stored(df, label))
    rows = long_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.jaccard_components(docs, 5, 80, family_sets=4).collect()}
    want = brute_components(rows, 5, 80, 100)
    assert got == want and len({c for _, c in want.values()}) == 14
    assert "crowds" in labels and "large-links" not in labels


@pytest.mark.parametrize("common", [1, 3, 32])
def test_crowded_families_by_brute_force(spark, monkeypatch, common):
    """Whatever number of sets makes a key a common one."""
    monkeypatch.setattr(join, "COMMON", common)
    rows = near_copies(8) + [(1000 + i, text) for i, text in long_texts(4, 6, 400, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.jaccard_components(docs, 5, 80, family_sets=2, block=3).collect()}
    assert got == brute_components(rows, 5, 80, 100)


def texts_with_one_passage(count=40, length=900, passage=700):
    """Long texts that all have one passage in common, each with a near copy."""
    rng, rows = random.Random(7), []
    common = [f"c{rng.randrange(10**6)}" for _ in range(passage)]
    for i in range(count):
        words = [*common, *(f"w{rng.randrange(10**6)}" for _ in range(length - passage))]
        copy = list(words)
        for _ in range(10):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        rows += [(i, " ".join(words)), (100 + i, " ".join(copy))]
    return rows


def test_texts_with_one_passage_in_common_take_no_rounds(spark, monkeypatch):
    """Keys of that passage are common to all texts; sketches tell them apart, so no round joins a block with all."""
    labels, stored = [], join.stored
    monkeypatch.setattr(join, "stored", lambda df, label: labels.append(label) or stored(df, label))
    rows = texts_with_one_passage()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.jaccard_components(docs, 5, 80, family_sets=4).collect()}
    want = brute_components(rows, 5, 80, 100)
    assert got == want and len({c for _, c in want.values()}) == 40
    assert "crowds" in labels and "large-links" not in labels


@pytest.mark.parametrize("chunk, sets", [(1, 65_536), (3, 65_536), (2048, 65_536), (3, 6)])
def test_sketches_by_brute_force(spark, monkeypatch, chunk, sets):
    """However many chunks a family has; families of over ``sets`` sets are told apart by keys."""
    monkeypatch.setattr(join, "SKETCH_CHUNK", chunk)
    monkeypatch.setattr(join, "SKETCH_SETS", sets)
    rows = near_copies(9) + [(1000 + i, text) for i, text in long_texts(5, 6, 400, 150)] + [(7, "a b c"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, join.jaccard_components(docs, 5, 80, family_sets=1, block=3).select("doc_id", "component_id").collect()))
    single = {r["doc_id"]: r["component_id"] for r in join.jaccard_components(docs, 5, 80).collect()}
    assert got == Counter((i, single[i]) for i, _ in rows)


def test_sketches_differ_in_no_more_bits_than_sets():
    """Linked pairs of one side or of two are in one component, others are not; sketches have two widths."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 20_000, np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1200, 2000))) for _ in range(60)]
    sets += [np.unique(np.append(s[: len(s) - len(s) // 12], pool[:2])) for s in sets]
    held = object.__new__(join.Sets)
    held.value, held.size = np.concatenate(sets), np.array([len(s) for s in sets])
    held.first = np.cumsum(held.size) - held.size
    sketches = join._sketches(held)
    assert all(len(s) == max(8, (1 << (n - 1).bit_length()) // 8) for s, n in zip(sketches, held.size.tolist(), strict=True))
    for side in (np.zeros(len(sets), bool), np.arange(len(sets)) >= 60):
        known = join.Components()
        for a, b in join._like(sketches, held.size, side, 80, 100):
            known.union(a, b)
        linked = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both) and (side[i] != side[j] or not side.any()):
                    linked += 1
                    assert known.find(i) == known.find(j)
        assert linked >= 30
        assert len({known.find(i) for i in range(len(sets))}) >= 20
