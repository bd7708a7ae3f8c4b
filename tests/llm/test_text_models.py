import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import op01_imatch as imatch
from framelake.llm import op05_context_tree as ctw
from framelake.llm import op07_language as language
from framelake.llm.common import as_bytes

SMALL = "/root/testdata/sf0.001"


def documents_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def set_up(texts, lexicon):
    """Brute force: hash the sorted terms of each subset one by one."""
    out = []
    terms = sorted(int(h) for h in imatch.word_hashes(list(imatch.terms_of(texts))))
    known = [t for t in terms if t in lexicon] or terms
    for s in range(imatch.SUBSETS):
        total, k = 0, 0
        for t in known:
            if ((t ^ int(imatch.SALTS[s])) * 0xBF58476D1CE4E5B9 % 2**64) >> 32 < int(imatch.LIMITS[s]):
                total += t * int(imatch.POWERS[k & 4095]) + (k >> 12)
                k += 1
        value = int(imatch.mixed(np.array([(total + int(imatch.SALTS[s])) % 2**64], np.uint64))[0])
        out.append(value % 65535 + 1 if k else 0)
    return out


def test_fingerprint_by_brute_force(spark):
    texts = [t for t in documents_of(spark).values()][:12] + ["", "one", "a b a b"]
    words = Counter(w for t in texts for w in imatch.terms_of(t))
    lexicon = np.sort(imatch.word_hashes([w for w, n in words.items() if n <= 3]))
    for text in texts:
        assert imatch.fingerprint(text, lexicon).tolist() == (set_up(text, set(lexicon.tolist())) if imatch.terms_of(text) else [0] * imatch.SUBSETS)


def test_lexicon_is_the_band(spark):
    texts = documents_of(spark)
    frequency = Counter(w for t in texts.values() for w in imatch.terms_of(t))
    low, high = imatch.LEAST_SHARE * len(texts), imatch.MOST_SHARE * len(texts)
    want = np.sort(imatch.word_hashes([w for w, n in frequency.items() if low <= n <= high]))
    assert np.array_equal(imatch.lexicon_of(spark.read.parquet(f"{SMALL}/documents.parquet")), want)


def test_edited_and_next(spark):
    texts = sorted(documents_of(spark).items(), reverse=True)
    rows = {r["doc_id"]: r for r in imatch.op1_imatch(spark, SMALL).collect()}
    assert len(rows) == len(texts)
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[1][:cut]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints = [np.frombuffer(bytes.fromhex(rows[j][c]), ">u2") for j, c in ((i, "fingerprint"), (i, "edited_fingerprint"), (following[0], "fingerprint"))]
        assert rows[i]["near_edited"] == imatch.likeness(prints[0], prints[1])
        assert rows[i]["near_next"] == imatch.likeness(prints[0], prints[2])
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.95


def test_fingerprints_of_odd_rows(odd, empty):
    lexicon = imatch.lexicon_of(odd)
    rows = imatch.compared_with_next(odd, lexicon).collect()
    assert len(rows) == odd.count()
    by_text = {}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert imatch.compared_with_next(empty, lexicon).count() == 0
    single = imatch.compared_with_next(odd.where("doc_id = 1"), lexicon).collect()
    assert [(r["doc_id"], r["near_next"]) for r in single] == [(1, 1.0)]


def reference_tree(texts, depth):
    """Context-tree weighting by its recursive definition, with exact sums over contexts of bytes."""
    counts: dict = {}
    for text in texts:
        flat = ctw.END * depth + ctw.sequence(text)
        for i in range(depth, len(flat)):
            for d in range(depth + 1):
                name = 1
                for level in range(8):
                    bit = flat[i] >> (7 - level) & 1
                    counts.setdefault((flat[i - d : i], name), [0, 0])[bit] += 1
                    name = name << 1 | bit

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children: dict = {}
    for context, name in counts:
        if context:
            children.setdefault((context[1:], name), []).append((context, name))
    weighted: dict = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        longer = sum(weighted[c] for c in children.get(key, [])) if children.get(key) else own
        weighted[key] = np.logaddexp(own, longer) - math.log(2)

    def predict(past, symbol):
        total, name = 0.0, 1
        for level in range(8):
            bit, one = symbol >> (7 - level) & 1, None
            for d in range(depth, -1, -1):
                key = (past[len(past) - d :], name)
                if key in counts:
                    own = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
                    stop = math.exp(kt(*counts[key]) - math.log(2) - weighted[key])
                    one = own if one is None else stop * own + (1 - stop) * one
            one = 0.5 if one is None else one
            total += math.log(one if bit else 1 - one)
            name = name << 1 | bit
        return total

    return predict


def test_context_tree_by_definition(spark):
    depth, texts = 2, [b"the cat sat", b"The hat", b"", b"a cat, a hat"]
    frame = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
    tree, want = ctw.learn_tree(frame, depth, share=0), reference_tree(texts, depth)
    for text in [*texts, b"zebra cat", b"\xff\xfe"]:
        keys, lengths = ctw.grams_of([ctw.sequence(text)], depth)
        flat = ctw.END * depth + ctw.sequence(text)
        expected = [want(flat[i - depth : i], flat[i]) for i in range(depth, len(flat))]
        assert int(lengths[0]) == len(expected)
        np.testing.assert_allclose(tree.log_probability(keys), expected, rtol=1e-5)
    for context in (b"he", b"zz"):  # all bytes together have probability one
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert abs(np.exp(tree.log_probability(keys)).sum() - 1) < 1e-6


def test_scores(spark):
    texts = documents_of(spark)
    training = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter(w for t in training.values() for w in t.encode().lower().split())
    total, distinct = sum(counts.values()) + len(training), len(counts) + 1
    for r in ctw.op5_context_tree(spark, SMALL).collect():
        words = texts[r["doc_id"]].encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((len(training) + 1) / (total + distinct + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        assert r["held_out"] == (r["doc_id"] not in training)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


def test_rare_words_are_joined(spark):
    """With no broadcast words at all the base scores are the same."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", (F.col("doc_id") % 2 == 0).alias("held_out"), as_bytes("text").alias("text"))
    training = docs.where("NOT held_out").select("text")
    few, many = (ctw.score_texts(docs, training, depth=1, word_share=s).collect() for s in (1.0, 0.0))
    for a, b in zip(sorted(few), sorted(many), strict=True):
        assert a["n_known"] == b["n_known"] and abs(a["base_score"] - b["base_score"]) < 1e-6


def test_scores_of_odd_rows(odd, empty):
    docs = odd.select("doc_id", F.lit(False).alias("held_out"), as_bytes("text").alias("text"))
    rows = ctw.score_texts(docs, docs.select("text"), depth=2).collect()
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    none = ctw.score_texts(docs, docs.where("false").select("text"), depth=2).collect()
    assert all(abs(r["bits_per_byte"] - 8) < 1e-9 and r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert ctw.score_texts(docs.where("false"), docs.select("text"), depth=2).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    found = language.op7_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_viterbi_by_brute_force():
    model = language.LanguageModel(["a", "b", "c"], np.zeros((language.BUCKETS, 3), np.float32), np.ones((len(language.NAMES), 3), bool))
    rng = random.Random(5)
    texts = [rng.choices(range(1, 6), k=k) for k in (0, 1, 2, 5, 6, 6)]
    model.scores = [np.array([[0, 0, 0]] + [[-8 * rng.random() for _ in range(3)] for _ in range(5)], np.float32)]
    for text, got in zip(texts, model.label([np.array(t, np.int64) for t in texts]), strict=True):
        value = lambda path: sum(model.scores[0][u][p] for u, p in zip(text, path, strict=True)) - language.SWITCH * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(value(got.tolist()) - max(map(value, product(range(3), repeat=len(text))))) < 1e-4


def test_language_spans_and_scripts(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog went home " * 5, "en"), ("der hund und die katze gehen heim " * 5, "de"), ("кот и собака идут домой " * 5, "ru")])]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    texts = [(1, "the dog and the cat went home der hund und die katze gehen heim"), (2, "собака домой"), (3, "123 !!"), (4, None), (5, ""), (6, "日本語")]
    rows = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [(s["first_word"], s["n_words"], s["lang"]) for s in rows[1]["spans"]] == [(0, 7, "en"), (7, 7, "de")]
    assert (rows[2]["lang_pred"], rows[2]["score"]) == ("ru", 1.0)
    assert {(rows[i]["lang_pred"], rows[i]["score"]) for i in (3, 4, 5)} == {("und", 0.0)}
    assert rows[6]["lang_pred"] in ("de", "en", "ru")


def test_language_of_odd_rows(odd, empty):
    model = language.train(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 9)} == {"und"}
    assert language.identify(empty, model).count() == 0
    nothing = language.identify(odd, language.train(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and {r["score"] for r in nothing} == {0.0}


@pytest.mark.parametrize("sizes", [(1, 1), (7, 3), (5000, 2)])
def test_likeness_estimates_jaccard(sizes):
    rng = random.Random(sum(sizes))
    words = [f"w{rng.random()}" for _ in range(sizes[0])]
    a, b = " ".join(words), " ".join(words[: max(1, len(words) // 2)])
    none = np.zeros(0, np.uint64)
    assert imatch.likeness(imatch.fingerprint(a, none), imatch.fingerprint(a, none)) == 1.0
    assert 0.0 <= imatch.likeness(imatch.fingerprint(a, none), imatch.fingerprint(b, none)) <= 1.0
    assert imatch.likeness(imatch.fingerprint(a, none), imatch.fingerprint("", none)) == 0.0


def test_scores_use_every_context(spark):
    """With the defaults, over more than a megabyte, contexts met once still count: the scores are those of the whole tree."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)).encode() for _ in range(1000)]
    texts += [b"quizzical zephyrs vex", b"", b"quizzical zephyr \xff"]
    assert sum(map(len, texts)) > 1.2 * 2**20
    rows = [(i, i % 5 == 0 and i < 1000 or i == 1002, bytearray(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text binary").repartition(3)
    tree = ctw.learn_tree(docs.where("NOT held_out").select("text"))
    for training in (docs.where("NOT held_out").select("text"), None):
        found = {r["doc_id"]: r["score"] for r in ctw.score_texts(docs, training).collect()}
        assert len(found) == len(texts)
        for i in (0, 1, 5, 999, 1000, 1001, 1002):
            want = tree.log_probability(ctw.grams_of([ctw.sequence(texts[i])], ctw.DEPTH)[0]).sum() / math.log(10)
            assert abs(found[i] - want) < 1e-5 * abs(want)


def test_batches_of_texts_are_bounded(spark):
    """A task gets texts in Arrow batches of a few megabytes."""
    import pyarrow as pa

    from framelake.llm.common import ARROW_BYTES, over_batches

    rows = spark.range(0, 5000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    sizes = over_batches(rows, lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 2 * ARROW_BYTES


@pytest.mark.parametrize("held", [300, 1 << 30])
def test_asked_grams_keep_their_counts(monkeypatch, held):
    """Sorted n-grams of a chunk come once a flush, with the times that training texts have them, however often they are merged."""
    import pyarrow as pa

    monkeypatch.setattr(ctw, "over_batches", lambda texts, function, schema: function)
    monkeypatch.setattr(ctw, "CHUNK_GRAMS", held)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "Abc", "b\xe9", "x", "yz"], k=rng.randrange(0, 40))).encode() for _ in range(120)]
    chunks, trains = [i // 50 for i in range(120)], [i % 3 > 0 for i in range(120)]
    batch = pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int64()), "trains": trains, "text": pa.array(texts, pa.binary())})
    want, found = Counter(), Counter()
    for chunk, train, text in zip(chunks, trains, texts, strict=True):
        for gram in ctw.grams_of([ctw.sequence(text)], ctw.DEPTH)[0].tolist():
            want[chunk, gram] += train
    frame = type("Frame", (), {"select": lambda self, *columns: self})()
    for rows in ctw.asked_grams(frame, ctw.DEPTH, 16)(batch.slice(i, 7) for i in range(0, 120, 7)):
        for bucket, chunk, grams, counts in zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True):
            turns = ctw.unpacked(grams)
            assert np.array_equal(turns, np.unique(turns)) and len(counts) == 4 * len(turns)
            assert set(ctw.bucket_of(ctw.turned_back(turns), 16).tolist()) == {bucket}
            found.update({(chunk, g): n for g, n in zip(ctw.turned_back(turns).tolist(), np.frombuffer(counts, np.int32).tolist(), strict=True)})
    assert {k: n for k, n in want.items()} == {k: found[k] for k in found}


@pytest.mark.parametrize("n", [1, 2, 50_000])
def test_values_are_found_by_hash(n):
    grams = np.unique(np.random.default_rng(n).integers(0, 1 << 56, n))
    asked = np.random.default_rng(1).choice(grams, 3 * n)
    assert np.array_equal(ctw.Found(grams, grams.astype(np.float64)).of(asked), asked.astype(np.float64))
    with pytest.raises(IndexError):
        ctw.Found(np.array([5]), np.array([1.0])).of(np.array([6]))
