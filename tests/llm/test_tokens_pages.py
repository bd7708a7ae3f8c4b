import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framelake.llm import op08_html as pages
from framelake.llm import op09_pieces as pieces
from framelake.llm import op10_packing as packing

SMALL = "/root/testdata/sf0.001"
MODEL = pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
VOCABULARY = packing.default_vocabulary()
ALPHABET = ["▁", " ", "  ", "   ", "a", "e", "th", "the", "in", "\n", "\t", "é", "日", "😀", "<s>", "<0x0A>", "x", "!!", "00", "\r\n", "▁▁", "\x00", "ing", "...", "----"]


@pytest.fixture(scope="module")
def model():
    return pieces.piece_model(MODEL)


def test_pieces_of_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in pieces.op9_pieces(spark, SMALL).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=30))
def test_pieces_equal_the_library(text):
    model = pieces.piece_model(MODEL)
    text = text.encode("utf-8", "replace").decode()
    ids = model.encode(text)
    assert ids == LIBRARY.encode(text)
    assert model.decode(ids) == LIBRARY.decode(ids)


def test_runs_of_spaces_and_long_words(model):
    """Marks in front of a word that takes one, that takes none, and alone; texts far over any piece, in linear time."""
    for count in (1, 2, 3, 13, 14, 15, 16, 17, 29, 30, 31, 32, 33, 47, 100):
        for word in ("", "the", "日", "\n", "\nx", "zqx", "<s>", "é"):
            text = "a" + " " * count + word
            assert model.encode(text) == LIBRARY.encode(text)
            assert model.encode(text[1:]) == LIBRARY.encode(text[1:])
    rng = random.Random(3)
    for text in ("  " + "".join(rng.choices("abcdeiou", k=40_000)), "x" + " " * 20_001 + "y", "".join(rng.choices("ab \n日", k=60_000))):
        assert model.encode(text) == LIBRARY.encode(text)
        count, ids, decoded = model.digests(text)
        expected = LIBRARY.encode(text)
        assert count == len(expected) and ids == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert decoded == hashlib.sha256(LIBRARY.decode(expected).encode()).hexdigest()


def test_compatibility_by_merging(model):
    """Two pieces are compatible if merging their text gives both back."""
    rng = random.Random(1)
    known = [i for i in model.rank if model.merged(model.pieces[i])[0] == [model.pieces[i]] and not model.pieces[i].startswith("▁▁")]
    for _ in range(3000):
        a, b = rng.choice(known), rng.choice(known)
        if not model.pieces[b].startswith("▁"):
            assert model.compatible(a, b) == (model.merged(model.pieces[a] + model.pieces[b])[0] == [model.pieces[a], model.pieces[b]])


def test_pieces_of_odd_rows(odd, empty):
    rows = pieces.encode_digests(odd, MODEL).collect()
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r["doc_id"]].add(r["text"] or "")
    assert len(rows) == odd.count()
    for r in rows:
        (text,) = texts[r["doc_id"]]
        assert r["n_tokens"] == len(LIBRARY.encode(text))
    assert pieces.encode_digests(empty, MODEL).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in pieces.encode_texts(odd, MODEL).collect()}
    assert ids[1] == LIBRARY.encode("The quick brown fox jumps over the lazy dog")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ALPHABET, "'s", "\u0301", "\u1100", "\u1161", "Σ", "İ", "\x85", "\u3000", "<|startoftext|>", "word" * 90]), max_size=40).map("".join) | st.text(max_size=40))
def test_words_equal_the_library(text):
    """Words encoded together and remembered give the ids of the whole text, also when seen again."""
    text = text.encode("utf-8", "replace").decode()
    tokenizer, cache = Tokenizer.from_str(VOCABULARY.decode()) if not LIBRARIES else LIBRARIES[0], packing.RecentCache(50)
    LIBRARIES[:] = [tokenizer]
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.word_ids(tokenizer, cache, text.encode()) == want
    assert packing.word_ids(tokenizer, cache, text.encode()) == want


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from([*ALPHABET, " ", "'s", "'RE", "J", "É", "ß", "Ÿ", "ſ", "İ", "\u030c", "\u0301", "_", "7", "\x7f", "\x1f", "×", "Σ", "<|StartOfText|>", "<|endoftext|>", "Word" * 90]), max_size=40).map("".join)
    | st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=60)
)
def test_plain_words_equal_the_library(text):
    tokenizer, added = packing._tokenizer(VOCABULARY)
    cache, latin = packing.RecentCache(50), packing.LatinWords(tokenizer, added)
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for _ in range(2):
        assert packing.word_ids(tokenizer, cache, text.encode(), latin) == want


def test_plain_words_are_not_encoded_with_places(monkeypatch):
    """Words of Latin letters take the short way; an unknown normal form has none."""
    tokenizer, added = packing._tokenizer(VOCABULARY)
    text = "Déjà vu, the QUICK brown fox isn't here: 42 (été)!"
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(packing, "fresh_ids", None)
    assert packing.word_ids(tokenizer, packing.RecentCache(50), text.encode(), packing.LatinWords(tokenizer, added)) == want
    assert packing._tokenizer(VOCABULARY.replace(b'"NFC"', b'"NFKC"'))[1] is None


def test_very_long_texts(spark):
    """A text of many pieces at the default capacity, with words longer than the cache takes."""
    rng = random.Random(8)
    texts = {1: " ".join("".join(rng.choices("abcdefgé日 ", k=rng.randrange(1, 400))) for _ in range(800)), 2: "a" * 30_000, 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    check_packing(rows, texts)
    assert max(r["piece"] for r in rows) > 10


LIBRARIES: list = []


def check_packing(rows, texts, capacity=2048):
    tokenizer = Tokenizer.from_str(VOCABULARY.decode())
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        cut = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        got = sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in parts)
        assert got == [(k, k * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_of_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    used, bound = check_packing(packing.op10_packing(spark, SMALL).collect(), texts)
    assert used <= 1.1 * bound + 1


def test_packing_of_odd_rows(odd, empty):
    single = odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    rows = packing.pack_documents(single, VOCABULARY, capacity=16).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in single.collect()}, 16)
    everything = packing.pack_documents(odd, VOCABULARY).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in everything}) == len(everything)
    assert sum(r["doc_id"] == 9 for r in everything) == 2 and sum(r["doc_id"] is None for r in everything) == 1
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_places_every_piece(counts):
    plan = packing.Plan(counts, 40)
    ranks, fill = defaultdict(list), defaultdict(list)
    for length, rank, count, sequence, offset in plan.lines:
        ranks[length] += range(rank, rank + count)
        for k in range(count):
            fill[sequence + k].append((offset, length))
    assert {n: len(r) for n, r in ranks.items()} == counts
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert len(fill) == plan.sequences


def test_plan_fills_exactly():
    assert packing.Plan({1000: 3, 1048: 3}, 2048).sequences == 3
    assert packing.Plan({1000: 2, 600: 2, 448: 2}, 2048).sequences == 2
    assert packing.Plan({1000: 1, 500: 1, 300: 1, 248: 1}, 2048).sequences == 1
    assert packing.Plan({1024: 4}, 2048).sequences == 2


def expected_text(page):
    body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_pages_of_table(spark):
    found = {r["page_id"]: r for r in pages.op8_html(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]]["text"] == expected_text(r["html"])
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


@pytest.fixture(scope="module")
def weights(spark):
    return pages.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_page_without_article(weights):
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav>Menu a b</nav>
    <div id="cookie-notice">We use cookies</div><div class="content"><h2>Real  title</h2><p>First &amp; para with <a href=x>link</a> words.
    <p>Second para<ul><li>one<li>two</ul><div class="ad">buy now</div><script>if (a < b) x("</p>")</script><form>Name <input></form>
    <p>Last para here with words</div><aside>side</aside><section id="comments"><p>I liked it a lot and want to say so</p></section><footer>c</footer>"""
    assert pages.main_text(page, weights) == "Real title\nFirst & para with link words.\nSecond para\none\ntwo\nLast para here with words"


def brute_region(parts, weights):
    """The best run by trying all of them."""
    value = [
        weights.tags.get(p.kind, pages.UNSEEN_TAG) if p.text is None else weights.words.get(p.kind, weights.word) * len(p.text.split()) for p in parts
    ]
    return max((sum(value[a:b]) for a in range(len(value)) for b in range(a, len(value) + 1)), default=0.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "<ul>", "<li>", "<br>", "x y", "word ", "<h1>", "</div>", "<div>", "&lt;", "<", "</", "<!-- c -->"]), max_size=25))
def test_scan_finds_the_best_run(tokens):
    page = "".join(tokens)
    weights = pages.Weights({"p": 1.5, "li": 0.2}, {"ul": -3.0, "p": -0.1, "li": -2.0, "br": -0.02}, 0.6, -0.6)
    parts = [p for p in pages.parts_of(page) if not p.side]
    best = brute_region(parts, weights)
    text = pages.main_text(page, weights)
    assert bool(text.split()) <= (best > 0)
    if any(p.text and p.text.split() for p in parts) and best > 0:
        assert text


def test_pages_of_odd_rows(spark, weights):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>only menu</nav>"), (4, "u", "plain &amp; simple"), (4, "u", "plain &amp; simple"), (None, "u", "<p>no id</p>"), (5, "u", "<p>" + "long words " * 20000), (6, "u", "<div" * 3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = Counter((r["page_id"], r["text"]) for r in pages.extract(frame, weights).collect())
    assert got[(1, "")] == got[(2, "")] == got[(3, "")] == 1 and got[(4, "plain & simple")] == 2 and got[(None, "no id")] == 1
    assert got[(5, ("long words " * 20000).strip())] == 1 and sum(got.values()) == 8
    assert pages.extract(frame.where("false"), weights).count() == 0
    assert pages.extract(frame, pages.learn(frame.where("false"))).count() == 8


def test_weights_do_not_depend_on_copies(spark, monkeypatch):
    """A page that makes up most rows teaches once, wherever its hash falls."""
    from framelake.llm import op08_html as html

    pages = [f"<html><body><div>menu {i}</div><article><p>{'story ' * (5 + i)}</p></article></body></html>" for i in range(40)]
    frame = spark.createDataFrame([(p,) for p in pages], "html string")
    for bound in (100, 10):
        monkeypatch.setattr(html, "LABELLED_PAGES", bound)
        want = html.learn(frame)
        for hot in pages[:: 13]:
            many = frame.union(spark.createDataFrame([(hot,)] * 200, "html string")).repartition(3)
            assert html.learn(many) == want
    monkeypatch.setattr(html, "LABELLED_PAGES", 100)
    assert html.learn(frame) == html.fit(pages)
