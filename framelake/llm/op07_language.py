"""Language identification with spans: script ranges narrow candidates, Viterbi labels words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import as_bytes, documents, over_batches, row_batch, small_batches

UNKNOWN = "und"
BUCKETS, ORDERS = 1 << 17, (1, 2, 3, 4)
#: Cost of a change of language between two words, in natural log units; floor of one word's evidence.
SWITCH, FLOOR = 6.0, -8.0
#: A language may be written in the scripts that make up at least this share of its letters in training.
SCRIPT_SHARE = 0.01
#: Tokens a worker remembers, tokens counted before their n-grams are summed, and tokens taken apart at a time.
CACHE_TOKENS, TRAIN_TOKENS, CHUNK = 300_000, 100_000, 16_384

# First and last code point of the scripts told apart (Unicode blocks); all other letters are script 0.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_tables: list[np.ndarray] = []


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its script's number."""
    if not _tables:
        letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        script = np.zeros(0x110000, np.int16)
        for name, first, last in SCRIPTS:
            script[first : last + 1] = NAMES.index(name)
        _tables.extend([letter, script])
    return _tables[0], _tables[1]


@dataclass
class Units:
    """Words of tokens: letters of one token in one script. ``bucket``/``unit`` list their character n-grams."""

    token: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    bucket: np.ndarray
    unit: np.ndarray


def units_of(tokens: list[bytes]) -> Units:
    letter, script = code_tables()
    text = "\n" + b"\n".join(tokens).decode("utf-8", "replace").lower() + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    is_letter = letter[codes]
    token = np.cumsum(codes == 10) - 1
    at = np.flatnonzero(is_letter)
    scripts, owner = script[codes[at]], token[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (scripts[1:] != scripts[:-1])
    number = np.cumsum(fresh) - 1
    unit = np.full(len(codes), -1)
    unit[at] = number
    n_units = int(fresh.sum())
    shown = np.where(is_letter, codes, 0).astype(np.uint64)
    buckets, units = [], []
    for n in ORDERS:
        if len(codes) < n:
            break
        span = len(codes) - n + 1
        value, valid = np.full(span, n, np.uint64), np.ones(span, bool)
        for k in range(n):
            value = (value ^ shown[k : k + span]) * np.uint64(0x9E3779B97F4A7C15)
            if n == 1 or 0 < k < n - 1:
                valid &= is_letter[k : k + span]
        home = unit[:span] if n == 1 else np.where(unit[1 : 1 + span] >= 0, unit[1 : 1 + span], unit[:span])
        valid &= home >= 0
        buckets.append((value[valid] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
        units.append(home[valid])
    none = [np.zeros(0, np.int64)]
    return Units(owner[fresh], scripts[fresh], np.bincount(number, minlength=n_units), np.concatenate(buckets or none), np.concatenate(units or none))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages): log share of the n-gram
    allowed: np.ndarray  # (scripts, languages)
    index: dict = field(default_factory=dict)  # token: unit number, 0 without letters, or -1 - place in ``several``
    several: list = field(default_factory=list)
    scores: list = field(default_factory=list)
    letters: list = field(default_factory=list)

    def learn(self, tokens: list[bytes]) -> None:
        """Score new tokens and remember them; the memory is emptied when full."""
        if not self.scores or len(self.index) > CACHE_TOKENS:
            self.index.clear()
            self.several.clear()
            self.scores[:] = [np.zeros((1, len(self.languages)), np.float32)]
            self.letters[:] = [np.zeros(1, np.int64)]
        tokens = [t for t in dict.fromkeys(tokens) if t not in self.index]
        for at in range(0, len(tokens), CHUNK):
            self._learn(tokens[at : at + CHUNK])

    def _learn(self, tokens: list[bytes]) -> None:
        found = units_of(tokens)
        n = len(found.letters)
        score = np.stack([np.bincount(found.unit, weights=self.weights[found.bucket, k], minlength=n) for k in range(len(self.languages))], 1)
        score = score / len(ORDERS)
        allowed = self.allowed[found.script]
        score = np.where(allowed, score, -np.inf)
        some = allowed.any(1)
        score[~some] = 0.0  # a script that no language uses says nothing
        top = score.max(1, keepdims=True)
        score = score - top - np.log(np.exp(score - top).sum(1, keepdims=True))
        first = sum(map(len, self.scores))
        self.scores.append(np.maximum(score, FLOOR).astype(np.float32))
        self.letters.append(found.letters)
        lo = np.searchsorted(found.token, np.arange(len(tokens)))
        hi = np.searchsorted(found.token, np.arange(len(tokens)), side="right")
        for t, a, b in zip(tokens, lo.tolist(), hi.tolist(), strict=True):
            if b - a > 1:
                self.several.append(list(range(first + a, first + b)))
                self.index[t] = -len(self.several)
            else:
                self.index[t] = first + a if b > a else 0

    def words(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Unit numbers of each text, and the token each unit stands in is its order."""
        if len(self.index) > CACHE_TOKENS:
            self.scores.clear()
        self.learn([t for tokens in texts for t in set(tokens) if not self.scores or t not in self.index])
        out = []
        for tokens in texts:
            numbers = np.array([self.index[t] for t in tokens], np.int64)
            if (numbers < 0).any():
                numbers = np.array([u for i in numbers.tolist() for u in ((i,) if i >= 0 else self.several[-1 - i])], np.int64)
            out.append(numbers[numbers > 0])
        self.scores[:], self.letters[:] = [np.concatenate(self.scores)], [np.concatenate(self.letters)]
        return out

    def label(self, units: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of every text's words. Texts of a batch advance together, longest first."""
        n_lang, table = len(self.languages), self.scores[0]
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        lengths = np.array([len(units[i]) for i in order], np.int64)
        total, starts = int(lengths.sum()), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        flat = np.concatenate([units[i] for i in order]) if total else np.zeros(0, np.int64)
        switched, came = np.zeros((total, n_lang), bool), np.zeros(total, np.int8 if n_lang < 128 else np.int32)
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left") if steps else np.zeros(0, int)
        value = np.zeros((len(units), n_lang), np.float32)
        for t in range(steps):
            a = active[t]
            at = starts[:a] + t
            v = value[:a]
            if t:
                best = v.argmax(1)
                moved = v[np.arange(a), best][:, None] - np.float32(SWITCH)
                switch = moved > v
                switched[at], came[at] = switch, best
                v = np.where(switch, moved, v)
            value[:a] = v + table[flat[at]]
        labels = np.zeros(total, np.int64)
        now = value.argmax(1)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            at = starts[:a] + t
            labels[at] = now[:a]
            now[:a] = np.where(switched[at, now[:a]], came[at], now[:a])
        out: list = [None] * len(units)
        for place, i in enumerate(order):
            out[i] = labels[starts[place] : starts[place] + lengths[place]]
        return out


def train(docs: DataFrame) -> LanguageModel:
    """Learn from all rows with a text and a lang. Sums per language and n-gram bucket are of fixed size."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, Counter] = {}

        def settle() -> None:
            for lang, counted in waiting.items():
                words, numbers = list(counted), np.fromiter(counted.values(), np.float64, len(counted))
                have = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                for at in range(0, len(words), CHUNK):
                    found = units_of(words[at : at + CHUNK])
                    times = numbers[at : at + CHUNK][found.token]
                    have[:BUCKETS] += np.bincount(found.bucket, weights=times[found.unit], minlength=BUCKETS)
                    have[BUCKETS:] += np.bincount(found.script, weights=times * found.letters, minlength=len(NAMES))
            waiting.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, Counter()).update(text.as_py().split())
                if sum(map(len, waiting.values())) > TRAIN_TOKENS:
                    settle()
        settle()
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield row_batch(schema, [[lang] * len(at), at, have[at]])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(as_bytes("text").alias("text"), F.col("lang").cast("string"))
    counts = over_batches(rows, count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    held = np.zeros((BUCKETS + len(NAMES), max(1, len(languages))))
    if languages:
        numbers = np.searchsorted(np.array(languages), np.array(counts["lang"].to_pylist()))
        held[counts["bucket"].to_numpy(), numbers] = counts["n"].to_numpy()
    grams, scripts = held[:BUCKETS], held[BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return LanguageModel(languages or [UNKNOWN], weights, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
FOUND = ("string", "double", "array<struct<first_word: long, n_words: long, lang: string>>")


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and the labelled spans (in words with letters) to every row.

    The language with most letters wins; the score is its share of all letters. A text that is null, empty or without a
    letter is ``und`` with score 0 and no spans; so is every text if nothing was learned. Of languages with as many
    letters the first by name wins. Repeated rows give repeated results. Other columns pass through, those named like
    the new ones (which may get a prefix) are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.allowed))
    kept: dict[int, LanguageModel] = {}
    added = [f"{prefix}{name}" for name in ("lang_pred", "score", "spans")]
    docs = docs.drop(*added)
    place, names_in = docs.columns.index(text), docs.columns
    found_types = [pa.string(), pa.float64(), SPANS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.setdefault(0, LanguageModel(*shared.value))
        for batch in batches:
            for part in small_batches([batch], place):
                units = own.words([(v.as_py() or "").encode("utf-8", "replace").split() for v in part.column(place)])
                letters, names, rows = own.letters[0], own.languages, ([], [], [])
                for numbers, labels in zip(units, own.label(units), strict=True):
                    if not len(numbers):
                        for column, x in zip(rows, (UNKNOWN, 0.0, []), strict=True):
                            column.append(x)
                        continue
                    mass = np.bincount(labels, weights=letters[numbers], minlength=len(names))
                    best = int(mass.argmax())
                    starts = np.flatnonzero(np.diff(labels, prepend=-1))
                    ends = np.append(starts[1:], len(labels))
                    spans = [{"first_word": a, "n_words": b - a, "lang": names[labels[a]]} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    score = float(mass[best] / mass.sum()) if names != [UNKNOWN] else 0.0
                    for column, x in zip(rows, (names[best], score, spans), strict=True):
                        column.append(x)
                found = [pa.array(r, t) for r, t in zip(rows, found_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*names_in, *added])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return over_batches(docs, work, ", ".join([*kinds, *(f"`{name}` {kind}" for name, kind in zip(added, FOUND, strict=True))]))


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = identify(docs.select("doc_id", "text"), train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
