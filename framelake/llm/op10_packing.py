"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import RecentCache, as_bytes, bucket_count, documents, over_batches, ranked, row_batch, stored

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
CACHE_HALF, PIECES_HALF = 300_000, 150_000
CACHED_BYTES = 256  # longer words are encoded each time, so that the cache stays bounded in bytes
#: The vocabulary's way to pieces, as far as words of printable ASCII and Latin letters go, which no normal form changes.
PLAIN = re.compile("[ -~À-ÖØ-öø-įı-ſ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ a-zß-öø-ſ0-9]+| ")
BETWEEN = b"\xff" * 4  # stands between words; no id is near it
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_tokenizers: dict[str, tuple] = {}


def default_vocabulary() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


def _tokenizer(vocabulary: bytes) -> tuple:
    """Tokenizer of this worker process, and its added tokens if its way to pieces is the one known here, else None."""
    key = hashlib.md5(vocabulary).hexdigest()
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        said = json.loads(vocabulary)
        steps = [(said.get(k) or {}).get(n) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        known = steps == [NORMAL_FORM, PRE_TOKENS] and said["model"].get("type") == "BPE" and not said["model"].get("dropout") and not said.get("truncation")
        added = [t["content"].lower() for t in said.get("added_tokens") or []]
        _tokenizers[key] = (Tokenizer.from_str(vocabulary.decode()), added if known else None)
    return _tokenizers[key]


class LatinWords:
    """Ids of words of printable ASCII and Latin letters: cut into pieces here, each piece is encoded by the vocabulary's model
    once, without the places that a whole text's encoding keeps."""

    def __init__(self, tokenizer, added: list[str]):
        self.tokenize, self.cache = tokenizer.model.tokenize, RecentCache(PIECES_HALF)
        self.added = [a.encode() for a in added]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves as characters
        self.characters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}

    def lowered(self, text: bytes) -> bytes | None:
        """A-Z in lower case; None where that might change an id: accents that compose with a letter, added tokens."""
        lowered = text.lower()
        return None if b"\xcc" in text or b"\xcd" in text or any(a in lowered for a in self.added) else lowered

    def ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Of those words that are plain."""
        shown = b" ".join(words).decode("utf-8", "replace")
        if not PLAIN.fullmatch(shown):
            words = [w for w in words if PLAIN.fullmatch(w.decode("utf-8", "replace"))]
            shown = b" ".join(words).decode()
        if not words:
            return {}
        pieces = PIECE.findall(shown.lower())
        parts = list(map(self.cache.young.get, pieces))
        for i in [i for i, p in enumerate(parts) if p is None]:
            parts[i] = self.cache.get(pieces[i]) or self._piece(pieces[i])
        return dict(zip(words, b"".join(parts).split(BETWEEN), strict=True))

    def _piece(self, piece: str) -> bytes:
        if piece == " ":
            ids = BETWEEN
        else:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
            ids = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        if len(piece) <= CACHED_BYTES:
            self.cache.put(piece, ids)
        return ids


def word_ids(tokenizer, cache: RecentCache, text: bytes, latin: LatinWords | None = None) -> bytes:
    """Little-endian 32-bit ids of a text. The tokenizer drops white space and never joins across it, so words are
    remembered one by one; new ones are encoded by ``latin``, or as one text and taken apart by the places of their tokens."""
    lowered = latin.lowered(text) if latin else None
    words = (text if lowered is None else lowered).split()
    parts = list(map(cache.young.get, words))
    missed = [i for i, p in enumerate(parts) if p is None]
    if missed:
        found = {w: cache.get(w) for w in {words[i] for i in missed}}
        fresh = [w for w, ids in found.items() if ids is None]
        new = latin.ids(fresh) if fresh and lowered is not None else {}
        if len(new) < len(fresh):
            new |= fresh_ids(tokenizer, [w for w in fresh if w not in new])
        for w, ids in new.items():
            if len(w) <= CACHED_BYTES:
                cache.put(w, ids)
        found |= new
        for i in missed:
            parts[i] = found[words[i]]
    return b"".join(parts)


def fresh_ids(tokenizer, words: list[bytes]) -> dict[bytes, bytes]:
    shown = [w.decode("utf-8", "replace") for w in words]
    encoded = tokenizer.encode(" ".join(shown), add_special_tokens=False)
    first = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded.offsets))
    ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)) + 1)
    cuts = [0, *(4 * np.searchsorted(first, ends)).tolist()]
    ids = np.array(encoded.ids, "<u4").tobytes()
    return {w: ids[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document; its ids are followed by one end id. Null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, added = _tokenizer(shared.value)
        cache = RecentCache(CACHE_HALF)  # of the task, so that an idle worker holds none
        latin = None if added is None else LatinWords(tokenizer, added)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = word_ids(tokenizer, cache, value.as_py(), latin) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield row_batch(out, list(rows))

    return over_batches(docs.select("doc_id", as_bytes(text).alias("text")), work, PIECES)


class Plan:
    """Which ranks of each length go to which sequences, at which offset.

    Works on counts by length only (at most ``capacity`` numbers), so its size does not depend on the number of pieces. A
    line (length, first rank, count, first sequence, offset) places that many pieces of consecutive rank into as many
    consecutive sequences.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {n: c for n, c in counts.items() if c}
        self.present = np.zeros(capacity + 1, bool)
        self.present[list(self.left)] = True
        self.taken: dict[int, int] = {}
        self.lines: list[tuple[int, int, int, int, int]] = []
        self._exact()
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.taken.get(length, 0)
        self.lines.append((length, rank, count, sequence, offset))
        self.taken[length] = rank + count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.present[length] = False

    def _fill(self, lengths: list[int]) -> None:
        """Open as many sequences with this combination as the counts allow."""
        count = min(self.left[n] // lengths.count(n) for n in lengths)
        first, offset = self.sequences, 0
        self.sequences += count
        for n in lengths:
            self._place(n, count, first, offset)
            offset += n

    def _enough(self, lengths: list[int]) -> bool:
        return all(self.left.get(n, 0) >= lengths.count(n) for n in lengths)

    def _pair(self, total: int, rest: list[int]) -> list[int] | None:
        """Two lengths with this sum that are left besides ``rest``, the longer one as long as possible."""
        both = self.present[: total + 1] & self.present[total::-1]
        for b in np.flatnonzero(both[1 : total // 2 + 1]) + 1:
            if self._enough([*rest, total - int(b), int(b)]):
                return [total - int(b), int(b)]
        return None

    def _complement(self, length: int) -> list[int] | None:
        """One, two or three lengths that exactly fill what ``length`` leaves."""
        gap = self.capacity - length
        if gap == 0:
            return []
        if self.present[gap] and self._enough([length, gap]):
            return [gap]
        pair = self._pair(gap, [length])
        if pair:
            return pair
        for a in np.flatnonzero(self.present[: gap - 1])[::-1]:
            if self._enough([length, int(a)]):
                pair = self._pair(gap - int(a), [length, int(a)])
                if pair:
                    return [int(a), *pair]
        return None

    def _exact(self) -> None:
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                others = self._complement(length)
                if others is None:
                    break
                self._fill([length, *others])

    def _best_fit(self) -> None:
        """The rest by falling length into the tightest open sequences; equal ones are handled as one run."""
        runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, count)
        gaps: list[int] = []

        def open_run(gap: int, first: int, count: int) -> None:
            if count and gap:
                if gap not in runs:
                    insort(gaps, gap)
                    runs[gap] = []
                runs[gap].append((first, count))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                need, at = self.left[length], bisect_left(gaps, length)
                if at == len(gaps):
                    each = self.capacity // length
                    full = need // each
                    for copies, count in ((each, full), (need - full * each, 1)):
                        if copies and count:
                            first = self.sequences
                            self.sequences += count
                            for k in range(copies):
                                self._place(length, count, first, k * length)
                            open_run(self.capacity - copies * length, first, count)
                    continue
                gap = gaps[at]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
                used = min(need, count)
                self._place(length, used, first, self.capacity - gap)
                open_run(gap - length, first, used)
                open_run(gap, first + used, count - used)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length: few sequences of at most ``capacity`` tokens.

    The counts by length are summed in Spark and planned on the driver; both they and the plan are bounded by the
    capacity. Pieces get a rank among those of their length (in hash buckets, so a frequent length is spread), and each
    looks its place up in the broadcast plan. Pieces that repeat are packed as often as they come.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity)
    lines = np.array(sorted(plan.lines), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(lines)
    nb = bucket_count(sum(counts.values()))
    dealt = ranked(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(nb)), ["doc_id", "piece"], "rank")
    columns = [f.name for f in pieces.schema if f.name not in ("sequence_id", "offset")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = shared.value
        starts = lines[:, 0] << 48 | lines[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length << 48 | rank, side="right") - 1
            place = [pa.array(lines[at, 3] + rank - lines[at, 1]), pa.array(lines[at, 4])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + place, names=[*columns, "sequence_id", "offset"])

    return over_batches(dealt, work, ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Tokenise, cut and pack. The pieces (a few numbers each) are written once to the shared folder, texts are not moved.

    Null and empty texts make a piece of one end token; an empty table makes no rows.
    """
    return pack(stored(token_pieces(docs, vocabulary, capacity, text), "pieces"), capacity)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), default_vocabulary())
