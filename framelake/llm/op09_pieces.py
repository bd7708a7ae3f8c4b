"""SentencePiece merge-type (BPE) encoding by a table of last tokens, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import RecentCache, as_bytes, documents, over_batches, row_batch

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_HALF = 400_000
CACHED_CHARS = 128  # longer segments are encoded each time, so that the cache stays bounded in bytes
KNOWN_PAIRS = 2_000_000
PROBE = "  a  ﬁ\tＡ e\u0301\n  ▁ x  日本  "  # told apart by normalisers that fold, trim or compose


class PieceModel:
    """Encoder and decoder of one model.

    A piece's rank is its place by falling score. ``split`` holds the two pieces whose merge completes a piece. A text is
    the run of last tokens: the last token of each prefix is the one match ending there that can follow the last token
    of the prefix before it, so a text is encoded left to right without a merge queue and ids are read backwards.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        n = library.vocab_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        self.id_bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for byte, i in self.byte_ids.items():
            self.id_bytes[i] = bytes([byte])
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        scores = {i: library.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {i: order[scores[i]] if len(self.pieces[i]) > 1 else -1 for i in plain}
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            parts, last = self.merged(self.pieces[i])
            if parts == [self.pieces[i]]:
                if last:
                    self.split[i] = (self.ids[last[0]], self.ids[last[1]])
                self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        marks = f" {SPACE}"
        ends = "" if any("\n" in p for p in self.ids) else "\n"
        self.barrier = re.compile(f"[{marks}]*[^{marks}{ends}]+|[{marks}]+" + (f"|{ends}+" if ends else ""))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with an inner space mark are not supported")
        runs = [i for p, i in self.ids.items() if p.startswith(SPACE * 2)]
        others = max((r for i, r in self.rank.items() if i not in set(runs)), default=-1)
        if any(self.pieces[i].strip(SPACE) or self.rank[i] <= others for i in runs) or len({self.rank[i] for i in runs}) > 1:
            raise ValueError("runs of space marks must be merged last, with one score")
        self.runs = {len(self.pieces[i]) for i in runs}
        self.cache = RecentCache(CACHE_HALF)
        if self.encode(PROBE) != library.encode(PROBE):
            raise ValueError("the model's normaliser is not supported")

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, best rank first and leftmost among equals; also the last pair merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: no merge across their border comes before the merges that made them."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= KNOWN_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        pieces, rank, ids, bound = self.pieces, self.rank, self.ids, float("inf")
        while True:
            across = ids.get(pieces[left] + pieces[right])
            if across is not None and rank[across] < bound:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            # Step back before the later of the two merges; of equal ones the right-hand merge is later.
            if rank[left] > rank[right]:
                bound, left = rank[left], self.split[left][1]
            else:
                bound, right = rank[right] + 1, self.split[right][0]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of a stretch of text that no piece crosses.

        Runs of space marks share one score, where the table's theorem does not hold. They are merged after all other pieces,
        so the word takes its mark first, and the marks that are left are merged among themselves.
        """
        marks = len(segment) - len(segment.lstrip(SPACE))
        if marks < 2:
            return self._table_ids(segment)
        word = self._table_ids(segment[marks - 1 :])
        if word[0] == self.ids.get(SPACE):
            return self._mark_ids(marks) + word[1:]
        return self._mark_ids(marks - 1) + word

    def _mark_ids(self, count: int) -> list[int]:
        """Ids of ``count`` space marks: the leftmost pair that makes a piece is merged first, so one pass with a stack will do."""
        lengths: list[int] = []
        for _ in range(count):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in self.runs:
                last = lengths.pop()
                lengths[-1] += last
        return [i for n in lengths for i in self._whole(SPACE * n)]

    def _table_ids(self, segment: str) -> list[int]:
        whole = self.ids.get(segment)
        if whole is not None and (whole in self.split or len(segment) == 1):
            return [whole]
        # Last token of each prefix, -1 where a character that ends no piece stands alone, and where that token starts.
        last, starts = [-1] * (len(segment) + 1), list(range(-1, len(segment)))
        known = self.fits.get
        for at, (length, i) in self.automaton.iter(segment):
            end = at + 1
            if last[end] < 0:
                left = last[end - length]
                if left >= 0:
                    fits = known(left << 32 | i)
                    if not (self.compatible(left, i) if fits is None else fits):
                        continue
                last[end], starts[end] = i, end - length
        out, end = [], len(segment)
        while end:
            i, start = last[end], starts[end]
            if i >= 0:
                out.append(i)
            else:
                out += self._whole(segment[start:end])[::-1]
            end = start
        return out[::-1]

    def _whole(self, part: str) -> list[int]:
        i = self.ids.get(part)
        return [i] if i is not None else [self.byte_ids[b] for b in part.encode()]

    def segments(self, text: str) -> list[str]:
        """Stretches of the text, with a space in front, that no piece crosses; spaces are not marked yet."""
        return self.barrier.findall(" " + text) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s.replace(" ", SPACE))]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; the space mark put in front of a text is taken off again."""
        joined = b"".join([self.id_bytes[i] for i in ids]).decode("utf-8", "replace")
        return joined[1:] if first and joined.startswith(" ") else joined

    def known(self, segment: str) -> tuple[str, str]:
        """Ids joined by commas and decoded text of a segment."""
        found = self.cache.get(segment)
        if found is None:
            ids = self.segment_ids(segment.replace(" ", SPACE))
            found = (",".join(map(str, ids)), self.decode(ids, first=False))
            if len(segment) <= CACHED_CHARS:
                self.cache.put(segment, found)
        return found

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the text decoded from them."""
        segments = self.segments(text)
        found = list(map(self.cache.young.get, segments))
        if None in found:
            found = [self.known(s) if f is None else f for s, f in zip(segments, found, strict=True)]
        ids, decoded = ",".join(map(ID_PART, found)), "".join(map(TEXT_PART, found))
        decoded = decoded[1:] if decoded.startswith(" ") else decoded
        count = ids.count(",") + 1 if ids else 0
        return count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


ID_PART, TEXT_PART = itemgetter(0), itemgetter(1)
_models: dict[str, PieceModel] = {}


def piece_model(model: bytes) -> PieceModel:
    """One model per worker process, kept between tasks."""
    key = hashlib.md5(model).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(model)
    return _models[key]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(MODEL), "rb") as file:
        return file.read()


def encode_digests(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty and has no ids.

    Texts stay where they are read. Frequent stretches are encoded once per worker (bounded memory). The model, of
    fixed size, is broadcast. Repeated rows come back as often as they came.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(shared.value)
        for batch in batches:
            found = [pieces.digests(value.as_py().decode("utf-8", "replace")) for value in batch.column(1)]
            yield row_batch(out, [batch.column(0), *([f[k] for f in found] for k in range(3))])

    return over_batches(docs.select("doc_id", as_bytes(text).alias("text")), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """doc_id and the ids of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(shared.value)
        for batch in batches:
            yield row_batch(out, [batch.column(0), [pieces.encode(v.as_py().decode("utf-8", "replace")) for v in batch.column(1)]])

    return over_batches(docs.select("doc_id", as_bytes(text).alias("text")), work, "doc_id long, ids array<int>")


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return encode_digests(documents(spark, folder), default_model())
