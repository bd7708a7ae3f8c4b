"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import MIX, as_bytes, bucket_count, documents, over_batches, row_batch, small_batches, stored

#: Bytes of context, and how many of them the part of the tree has that all tasks know (at most 2**16 contexts, whatever
#: the corpus). Longer contexts stay in Spark, dealt out by their last TOP + 1 bytes.
DEPTH, TOP = 6, 2
#: Words with at least this share of the training tokens are broadcast for the base score (at most 1 / WORD_SHARE of
#: them); the others are joined.
WORD_SHARE = 2.0**-20
END = b"\n"
#: Bounds of what a task holds: n-grams and words counted so far, bytes of text at a time.
FLUSH_GRAMS, FLUSH_WORDS, BATCH = 1_500_000, 200_000, 2 << 20
#: Bytes of text that ask for their n-grams together, their n-grams held at a time, and bytes of text for each bucket of contexts.
CHUNK, CHUNK_GRAMS, BUCKET = 64 << 20, 2_000_000, 8 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class ContextTree:
    """Weighted predictions from n-gram counts by depth.

    A byte is eight binary decisions; the decisions before it name a node (1 to 255). A context of d bytes and a node hold
    counts of zeros and ones. P_w of a context is the mean of its own KT probability and the product over its longer
    contexts; what falls to contexts outside of the tree forms one more factor. A prediction mixes the KT estimates of
    all depths with the posterior weights of stopping there. Every decision's two probabilities sum to one.
    """

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], longer_log: np.ndarray | None = None):
        """``nodes`` lists, by depth, the sorted names (context bytes, then one byte for the node), zeros and ones.
        ``longer_log`` has, for the last depth, the log of the product over longer contexts that are kept elsewhere."""
        self.names: list[np.ndarray] = []
        self.one: list[np.ndarray] = []  # KT estimate of a one
        self.stop: list[np.ndarray] = []  # weight of this depth against the longer ones
        self.up: list[np.ndarray] = []  # place of the node of the context without its oldest byte
        below = None
        for depth in range(len(nodes) - 1, -1, -1):
            names, zeros, ones = nodes[depth]
            own = log_kt(zeros, ones)
            product = own if longer_log is None or below is not None else longer_log
            if below is not None:
                longer, their_zeros, their_ones, their_log = below
                at = np.searchsorted(names, longer & ((1 << 8 * (depth + 1)) - 1))
                sums = [np.bincount(at, weights=w, minlength=len(names)) for w in (their_log, their_zeros, their_ones)]
                self.up.insert(0, at.astype(np.int32))
                product = sums[0] + log_kt(np.maximum(zeros - sums[1], 0), np.maximum(ones - sums[2], 0))
            weighted = np.logaddexp(own, product) - np.log(2)
            self.names.insert(0, names)
            self.one.insert(0, (ones + 0.5) / (zeros + ones + 1))
            self.stop.insert(0, np.exp(own - np.log(2) - weighted))
            below = (names, zeros, ones, weighted)
        self.up.insert(0, np.zeros(0, np.int32))

    def log_probability(self, keys: np.ndarray, longer: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of the last byte of each n-gram after the bytes before it. ``longer`` has for each
        n-gram and decision the probability that the longer contexts kept elsewhere give to its bit, not a number if none is there."""
        context, symbol = keys >> 8 << 8, keys & 255
        total = np.zeros(len(keys))
        deepest = np.full(len(keys), len(self.names) - 1)  # a node is there only if the node of the bits before is
        for level in range(8):
            name = context | (1 << level) | (symbol >> (8 - level))
            place, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
            for depth in range(len(self.names) - 1, -1, -1):
                here = open_[deepest[open_] == depth]
                names = self.names[depth]
                wanted = name[here] & ((1 << 8 * (depth + 1)) - 1)
                at = np.searchsorted(names, wanted)
                found = names[np.minimum(at, len(names) - 1)] == wanted if len(names) else np.zeros(len(here), bool)
                place[here[found]] = at[found]
                deepest[here[~found]] = depth - 1
            bit = (symbol >> (7 - level)) & 1
            one, inner = np.full(len(keys), 0.5), np.zeros(len(keys), bool)  # without any node
            if longer is not None:
                inner = ~np.isnan(longer[:, level])
                one[inner] = np.where(bit == 1, longer[:, level], 1.0 - longer[:, level])[inner]
            for depth in range(len(self.names) - 1, -1, -1):
                who = np.flatnonzero(deepest >= depth)
                if not len(who):
                    continue
                at = place[who]
                own = self.one[depth][at]
                stop = np.where((deepest[who] > depth) | inner[who], self.stop[depth][at], 1.0)
                one[who] = stop * own + (1 - stop) * one[who]
                if depth:
                    place[who] = self.up[depth][at]
            total += np.log(np.where(bit == 1, one, 1 - one))
        return total


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def sequence(text: bytes) -> bytes:
    """What is scored: lower-cased words joined by one space, then one end byte (which no word contains)."""
    return b" ".join(words_of(text)) + END


def grams_of(sequences: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``depth`` + 1 bytes up to each byte as one number, text by text, and each text's number of bytes."""
    flat = np.frombuffer(END * depth + (END * depth).join(sequences), np.uint8)
    lengths = np.array([len(s) for s in sequences], np.int64)
    span = len(flat) - depth
    keys = np.zeros(span, np.int64)
    for k in range(depth + 1):
        keys = keys << 8 | flat[k : k + span]
    starts = np.cumsum(lengths + depth) - (lengths + depth)
    wanted = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    return keys[wanted], lengths


GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def count_grams(texts: DataFrame, depth: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            keys, at = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([w[1] for w in waiting]), minlength=len(keys)).astype(np.int64)
            waiting[:] = [(keys, sums)]

        def rows() -> Iterator[pa.RecordBatch]:
            for keys, sums in waiting:
                for at in range(0, len(keys), 1 << 17):
                    yield row_batch(GRAMS, [keys[at : at + (1 << 17)], sums[at : at + (1 << 17)]])
            waiting.clear()

        for batch in small_batches(batches, 0, BATCH):
            found, _ = grams_of([sequence(v.as_py()) for v in batch.column(0)], depth)
            code, unique = pd.factorize(found)
            waiting.append((unique, np.bincount(code, minlength=len(unique))))
            if sum(len(w[0]) for w in waiting[1:]) > FLUSH_GRAMS // 2:
                merge()
                if len(waiting[0][0]) > FLUSH_GRAMS:
                    yield from rows()
        if waiting:
            merge()
            yield from rows()

    return over_batches(texts, count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, numbers = list(sums), list(sums.values())
            for at in range(0, len(words), 1 << 16):
                yield row_batch(WORDS, [words[at : at + (1 << 16)], numbers[at : at + (1 << 16)]])

        for batch in small_batches(batches, 0, BATCH):
            for value in batch.column(0):
                sums.update(value.as_py().lower().split())
            if len(sums) > FLUSH_WORDS:
                yield from rows()
                sums.clear()
        yield from rows()

    return over_batches(texts, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


NODES = pa.schema([("name", pa.int64()), ("zeros", pa.int64()), ("ones", pa.int64())])


def nodes_of(grams: np.ndarray, counts: np.ndarray, least: float) -> pa.RecordBatch:
    """Counts of zeros and ones of the nodes of whole contexts, for sorted n-grams; only nodes met ``least`` times."""
    context, symbol = grams >> 8 << 8, grams & 255
    names, zeros, ones = [], [], []
    for level in range(8):
        name = context | (1 << level) | (symbol >> (8 - level))
        fresh = np.flatnonzero(np.diff(name, prepend=-1))  # sorted n-grams make sorted names
        bit = (symbol >> (7 - level)) & 1
        both, one = np.add.reduceat(counts, fresh), np.add.reduceat(counts * bit, fresh)
        kept = both >= least
        names.append(name[fresh][kept])
        zeros.append((both - one)[kept])
        ones.append(one[kept])
    return row_batch(NODES, [np.concatenate(x) for x in (names, zeros, ones)])


def learn_tree(texts: DataFrame, depth: int = DEPTH, share: float = 0.0) -> ContextTree:
    """The tree of few texts in the driver's memory: count all n-grams in Spark and sum them to nodes context by context. A
    share leaves out nodes that fewer of the bytes meet. ``score_texts`` does not use it; it leaves the tree in Spark."""
    whole = stored(count_grams(texts, depth), "grams")
    least = max(1.0, share * (whole.agg(F.sum("n")).first()[0] or 0))

    def sum_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.searchsorted(keys >> 8, keys[-1] >> 8)) if len(keys) else 0  # the last context may go on
            if cut:
                parts = [*waiting, (keys[:cut], counts[:cut])]
                yield nodes_of(*(np.concatenate(x) for x in zip(*parts, strict=True)), least)
                waiting = []
            waiting.append((keys[cut:], counts[cut:]))
        keys, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
        if len(keys):
            yield nodes_of(keys, counts, least)

    nodes = []
    for d in range(depth + 1):
        mask = (1 << 8 * (d + 1)) - 1
        level = whole if d == depth else whole.groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n"))
        level = level.repartition(F.shiftright("gram", 8)).sortWithinPartitions("gram")
        table = over_batches(level, sum_nodes, "name long, zeros long, ones long").toArrow()
        columns = [table[c].to_numpy() for c in ("name", "zeros", "ones")]
        order = np.argsort(columns[0])
        nodes.append(tuple(c[order] for c in columns))
    return ContextTree(nodes)


TEXTS = pa.schema(
    [("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("scored", pa.bool_()), ("trains", pa.bool_()), ("text", pa.binary())]
)


def in_chunks(texts: DataFrame) -> DataFrame:
    """Number rows (doc_id, held_out, scored, trains, text) and the runs of about CHUNK bytes they lie in."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, row, held = TaskContext.get().partitionId() << 24, TaskContext.get().partitionId() << 40, 0
        for batch in small_batches(batches, 4, BATCH):
            n = batch.num_rows
            yield row_batch(TEXTS, [np.full(n, chunk), np.arange(row, row + n), *batch.columns])
            row, held = row + n, held + sum(len(v.as_buffer()) for v in batch.column(4))
            if held >= CHUNK:
                chunk, held = chunk + 1, 0

    return over_batches(texts, number, "chunk long, row long, doc_id long, held_out boolean, scored boolean, trains boolean, text binary")


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the last TOP + 1 bytes of context, so that all longer contexts lie in one."""
    ends = (grams >> 8 & ((1 << 8 * (TOP + 1)) - 1)).astype(np.uint64)
    return (ends * MIX >> np.uint64(32)).astype(np.int64) % buckets


def turned(grams: np.ndarray) -> np.ndarray:
    """N-grams with the newest byte of context first, so that those with a common context sort together."""
    return grams.astype(np.uint64).byteswap() << np.uint64(8) | (grams & 255).astype(np.uint64)


def turned_back(turns: np.ndarray) -> np.ndarray:
    return ((turns.byteswap() & np.uint64((1 << 56) - 1)) << np.uint64(8) | (turns & np.uint64(255))).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as compressed bytes of their differences."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(value: bytes) -> np.ndarray:
    n = int.from_bytes(value[:8], "little")
    planes = np.frombuffer(pa.decompress(value[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Places of the first of equal values, which are sorted."""
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


class Found:
    """Values of n-grams, in the order of their hashes, with the first place of each start of a hash."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        hashes = grams.astype(np.uint64) * MIX
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(1, len(grams).bit_length())
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Of n-grams that all are there; another one is an error."""
        hashes = grams.astype(np.uint64) * MIX
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        missed = np.flatnonzero(self.hashes[at] != hashes)
        while len(missed):
            at[missed] += 1
            missed = missed[self.hashes[at[missed]] != hashes[missed]]
        return self.values[at]


#: Room for the mark of n-grams of training texts, and that mark.
MARK, MARKED = np.uint64(8), np.uint64(1)
ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def asked_grams(texts: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Distinct n-grams of each chunk, packed by bucket, with the number of times its training texts have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held: tuple[np.ndarray, np.ndarray] | None = None
        now = -1

        def merge() -> None:
            nonlocal held
            marked = np.concatenate(waiting)
            waiting.clear()
            marked.sort()
            first = distinct(marked >> MARK)
            keys, counts = marked[first] >> MARK, np.add.reduceat((marked & MARKED).astype(np.int32), first, dtype=np.int32)
            del marked, first
            if held is not None:
                both = np.concatenate([held[0], keys])
                both.sort()
                both = both[distinct(both)]
                sums = np.zeros(len(both), np.int32)
                for k, n in (held, (keys, counts)):
                    sums[np.searchsorted(both, k)] += n
                keys, counts = both, sums
            held = keys, counts

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if waiting:
                merge()
            if held is None:
                return
            keys, counts = held
            held = None
            keys = keys >> np.uint64(8) << np.uint64(16) | keys & np.uint64(255)
            bucket = bucket_of(turned_back(keys), buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            del order
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*first[1:].tolist(), len(keys)]
            for k in range(0, len(first), 16):
                spans = list(zip(first[k : k + 16].tolist(), ends[k : k + 16], strict=True))
                yield row_batch(ASKED, [bucket[first[k : k + 16]], np.full(len(spans), now), [packed(keys[i:j]) for i, j in spans], [counts[i:j].tobytes() for i, j in spans]])

        for whole in batches:
            chunks = whole.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(chunks, prepend=-1)).tolist()
            for i, j in zip(starts, [*starts[1:], len(chunks)], strict=True):
                if chunks[i] != now:
                    yield from rows()
                    now = int(chunks[i])
                for batch in small_batches([whole.slice(i, j - i)], 2, BATCH // 4):
                    found, lengths = grams_of([sequence(v.as_py()) for v in batch.column(2)], depth)
                    trains = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64), lengths)
                    # turned n-grams have a free byte before the last: both move up, so that the last can be the mark
                    found = turned(found)
                    waiting.append(found & ~np.uint64(0xFFFF) | (found & np.uint64(255)) << MARK | trains)
                    if sum(map(len, waiting)) > CHUNK_GRAMS:
                        merge()
                        if len(held[0]) > CHUNK_GRAMS:
                            yield from rows()
        yield from rows()

    return over_batches(texts.select("chunk", "trains", "text"), ask, "bucket long, chunk long, grams binary, counts binary")


def longer_contexts(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For n-grams of whole contexts of TOP + 1 bytes and their training counts: the probability of each of their eight bits
    under the longer contexts (not a number if training texts have none of them), and for the nodes of the last depth of
    the top their names, zeros, ones and the sum of the weighted logs of the contexts that are longer by one byte."""
    symbol, top = grams & 255, min(depth, TOP)
    said = np.full((len(grams), 8), np.nan, np.float32)
    ends: list[tuple[np.ndarray, ...]] = []
    inverse: list[np.ndarray] = []
    for d in range(top, depth + 1):  # places of the contexts of each depth
        inverse.append(np.unique(grams >> 8 & ((1 << 8 * d) - 1), return_inverse=True)[1].astype(np.int64))
    for level in range(8):
        bit, node = (symbol >> (7 - level)) & 1, (1 << level) | (symbol >> (8 - level))
        one, there, below = np.zeros(len(grams)), np.zeros(len(grams), bool), None
        for d in range(depth, top - 1, -1):
            names, first, at = np.unique(inverse[d - top] << 8 | node, return_index=True, return_inverse=True)
            both, ones = (np.bincount(at, weights=w, minlength=len(names)) for w in (counts, counts * bit))
            longer = np.bincount(at[below[0]], weights=below[1], minlength=len(names)) if below is not None else None
            if d == top:
                met = both > 0
                name = (grams & ((1 << 8 * (top + 1)) - 256) | node)[first]
                ends.append((name[met], (both - ones)[met], ones[met], (np.zeros(len(names)) if longer is None else longer)[met]))
                break
            own = log_kt(both - ones, ones)
            weighted = np.logaddexp(own, own if longer is None else longer) - np.log(2)
            stop, mean = np.exp(own - np.log(2) - weighted), (ones + 0.5) / (both + 1)
            here = both[at] > 0
            one = np.where(here, np.where(there, stop[at] * mean[at] + (1 - stop[at]) * one, mean[at]), one)
            there |= here
            below = first, weighted
        said[there, level] = np.where(bit == 1, one, 1 - one)[there]
    return said, tuple(np.concatenate(x) for x in zip(*ends, strict=True))


MODEL = "grams binary, said binary, chunks array<long>, places array<binary>, names array<long>, zeros array<double>, ones array<double>, longer array<double>"
FOUND = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("logs", pa.binary())])


def scored_grams(texts: DataFrame, depth: int) -> DataFrame:
    """(chunk, n-grams, their base-2 logs of probability in 32 bits), packed, for all n-grams of each chunk. The whole tree is used: contexts
    of up to TOP bytes pass through the driver, longer ones are summed and weighted in the bucket of their last bytes."""
    size = texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    buckets = bucket_count(size, BUCKET)
    out = pa.schema([("grams", pa.binary()), ("said", pa.binary()), ("chunks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("names", pa.list_(pa.int64()))] + [(c, pa.list_(pa.float64())) for c in ("zeros", "ones", "longer")])

    def model(table: pa.Table) -> pa.Table:
        asked, numbers = table["grams"].combine_chunks(), table["counts"].combine_chunks()
        held, waiting = 0, []
        for k in range(len(asked)):
            waiting.append((unpacked(asked[k].as_py()), np.frombuffer(numbers[k].as_py(), np.int32)))
            held += len(waiting[-1][0])
            if held > FLUSH_GRAMS or k == len(asked) - 1:
                keys, at = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
                waiting, held = [(keys, np.bincount(at, weights=np.concatenate([w[1] for w in waiting]), minlength=len(keys)).astype(np.int64))], 0
        turns, counts = waiting[0]
        grams = turned_back(turns)
        said, ends = longer_contexts(grams, counts, depth)
        places = [packed(np.searchsorted(turns, unpacked(g.as_py()))) for g in asked]
        row = [[packed(turns)], [said.tobytes()], [table["chunk"].to_pylist()], [places], *([x] for x in ends)]
        return pa.Table.from_batches([row_batch(out, row)])

    held = stored(asked_grams(texts, depth, buckets).groupBy("bucket").applyInArrow(model, MODEL), "context-buckets")
    ends = held.select(F.explode(F.arrays_zip("names", "zeros", "ones", "longer")).alias("e")).select("e.*")
    ends = ends.groupBy("names").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer"))).toArrow()
    order = np.argsort(ends["names"].to_numpy())
    names, zeros, ones, longer = (ends[c].to_numpy()[order] for c in ("names", "zeros", "ones", "longer"))
    nodes, top = [(names, zeros, ones)], min(depth, TOP)
    for d in range(top - 1, -1, -1):
        shorter, at = np.unique(nodes[0][0] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        nodes.insert(0, (shorter, *(np.bincount(at, weights=w, minlength=len(shorter)) for w in nodes[0][1:])))
    tree = texts.sparkSession.sparkContext.broadcast(ContextTree(nodes, longer if depth > top else None))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, said, chunks, places in zip(*(batch.column(k) for k in range(4)), strict=True):
                turns = unpacked(grams.as_py())
                grams = turned_back(turns)
                said = np.frombuffer(said.as_buffer(), np.float32).reshape(-1, 8)
                logs = np.empty(len(grams), np.float32)
                for at in range(0, len(grams), 1 << 18):
                    logs[at : at + (1 << 18)] = tree.value.log_probability(grams[at : at + (1 << 18)], said[at : at + (1 << 18)].astype(np.float64)) / np.log(2)
                for chunk, place in zip(chunks.as_py(), places.values, strict=True):
                    place = unpacked(place.as_py()).astype(np.int64)
                    yield row_batch(FOUND, [[chunk], [packed(turns[place])], [logs[place].tobytes()]])

    return over_batches(held.select("grams", "said", "chunks", "places"), look_up, "chunk long, grams binary, logs binary")


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, bytes long, words array<binary>, times array<long>"


def score_texts(docs: DataFrame, training: DataFrame | None, depth: int = DEPTH, word_share: float = WORD_SHARE) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, held_out, text in bytes) under models learnt from ``training`` (text in bytes), or
    from the rows that are not held out where it is None.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Tokens are words and one
    end per text; the base score is the add-one unigram. An empty text has one token. Without training texts every byte
    costs eight bits. Repeated rows are scored each.

    Every context of the training texts is in the tree. Texts go by chunks: the distinct n-grams of a chunk are looked up in
    Spark once, and come back to its texts.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "held_out", F.lit(True).alias("scored"), (~F.col("held_out") if training is None else F.lit(False)).alias("trains"), "text")
    if training is not None:
        texts = texts.union(training.select(F.lit(None).cast("long"), F.lit(None).cast("boolean"), F.lit(False), F.lit(True), "text"))
    texts = stored(in_chunks(texts), "texts")
    training = texts.where("trains").select("text")
    grams = scored_grams(texts, depth)
    words = stored(count_words(training), "words")
    ends = training.count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = sums[0] + ends, sums[1] + (1 if ends else 0)
    often = words.where(F.col("n") >= max(2, word_share * tokens)).toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(often["word"].to_pylist(), often["n"].to_pylist(), strict=True)))
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64())]
        + [("score", pa.float64()), ("bytes", pa.int64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: float(np.log10(n + 1)) for w, n in shared.value.items()}
        now, parts, found = -1, [], None

        def runs() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy() << 1 | batch.column(1).to_numpy()
                starts = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
                for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                    yield batch.slice(i, j - i)

        for run in runs():
            if run.column(0)[0].as_py() != now:
                now, parts, found = run.column(0)[0].as_py(), [], None
            if run.column(1)[0].as_py() == 0:  # the n-grams of a chunk come before its texts
                parts += [(turned_back(unpacked(g.as_py())), np.frombuffer(v.as_py(), np.float32)) for g, v in zip(run.column(6), run.column(7), strict=True)]
                continue
            if parts:
                found, parts = Found(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
            for batch in small_batches([run], 5, BATCH // 2):
                yield scores_of(batch.select([2, 3, 4, 5]), found, logs)

    def scores_of(batch: pa.RecordBatch, logs_of: Found, logs: dict) -> pa.RecordBatch:
        texts = [words_of(v.as_py()) for v in batch.column(3)]
        keys, lengths = grams_of([b" ".join(words) + END for words in texts], depth)
        values = logs_of.of(keys).astype(np.float64)
        totals = np.add.reduceat(values, np.cumsum(lengths) - lengths) * np.log10(2)
        rows = ([], [], [], [], [])
        for found in texts:
            values = [logs.get(w) for w in found]
            rare = Counter([w for w, v in zip(found, values, strict=True) if v is None])
            times = list(rare.values())
            for column, x in zip(rows, (len(found) + 1, len(found) - sum(times), sum(filter(None, values)), list(rare), times), strict=True):
                column.append(x)
        return row_batch(schema, [*batch.columns[:3], *rows[:3], totals, lengths, *rows[3:]])

    asked = grams.select("chunk", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("doc_id", "long"), ("held_out", "boolean"), ("text", "binary"))), "grams", "logs")
    asked = asked.union(texts.where("scored").select("chunk", F.lit(1), "row", "doc_id", "held_out", "text", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    held = stored(over_batches(asked.repartition("chunk").sortWithinPartitions("chunk", "kind"), score, SCORED), "scored")
    rare = held.select("row", F.explode(F.map_from_arrays("words", "times")).alias("word", "times"))
    rare = rare.join(words, "word").groupBy("row")
    rare = rare.agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"))
    out = held.drop("words", "times").join(rare, "row", "left")
    rest = F.coalesce("add", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )


def op5_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = documents(spark, folder).select("doc_id", held_out.alias("held_out"), as_bytes("text").alias("text"))
    return score_texts(docs, None)
