"""Jaccard self-join of word n-gram sets with prefix trees, and its connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import (
    as_bytes,
    bucket_count,
    components,
    documents,
    flat_words,
    mixed,
    over_batches,
    rolling,
    row_batch,
    small_batches,
    stored,
    told_apart,
    word_hashes,
)

#: Sets of one size class differ in size by this factor at most.
CLASS_BASE = 1.4
#: Families up to this many sets and n-grams are joined in one task; larger ones in blocks, of half as many n-grams at most.
FAMILY_SETS, FAMILY_GRAMS, BLOCK = 4000, 2_000_000, 512
#: Families too large for one task, of up to this many sets, are told apart by sketches of 2^16 bits a set at most; two chunks meet in a task.
SKETCH_SETS, SKETCH_BITS, SKETCH_CHUNK = 65_536, 16, 2048
#: Common keys of a crowded family are those of more sets than this; the pairs of all others are counted.
COMMON = 32
#: Frequent n-grams are looked for in about so many documents. They only steer the order of parts, never the result.
ORDER_SAMPLE, FREQUENT = 8192, 2.0**-9
#: Bytes of text whose n-grams are held at a time: words, hashes and keys take some forty times as much.
TEXT_BYTES = 1 << 20
#: Keys that a part has to expect, a key for each 8 bytes of text; so many keys, or links, travel at a time.
PART_KEYS, SPLIT = 1 << 18, 1 << 19


class Sets:
    """Distinct n-gram hashes of a batch of texts, sorted within each text. A text with fewer words than n has one n-gram."""

    def __init__(self, column: pa.Array, n: int):
        lowered = pa.array([v.as_py().lower() for v in column], pa.binary())
        words, first, counts = flat_words(lowered)
        hashes = word_hashes(words)
        grams = rolling(hashes, n)
        windows = np.where(counts < n, counts > 0, counts - n + 1)
        begin = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(counts)), windows)
        at = np.arange(len(owner)) - np.repeat(begin - first, windows)
        value = grams[np.minimum(at, len(grams) - 1)] if len(grams) else np.zeros(len(owner), np.uint64)
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            value[begin[i]] = rolling(hashes[first[i] : first[i] + counts[i]] ^ np.uint64(n), int(counts[i]))[0]
        for a, b in zip(begin.tolist(), (begin + windows).tolist(), strict=True):
            value[a:b].sort()
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[fresh], owner[fresh]
        self.size = np.bincount(self.owner, minlength=len(counts))
        self.first = np.cumsum(self.size) - self.size


class Schemes:
    """Exact candidate keys for Jaccard >= share / whole.

    Sets fall into size classes. In the scheme of a class, n-gram space is cut into k parts by hash. Two linked sets differ in
    at most ``differ`` n-grams, so in at most so many parts; their lists of k (part, content) pairs share k - differ. Sorted by
    one global order, the first differ + 1 entries of both lists then share one (prefix filter), so those are the keys. Parts
    with many n-grams that are not frequent come first. A set joins the scheme of its class and, if a larger partner can be
    in the next class, that one's.
    """

    def __init__(self, share: int, whole: int):
        self.share, self.whole = share, whole
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_BASE)))
        self.bounds = np.array(bounds, np.int64)
        self.differ = (2 * (self.bounds[1:] - 1) * (whole - share)) // (whole + share)
        self.parts = np.maximum(2, (16 * (self.differ + 1) + 9) // 10)
        self.shared = np.maximum(1, 3 * (self.differ + 1) // 10)

    def keys(self, sets: Sets, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, key) of all sets; linked sets share one key at least."""
        return self.entries(sets, frequent, np.ones_like(self.shared))[:2]

    def entries(self, sets: Sets, frequent: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, scheme) of all sets; linked sets share ``shared`` keys of one scheme at least."""
        own_class = np.searchsorted(self.bounds, np.maximum(sets.size, 1), side="right") - 1
        reach = sets.size * self.whole // self.share
        owners, keys, schemes = [], [], []
        rare = np.ones(len(sets.value), bool)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, sets.value), len(frequent) - 1)
            rare = frequent[at] != sets.value
        content = mixed(sets.value)
        for up in (0, 1):
            scheme = own_class + up
            joined = sets.size > 0 if up == 0 else (sets.size > 0) & (reach >= self.bounds[scheme])
            take = joined[sets.owner]
            owner, k = sets.owner[take], self.parts[scheme[sets.owner[take]]].astype(np.uint64)
            part = ((sets.value[take] >> np.uint64(32)) * k >> np.uint64(32)).astype(np.int64)
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(fresh)
            if not len(starts):
                continue
            who, where = owner[starts], part[starts]
            key = mixed(np.add.reduceat(content[take], starts) ^ mixed((scheme[who] << 32 | where).astype(np.uint64)))
            size = np.diff(np.append(starts, len(owner)))
            few = np.add.reduceat(rare[take].astype(np.int64), starts)
            # One order for all sets: by what a part holds, then by its place.
            rank = (np.uint64(255) - np.minimum(few, 255).astype(np.uint64)) << np.uint64(56)
            rank |= (np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(48) | key >> np.uint64(16)
            counts = np.bincount(who, minlength=len(sets.size))
            begin = np.cumsum(counts) - counts
            wanted = self.differ[scheme] + shared[scheme]
            chosen = [np.zeros(0, np.int64)]
            for i in np.flatnonzero(counts).tolist():
                a, b = int(begin[i]), int(begin[i] + counts[i])
                chosen.append(a + (np.argsort(rank[a:b], kind="stable")[: wanted[i]] if wanted[i] < b - a else np.arange(b - a)))
            chosen = np.concatenate(chosen)
            owners.append(who[chosen])
            keys.append(key[chosen])
            schemes.append(scheme[who[chosen]])
            # Empty parts come last in the order; a set with too few others needs them too.
            for i in np.flatnonzero(joined & (counts < wanted)):
                used = set(where[begin[i] : begin[i] + counts[i]].tolist())
                empty = [j for j in range(int(self.parts[scheme[i]])) if j not in used]
                code = mixed(mixed(np.array([int(scheme[i]) << 32 | j for j in empty], np.uint64)) + np.uint64(1))
                more = np.sort(code)[: int(wanted[i] - counts[i])]
                owners.append(np.full(len(more), i))
                keys.append(more)
                schemes.append(np.full(len(more), scheme[i]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(owners or none), np.concatenate(keys or none).astype(np.uint64), np.concatenate(schemes or none)


class Components:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, i: int) -> int:
        parent = self.parent
        root = i
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


MIXED = object()


class Trie:
    """Path-compressed prefix tree of sets given as sorted places in one order.

    Nodes know the sizes below them, and a set that all sets below are connected to as far as known (or that they are mixed).
    """

    def __init__(self, width: int, share: int, whole: int):
        self.share, self.whole = share, whole
        self.inside = np.zeros(width + 1, bool)  # marks of the set that is looked for
        self.known = Components()
        # segment, children, sets that end here, least and most size below, one connected set or MIXED
        self.root = [np.zeros(0, np.int64), {}, [], 1 << 60, 0, None]

    def add(self, places: np.ndarray, name: int) -> None:
        node, at, size = self.root, 0, len(places)
        while True:
            node[3], node[4] = min(node[3], size), max(node[4], size)
            if node[5] is None:
                node[5] = name
            elif node[5] is not MIXED and self.known.find(node[5]) != self.known.find(name):
                node[5] = MIXED
            if at == size:
                node[2].append(name)
                return
            child = node[1].get(int(places[at]))
            if child is None:
                node[1][int(places[at])] = [places[at:], {}, [name], size, size, name]
                return
            segment = child[0]
            n = min(len(segment), size - at)
            apart = np.flatnonzero(segment[:n] != places[at : at + n])
            common = int(apart[0]) if len(apart) else n
            if common < len(segment):
                node[1][int(places[at])] = [segment[:common], {int(segment[common]): [segment[common:], *child[1:]]}, [], *child[3:]]
                child = node[1][int(places[at])]
            node, at = child, at + common

    def connect(self, places: np.ndarray, name: int) -> None:
        """Join ``name`` to the components of all sets it is linked with. Subtrees of its own component are left out."""
        for other in self.linked(places, name):
            self.known.union(name, other)

    def linked(self, places: np.ndarray, name: int | None = None) -> Iterator[int]:
        """Names of the sets with share * union <= whole * intersection. Partial overlaps are counted once per node, and a
        subtree is left as soon as what remains of either set cannot reach the bound, or if all its sets are known to be
        in the component of ``name``."""
        n = len(places)
        inside = self.inside
        both = self.share + self.whole
        stack = [(self.root, 0, 0)]
        inside[places] = True
        try:
            while stack:
                node, overlap, depth = stack.pop()
                if name is not None and node[5] is not MIXED and node[5] is not None and self.known.find(node[5]) == self.known.find(name):
                    continue
                segment = node[0]
                rest = n
                if len(segment):
                    overlap += int(np.count_nonzero(inside[segment]))
                    depth += len(segment)
                    rest = n - int(places.searchsorted(segment[-1], "right"))
                best = min(max(depth + rest, node[3]), node[4])  # the size below with the best chance
                if both * (overlap + min(rest, best - depth)) < self.share * (n + best):
                    continue
                if node[2] and both * overlap >= self.share * (n + depth):
                    yield from node[2]
                for child in node[1].values():
                    stack.append((child, overlap, depth))
        finally:
            inside[places] = False


def ordered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets as sorted places in their common order: frequent n-grams first, so that like sets share long paths."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    place = np.empty(len(values), np.int32)
    place[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.int32)
    return [np.sort(place[np.searchsorted(values, s)]) for s in sets], len(values)


GROUPED = pa.schema([("family", pa.int64()), ("chunk", pa.int64()), ("block", pa.bool_()), ("doc_id", pa.int64()), ("grams", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def link_groups(rows: DataFrame, share: int, whole: int) -> DataFrame:
    """Links of all sets of each (family, chunk) with its ``block`` sets, by a trie of the block, reduced to one edge
    (smallest set of the links' component, other set) per set, so that a group of near copies stays linear.

    A group is bounded by its maker: a family of limited size, or a chunk and a block of a larger family.
    """

    def join(group: pa.Table) -> pa.RecordBatch:
        ids, block = group["doc_id"].to_numpy(), group["block"].to_numpy(zero_copy_only=False)
        sets, width = ordered([np.frombuffer(g.as_buffer(), np.uint64) for g in group["grams"]])
        trie = Trie(width, share, whole)
        for i in np.flatnonzero(block):
            trie.connect(sets[i], int(ids[i]))
            trie.add(sets[i], int(ids[i]))
        for i in np.flatnonzero(~block):
            trie.connect(sets[i], int(ids[i]))
        found = [(trie.known.find(int(i)), int(i)) for i in ids]
        return row_batch(LINKS, [[r for r, i in found if r != i], [i for r, i in found if r != i]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if waiting and (waiting[-1].column(0)[0] != part.column(0)[0] or waiting[-1].column(1)[0] != part.column(1)[0]):
                    yield join(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(part)
        if waiting:
            yield join(pa.Table.from_batches(waiting))

    rows = rows.select("family", "chunk", "block", "doc_id", "grams").repartition("family", "chunk").sortWithinPartitions("family", "chunk")
    return over_batches(rows, work, "a long, b long")


def _map_sets(rows: DataFrame, n: int, make: Callable, kind: str, text_column: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_column, TEXT_BYTES):
            yield make(batch, Sets(batch.column(text_column), n))

    return over_batches(rows, work, kind)


def _star(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the smallest document of each, and pairs (that one, other document of the key), for rows sorted by key."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(first):
        return key, doc, np.zeros((0, 2), np.int64)
    least = np.minimum.reduceat(doc, first)
    leader = np.repeat(least, np.diff(np.append(first, len(key))))
    pairs = np.stack([leader, doc], 1)[leader != doc]
    return key[first], least, np.unique(pairs, axis=0) if len(pairs) else pairs


def candidates(texts: DataFrame, n: int, schemes: Schemes, frequent: np.ndarray, parts: int = 16) -> DataFrame:
    """Digests of all texts' sets and edges whose components hold every linked pair, from one pass over the texts.

    Rows have (doc_id, n_shingles, high, low), or null digests and an edge (doc_id, b). Documents with a common key hang on the
    smallest of them: first within some batches of a task, so that a key is shuffled once for these, then over all. A text
    with a null id has no edges. Keys are dealt to ``parts`` (a power of two) by their highest bits and travel packed, a row
    for each part and some batches; one part is sorted at a time.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("data", pa.binary())])
    found = pa.schema([("doc_id", pa.int64()), ("b", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    shift = np.uint64(64 - parts.bit_length() + 1)

    def packed(keys: list[np.ndarray], docs: list[np.ndarray], digests: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        key, least, pairs = _star(key[order], doc[order])
        edges = np.searchsorted(key >> shift if parts > 1 else np.zeros(len(key), np.int64), np.arange(parts + 1).astype(np.uint64)).tolist()
        rows = [(i, 0, key[a:b].tobytes() + least[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        spread = int(least[0]) if len(least) else 0
        rows += [((spread + i) % parts, 1, d.tobytes()) for i, d in enumerate(digests)]
        rows += [((spread + i) % parts, 2, pairs[i : i + SPLIT].tobytes()) for i in range(0, len(pairs), SPLIT)]
        return row_batch(schema, [list(c) for c in zip(*rows, strict=True)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, digests = [], [], []
        for batch in small_batches(batches, 1, TEXT_BYTES):
            sets, ids = Sets(batch.column(1), n), batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(sets.size)
            digest = np.zeros((len(sets.size), 5), np.int64)
            digest[:, 0], digest[:, 1], digest[:, 2] = ids.fill_null(0).to_numpy(), known, sets.size
            for salt in (1, 2) if len(some) else ():
                digest[some, 2 + salt] = np.add.reduceat(mixed(sets.value + np.uint64(salt)), sets.first[some]).view(np.int64)
            owner, key = schemes.keys(sets, shared.value)
            digests.append(digest)
            keys.append(key[known[owner]])
            docs.append(digest[owner[known[owner]], 0])
            if sum(map(len, keys)) >= SPLIT:
                yield packed(keys, docs, digests)
                keys, docs, digests = [], [], []
        if digests:
            yield packed(keys, docs, digests)

    def tied(rows: list[bytes]) -> np.ndarray:
        half = [len(r) // 2 for r in rows]
        key = np.concatenate([np.frombuffer(r, np.uint64, h // 8) for r, h in zip(rows, half, strict=True)])
        doc = np.concatenate([np.frombuffer(r, np.int64, offset=h) for r, h in zip(rows, half, strict=True)])
        order = np.argsort(key)
        return _star(key[order], doc[order])[2]

    def linked(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pairs), SPLIT):
            a, b = pairs[i : i + SPLIT].T
            yield row_batch(found, [a, b, *[pa.nulls(len(a), pa.int64())] * 3])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if part != held and rows:
                        yield from linked(tied(rows))
                        rows = []
                    held = part
                    rows.append(data)
                elif kind == 1:
                    digest = np.frombuffer(data, np.int64).reshape(-1, 5)
                    ids = pa.array(digest[:, 0], mask=digest[:, 1] == 0)
                    yield row_batch(found, [ids, pa.nulls(len(digest), pa.int64()), *digest[:, 2:].T])
                else:
                    yield from linked(np.frombuffer(data, np.int64).reshape(-1, 2))
        if rows:
            yield from linked(tied(rows))

    rows = over_batches(texts, emit, "part long, kind long, data binary")
    rows = rows.repartition("part").sortWithinPartitions("part")
    return over_batches(rows, walk, "doc_id long, b long, n_shingles long, high long, low long")


def strong_edges(texts: DataFrame, n: int, schemes: Schemes, frequent: np.ndarray) -> DataFrame:
    """Edges (a, b) whose components hold every linked pair, closer than those of ``candidate_edges``; for its crowded families.

    Linked sets share m keys of a scheme. Either half of these are keys of few sets, whose pairs are counted, or one is a
    common key, whose sets all hang on the smallest. Long texts with a passage in common share a key or two and stay apart.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("need", pa.int64())])
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64())])

    def emit(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
        owner, key, scheme = schemes.entries(sets, shared.value, schemes.shared)
        return row_batch(schema, [key.astype(np.int64), batch.column(0).to_numpy()[owner], (schemes.shared[scheme] + 1) // 2])

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] ^ 1))
        size = np.diff(np.append(first, rows.shape[1]))
        at, size = np.repeat(first, size), np.repeat(size, size)
        common = (size > COMMON) & (at != np.arange(rows.shape[1]))
        found = [np.stack([rows[1, at[common]], rows[1, common], np.zeros(int(common.sum()), np.int64)])]
        few = rows[:, (size > 1) & (size <= COMMON)]
        for step in range(1, min(COMMON, few.shape[1])):
            met = few[0, step:] == few[0, :-step]
            if not met.any():
                break
            found.append(np.stack([few[1, :-step][met], few[1, step:][met], few[2, step:][met]]))
        return row_batch(pair, list(np.concatenate(found, axis=1)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            rows = rows[:, fresh]
            if not rows.shape[1]:
                continue
            last = int(np.flatnonzero(rows[0] == rows[0, -1])[0])
            # The last key may go on. Of a common one the start is enough to know it by.
            done = last if rows.shape[1] - last <= COMMON else rows.shape[1]
            held = rows[:, last : last + COMMON + 1]
            if done:
                yield pairs(rows[:, :done])
        if held.shape[1]:
            yield pairs(held)

    rows = _map_sets(texts, n, emit, "key long, doc long, need long", 1)
    met = over_batches(rows.repartition("key").sortWithinPartitions("key", "doc"), walk, "a long, b long, need long")
    return met.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("a", "b")


def _sketches(sets: Sets) -> list[bytes]:
    """Of each set as many bits as it has n-grams, rounded up to a power of two: whether an odd number of n-grams falls on a bit.

    Sketches of two sets differ in no more bits than the sets in n-grams. Halves of a sketch, one XOR the other, are the sketch
    of half the bits.
    """
    out = []
    bits = mixed(sets.value)
    for a, size in zip(sets.first.tolist(), sets.size.tolist(), strict=True):
        width = min(max((size - 1).bit_length(), 6), SKETCH_BITS)
        place = (bits[a : a + size] >> np.uint64(64 - width)).astype(np.int64)
        out.append(np.packbits(np.bincount(place, minlength=1 << width).astype(np.uint8) & 1).tobytes())
    return out


def _like(sketches: list[bytes], size: np.ndarray, side: np.ndarray, share: int, whole: int) -> list[tuple[int, int]]:
    """Places (a, b) of sets whose components hold all pairs that may be linked, of one side or, if there are two, of both."""
    width = min(map(len, sketches))
    rows = []
    for sketch in sketches:
        bits = np.frombuffer(sketch, np.uint64)
        while bits.nbytes > width:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        rows.append(bits)
    bits = np.stack(rows)
    root = np.arange(len(rows))
    second = np.flatnonzero(side == side.max())
    second = second[np.argsort(size[second], kind="stable")]
    sizes = size[second]
    for i in np.flatnonzero(side == side.min()).tolist():
        low, high = np.searchsorted(sizes, -(-size[i] * share // whole), "left"), np.searchsorted(sizes, size[i] * whole // share, "right")
        near = second[low:high]
        near = near[root[near] != root[i]]  # these are in one component already
        apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for r in np.unique(root[near[(whole + share) * apart <= (whole - share) * (size[near] + size[i])]]).tolist():
            root[root == r] = root[i]
    return [(r, i) for i, r in enumerate(root.tolist()) if r != i]


def sketch_edges(texts: DataFrame, n: int, share: int, whole: int) -> DataFrame:
    """Edges (a, b) whose components hold every linked pair within the families of ``texts`` (doc_id, text, family), and little else.

    Linked sets of A and B n-grams differ in (A + B)(whole - share) / (whole + share) n-grams at most, so in no more bits of
    their sketches. Sets of a family are dealt by size and in chunks; each two chunks with sizes that can be linked meet in one task.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("family", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])

    def emit(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
        return row_batch(kind, [batch.column(0), batch.column(2), sets.size, _sketches(sets)])

    made = _map_sets(texts, n, emit, "doc_id long, family long, size long, sketch binary", 1).where("size > 0")
    # Linked sets are of one class or of neighbouring ones: a class is wider than their sizes can differ, by more than rounding.
    level = F.floor(F.log(F.col("size")) / F.log(F.lit(1.05 * whole / share)))
    made = stored(made.withColumn("level", level), "sketches")
    bins = stored(made.groupBy("family", "level").agg(F.ceil(F.count(F.lit(1)) / SKETCH_CHUNK).alias("chunks")), "sketch-bins")
    for step, name in ((0, "own"), (1, "up"), (-1, "down")):
        at = bins.select("family", (F.col("level") - step).alias("level"), F.col("chunks").alias(name))
        made = made.join(at, ["family", "level"], "left")
    made = made.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("own")))
    task = "struct({level} AS task, CAST({low} AS LONG) AS low, CAST({up} AS INT) AS up, CAST({high} AS LONG) AS high, {side} AS side)"
    each = lambda count, task: f"if({count} > 0, transform(sequence(1L, {count}), k -> {task}), array())"
    same = task.format(level="level", low="least(k - 1, chunk)", up=0, high="greatest(k - 1, chunk)", side="k - 1 < chunk")
    above = task.format(level="level", low="chunk", up=1, high="k - 1", side="false")
    below = task.format(level="level - 1", low="k - 1", up=1, high="chunk", side="true")
    tasks = F.expr(f"concat({each('own', same)}, {each('coalesce(up, 0L)', above)}, {each('coalesce(down, 0L)', below)})")
    dealt = made.select("doc_id", "family", "size", "sketch", F.explode(tasks).alias("t")).select("doc_id", "family", "size", "sketch", "t.*")

    def join(group: pa.Table) -> pa.Table:
        ids, size = group["doc_id"].to_numpy(), group["size"].to_numpy()
        found = _like(group["sketch"].to_pylist(), size, group["side"].to_numpy(), share, whole)
        return pa.table([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[i] for _, i in found], pa.int64())], schema=LINKS)

    # A task of one side holds the pairs within a chunk; one of two sides needs both.
    return dealt.groupBy("family", "task", "low", "up", "high").applyInArrow(join, "a long, b long").where("a <> b").distinct()


def frequent_grams(texts: DataFrame, n: int, rows: int) -> np.ndarray:
    """Sorted hashes of n-grams that many of some thousand documents have. Steers the order of parts only."""
    step = max(1, rows // ORDER_SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(step)) == 0)
    schema = pa.schema([("gram", pa.int64())])
    grams = _map_sets(some, n, lambda _, sets: row_batch(schema, [sets.value.astype(np.int64)]), "gram long", 1)
    found = grams.groupBy("gram").count().where(F.col("count") >= max(4, FREQUENT * rows / step)).toArrow()
    return np.sort(found["gram"].to_numpy().astype(np.uint64))


def _large_links(members: DataFrame, sets: DataFrame, share: int, whole: int, block: int, chunk: int, grams: int = FAMILY_GRAMS // 2) -> DataFrame:
    """Links that connect the components of families too large for one task; (doc_id, root) of all their sets.

    Each round joins a block of sets of every family with all of the family's sets, chunk by chunk. Sets that were in a block are
    done. Sets outside of the family's largest component go first; a family is done when all sets that are left are in
    one component, since no link is missing then. So a family of near copies takes few rounds, and any family ends. A
    block has ``block`` sets and ``grams`` n-grams at most (or is a single set), and chunks are about as large.
    """
    held = stored(members.select("doc_id", "family", "size", F.col("doc_id").alias("root"), F.lit(False).alias("done")), "large")
    while True:
        open_roots = held.where("NOT done").groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        state = open_roots.groupBy("family").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.max(F.struct("n", "root")).alias("top"))
        state = stored(state.where("roots > 1").select("family", "n", "all", F.col("top.root").alias("top")), "open-families")
        if state.isEmpty():
            return held.select("doc_id", "root")
        todo = held.where("NOT done").join(state, "family")
        first = Window.partitionBy("family").orderBy((F.col("root") == F.col("top")).cast("int"), "doc_id")
        picked = todo.withColumn("k", F.row_number().over(first)).where(F.col("k") <= block)
        picked = picked.withColumn("upto", F.sum("size").over(Window.partitionBy("family").orderBy("k")))
        picked = stored(picked.where((F.col("k") == 1) | (F.col("upto") <= grams)).select("doc_id", "family", "n", "all"), "block")
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk), F.ceil(F.col("all") / grams)).cast("long")
        others = todo.join(picked.select("doc_id"), "doc_id", "left_anti")
        others = others.select("doc_id", "family", F.pmod(F.xxhash64("doc_id"), chunks).cast("long").alias("chunk"), F.lit(False).alias("block"))
        copies = picked.select("doc_id", "family", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(True).alias("block"))
        links = stored(link_groups(others.union(copies).join(sets.select("doc_id", "grams"), "doc_id"), share, whole), "large-links")
        roots = components(held.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).union(links), "large-roots")
        marked = held.join(picked.select("doc_id", F.lit(True).alias("now")), "doc_id", "left").join(roots.withColumnsRenamed({"node": "doc_id", "root": "r"}), "doc_id", "left")
        held = stored(marked.select("doc_id", "family", "size", F.coalesce("r", "doc_id").alias("root"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "large")


def _as_families(roots: DataFrame) -> DataFrame:
    """(doc_id, family) of components, roots included."""
    found = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("family"))
    return found.union(found.select(F.col("family").alias("doc_id"), "family")).distinct()


def _beyond(families: DataFrame, family_sets: int) -> DataFrame:
    """Families too large for one task, with their sets."""
    bulk = families.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all"))
    return stored(bulk.where(F.expr(f"sets > {family_sets} OR all > {FAMILY_GRAMS}")).select("family", "sets"), "large-families")


def jaccard_components(
    docs: DataFrame, n: int = 5, share: int = 80, whole: int = 100, text: str = "text", family_sets: int = FAMILY_SETS, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents are linked when the Jaccard coefficient of their word
    n-gram sets is at least share / whole; a component is named after its smallest id.

    Equal sets are joined as one. Candidate keys (see Schemes) tie the others to families; each family's sets go to one
    task, once, where a trie finds the links. Families beyond a bound are told apart by more keys (see strong_edges); those
    still beyond it are joined block by block.

    Null or empty texts, and texts without words, have an empty set and stay alone. Rows that repeat an id are one
    document's. A row with a null id takes the component of documents with its set, else null. No rows, no result.
    """
    schemes = Schemes(share, whole)
    texts = docs.select("doc_id", as_bytes(text).alias("text"))
    ids = texts.where("doc_id IS NOT NULL")
    count, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequent = frequent_grams(ids, n, count)
    found = stored(candidates(texts, n, schemes, frequent, bucket_count(size // 8, PART_KEYS)), "candidates")
    rows = found.where("n_shingles IS NOT NULL").drop("b")
    edges = found.where("n_shingles IS NULL").select(F.col("doc_id").alias("a"), "b").distinct()
    same = rows.where("n_shingles > 0").groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = stored(same, "equal-sets")
    copies = rows.join(same, ["high", "low", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep").distinct()
    copies = stored(copies, "set-copies")
    for end in ("a", "b"):  # one document stands for all with its set
        edges = edges.join(copies.withColumnsRenamed({"doc_id": end, "rep": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    families = _as_families(components(edges, "families"))
    sizes = rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    families = stored(families.join(sizes, "doc_id"), "family-members")

    def finer(families: DataFrame, large: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
        crowd = stored(families.join(large, "family").select("doc_id", "family", "n"), "crowds")
        crowded = told_apart(ids, crowd, ["doc_id"])[1].join(crowd.select("doc_id", "family"), "doc_id")
        found = _as_families(components(edges(crowded), "finer-families")).join(crowd.select("doc_id", "n"), "doc_id")
        return stored(families.join(large, "family", "left_anti").unionByName(found.select("family", "doc_id", "n")), "finer-members")

    large = _beyond(families, family_sets)
    huge = large.where(F.col("sets") > SKETCH_SETS)
    if not huge.isEmpty():
        families = finer(families, huge, lambda crowded: strong_edges(crowded, n, schemes, frequent))
        large = _beyond(families, family_sets)
    crowds = large.where(F.col("sets") <= SKETCH_SETS)
    if not crowds.isEmpty():
        families = finer(families, crowds, lambda crowded: sketch_edges(crowded, n, share, whole))
        large = _beyond(families, family_sets)
    members = families.join(large.select("family", F.lit(True).alias("large")), "family", "left").select("doc_id", "family", F.coalesce("large", F.lit(False)).alias("large"))

    grouped = pa.schema([("doc_id", pa.int64()), ("family", pa.int64()), ("large", pa.bool_()), ("grams", pa.binary())])

    def whole_sets(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
        grams = [sets.value[a : a + k].tobytes() for a, k in zip(sets.first.tolist(), sets.size.tolist(), strict=True)]
        return row_batch(grouped, [batch.column(0), batch.column(2), batch.column(3), grams])

    held = _map_sets(told_apart(ids, families, ["doc_id"])[1].join(members, "doc_id"), n, whole_sets, "doc_id long, family long, large boolean, grams binary", 1)
    some_large = not large.isEmpty()
    if some_large:
        held = stored(held, "family-sets")
    small = held.where("NOT large").select("family", F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("block"), "doc_id", "grams")
    roots = components(link_groups(small, share, whole), "links").select(F.col("node").alias("rep"), "root")
    if some_large:
        wide = held.where("large")
        roots = roots.union(_large_links(wide.groupBy("doc_id", "family").agg(F.max(F.length("grams") / 8).cast("long").alias("size")), wide, share, whole, block, block).withColumnRenamed("doc_id", "rep"))
    named = same.join(roots, "rep", "left").select("high", "low", "n_shingles", F.coalesce("root", "rep").alias("found"))
    out = rows.join(named, ["high", "low", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))


def op3_trie_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder), n=4, share=85)


ORACLE = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
               ELSE [array_to_string(words[i + 1 : i + 4], ' ') FOR i IN range(len(words) - 3)] END AS gs FROM d WHERE len(words) > 0), LATERAL (SELECT unnest(gs) AS g)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)"""
