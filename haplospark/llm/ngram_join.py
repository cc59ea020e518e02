"""N-gram Jaccard join of all documents: prefix trees over globally ordered shingle sets.

Two sets with Jaccard similarity of at least 4/5 share one of their first n - ceil(4n/5) + 1 elements in any global order.
The order used here puts rare shingles first, by a fixed-size table of counts. A set's prefix is dealt to buckets by
shingle; in a bucket the ordered lists form a trie, so that sets with a common beginning share nodes. It is walked depth
first: what a path has met of other sets is kept once for all sets below, and a set is dropped for a whole subtree when
the remaining lengths allow too little overlap. Surviving pairs are compared in full.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store
from .shingles import chunks, mix, shingle_hashes, shingle_sets, word_hashes

#: Similarity is at least ABOVE / OF.
ABOVE, OF = 4, 5
#: Counts of shingles are kept in 2**COUNT_BITS cells, whatever the input; a class of a byte per cell is what tasks get: 4 MB.
COUNT_BITS, COUNT_PARTS = 22, 16
#: Tokens that a task packs before it sends them off.
FLUSH_TOKENS = 1 << 19
BUCKET_BYTES, LEAST_BUCKETS = 48 << 20, 64
#: A shingle in the prefixes of more sets than this isn't paired in the bucket; its sets are compared as a family.
LONG_LIST = 64
#: Families are compared in blocks of about so many shingles.
BLOCK_TOKENS = 1 << 21
FILTER_BITS = 23
SALTS = 64

_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
PROFILE = "doc_id long, n long, key long, part int, counts binary"


def set_key(grams: np.ndarray) -> int | None:
    """A 64-bit name of a set, as a signed integer; None of the empty set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())))) if len(grams) else None


def profile(docs: DataFrame) -> DataFrame:
    """Per document its set's size and key, and per task the counts of its shingles by cell, packed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            if waiting:
                counts[:] += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
                waiting.clear()

        for batch in batches:
            sizes, keys = [], []
            for at, end, data, offsets in chunks(batch.column(1)):
                grams, begin = shingle_hashes(*word_hashes(data, offsets))
                waiting.append((grams >> np.uint64(64 - COUNT_BITS)).astype(np.int32))
                if sum(map(len, waiting)) > FLUSH_TOKENS:
                    count()
                for i in range(end - at):
                    own = np.unique(grams[begin[i] : begin[i + 1]])
                    sizes.append(len(own))
                    keys.append(set_key(own))
            nothing = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], schema=_PROFILE)
        count()
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(x.tobytes()) for x in np.split(counts, COUNT_PARTS)]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(COUNT_PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=_PROFILE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, PROFILE)


def total_counts(profiled: DataFrame) -> np.ndarray:
    """The class (half powers of two) of each cell's count over all tasks: parts are summed by a task each, and the fixed
    4 MB go to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(unpack.decompress(data), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            data = (np.log2(np.maximum(x, 1)) * 2).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "counts"])

    out = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), np.uint8)
    parts = profiled.filter("part is not null").select("part", "counts").repartition(COUNT_PARTS, "part")
    for row in parts.mapInArrow(add, "part int, counts binary").collect():
        out[row.part] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(-1)


def order_of(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions that put a sorted set in the global order: by class of count (half powers of two), then by hash."""
    rank = np.minimum(counts[(grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], 63)
    return np.argsort((rank.astype(np.uint64) << np.uint64(58)) | (mix(grams) >> np.uint64(6)), kind="stable")


def prefix_length(n: int) -> int:
    return n - -(-ABOVE * n // OF) + 1


def pack(keys, sizes, lengths, tokens, at, hot) -> bytes:
    head = struct.pack("<II", len(keys), len(tokens))
    parts = [np.asarray(keys, "<i8"), np.asarray(sizes, "<u4"), np.asarray(lengths, "<u4"), np.asarray(tokens, "<u8"), np.asarray(at, "<u4"), np.asarray(hot, "u1")]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in parts))


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    docs, tokens = struct.unpack_from("<II", raw)
    out, begin = [], 8
    for kind, n in (("<i8", docs), ("<u4", docs), ("<u4", docs), ("<u8", tokens), ("<u4", tokens), ("u1", tokens)):
        out.append(np.frombuffer(raw, kind, n, begin))
        begin += out[-1].nbytes
    return tuple(out)


def prefixes(docs: DataFrame, counts, buckets: int) -> DataFrame:
    """docs (text) -> bucket, sets, a, b: many sets' prefixes, those of their shingles that belong to the bucket; or a family.

    counts: a broadcast variable with the table of counts. A set that a task has seen is left out: its copies add nothing. Of
    a shingle that more than LONG_LIST sets of a task share, only the set with the least key goes to the bucket; the others
    are told to be its family here (a, b). So a shingle of a third of all sets gives its bucket a row per task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        held: list[tuple[int, int, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(t) for *_, t in held])
            doc = np.repeat(np.arange(len(held)), lengths)
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            tokens = np.concatenate([t for *_, t in held])
            keys = np.array([h[0] for h in held], np.int64)
            doc, at, tokens, hot, members, heads = _without_long_lists(doc, at, tokens, keys)
            spread = (mix(members.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(members), pa.binary()), pa.array(heads), pa.array(members)], names=names_of)
            bucket = ((mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            doc, at, tokens, bucket, hot = doc[order], at[order], tokens[order], bucket[order], hot[order]
            sizes = np.array([h[1] for h in held], np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            names, rows = [], []
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                own, counted = np.unique(doc[part], return_counts=True)
                names.append(int(b))
                rows.append(pack(keys[own], sizes[own], counted, tokens[part], at[part], hot[part]))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(rows, pa.binary()), none, none], names=names_of)

        for batch in batches:
            for _, grams in shingle_sets(batch.column(0)):
                key = set_key(grams)
                if key is None or key in seen:
                    continue
                seen.add(key)
                tokens = grams[order_of(grams, table)[: prefix_length(len(grams))]]
                held.append((key, len(grams), tokens))
                total += len(tokens)
                if total >= FLUSH_TOKENS:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    names_of = ["bucket", "sets", "a", "b"]
    return docs.select("text").mapInArrow(scan, "bucket int, sets binary, a long, b long")


def _without_long_lists(doc: np.ndarray, at: np.ndarray, tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of sets (doc, place, token) without all but the least set of long lists, which token is one of those, and
    (key, least key) of the sets of a long list, in each family once."""
    order = np.lexsort((keys[doc], tokens))
    begin = np.flatnonzero(np.concatenate(([True], tokens[order][1:] != tokens[order][:-1])))
    count = np.diff(np.append(begin, len(order)))
    long = np.repeat(count > LONG_LIST, count)
    first = np.zeros(len(order), bool)
    first[begin] = True
    head = np.repeat(doc[order][begin], count)
    family: dict[int, int] = {}
    for x, y in set(zip(head[long & ~first].tolist(), doc[order][long & ~first].tolist(), strict=True)):
        x, y = _root(family, x), _root(family, y)
        if x != y:
            family[y if keys[x] < keys[y] else x] = x if keys[x] < keys[y] else y
    rows = np.array([(keys[x], keys[_root(family, x)]) for x in family], np.int64).reshape(-1, 2)
    stay = np.sort(order[first | ~long])
    hot = np.zeros(len(order), bool)
    hot[order[long]] = True
    return doc[stay], at[stay], tokens[stay], hot[stay], rows[:, 0], rows[:, 1]


class Bucket:
    """The sets of a bucket as a trie, and the pairs that may be similar."""

    def __init__(self, packed: list[bytes]):
        parts = [unpack(p) for p in packed]
        keys, sizes, lengths, tokens, at, hot = (np.concatenate([p[k] for p in parts]) for k in range(6))
        self.hot = set(tokens[hot > 0].tolist())
        self.keys, first, doc = np.unique(keys, return_index=True, return_inverse=True)
        use = np.zeros(len(keys), bool)
        use[first] = True
        use, doc = np.repeat(use, lengths), np.repeat(doc, lengths)
        self.sizes = sizes[first].astype(np.int64)
        doc, tokens, at = doc[use], tokens[use], at[use].astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = tokens[order][1:] == tokens[order][:-1]
        shared = np.sort(order[same[1:] | same[:-1]])  # the others are in one set only
        self._grow(doc[shared], tokens[shared], at[shared])

    def _grow(self, doc: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> None:
        """Sets in order of their lists are the leaves from left to right, so a node is a run of them."""
        order = np.lexsort((at, doc))
        doc, tokens, at = doc[order], tokens[order], at[order]
        own, begin = np.unique(doc, return_index=True)
        end = np.append(begin[1:], len(doc))[: len(own)]
        lists = sorted((tokens[b:e].tolist(), at[b:e].tolist(), int(d)) for d, b, e in zip(own, begin, end, strict=True))
        self.leaves = np.array([d for *_, d in lists], np.int64)
        self.lists = [t for t, *_ in lists]
        self.rest: list[list[int]] = [(self.sizes[d] - 1 - np.array(a, np.int64)).tolist() for _, a, d in lists]
        #: by token: (depth, first leaf, end leaf)
        self.nodes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.end: dict[tuple[int, int], int] = {}  # by depth and first leaf
        path: list[tuple[int, int]] = []
        for i in range(len(lists) + 1):
            mine = lists[i][0] if i < len(lists) else []
            shared = 0
            while shared < len(path) and shared < len(mine) and path[shared][0] == mine[shared]:
                shared += 1
            while len(path) > shared:
                token, start = path.pop()
                self.nodes[token].append((len(path), start, i))
                self.end[len(path), start] = i
            path += [(t, i) for t in mine[shared:]]

    def holders(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
        """(by token its leaves in order, each with the number of its elements that follow, by member of a long list the least of its family).

        A token below one node only, but for nodes at the root, is left out: its leaves have met at the node above.
        """
        lists: dict[int, list[tuple[int, int]]] = {}
        family: dict[int, int] = {}
        for token, nodes in self.nodes.items():
            if len(nodes) == 1 and (nodes[0][0] > 0 and token not in self.hot or nodes[0][2] - nodes[0][1] < 2):
                continue
            leaves = np.concatenate([np.arange(s, e) for _, s, e in nodes])
            if len(leaves) > LONG_LIST or token in self.hot:
                roots = {_root(family, x) for x in self.leaves[leaves].tolist()}
                for r in roots:
                    family[r] = min(roots)
            else:
                lists[token] = [(i, self.rest[i][d]) for d, s, e in nodes for i in range(s, e)]
        return lists, {x: _root(family, x) for x in family}

    def pairs(self) -> tuple[np.ndarray, dict[int, int]]:
        """(pairs to compare, by member of a long list the set of its family with the least key), as numbers of sets.

        The trie is walked depth first. For the current path, each leaf that shares a token with it keeps where they first
        met; this is made at a node once, for all leaves below. Similar sets meet first at their first common element in
        some bucket, and from there on they can't share more than the elements of the other between its first and its latest
        meeting, and those that remain to both after that. A leaf for which that is too little for every size and remaining
        length below a node is dropped for the whole subtree.
        """
        lists, family = self.holders()
        size = self.sizes[self.leaves].tolist()
        met: dict[int, tuple[int, int] | None] = {}  # by leaf: depth of the first meeting and elements that follow; None: dropped
        path: list[tuple[int, list]] = []  # (token, what was known of the leaves that it changed)
        found: list[tuple[int, int]] = []
        for i, mine in enumerate(self.lists):
            shared = 0
            while shared < len(path) and shared < len(mine) and path[shared][0] == mine[shared]:
                shared += 1
            while len(path) > shared:
                for leaf, was in path.pop()[1]:
                    if was == UNMET:
                        del met[leaf]
                    else:
                        met[leaf] = was
            while len(path) < len(mine) and (end := self.end[len(path), i]) > i + 1:
                depth = len(path)
                below = range(i, end)
                low, high, rest = min(size[k] for k in below), max(size[k] for k in below), max(self.rest[k][depth] for k in below)
                path.append((mine[depth], _meet(lists.get(mine[depth], ()), depth, end, low, high, rest, size, met)))
            depth = len(path)
            alone: list = []  # nodes with no other leaf below
            for d in range(depth, len(mine)):
                if mine[d] in lists:
                    alone += _meet(lists[mine[d]], d, i, size[i], size[i], self.rest[i][d], size, met)
            path += [(t, []) for t in mine[depth:]]
            for leaf, at in met.items():
                if at and leaf < i and _enough(1 + min(self.rest[i][at[0]], at[1]), size[leaf], size[i], size[i]):
                    found.append((self.leaves[i], self.leaves[leaf]))
            for leaf, was in reversed(alone):
                if was == UNMET:
                    del met[leaf]
                else:
                    met[leaf] = was
        return np.array(found, np.int64).reshape(-1, 2), family


#: Of a leaf that the path has not met.
UNMET = (-1, -1)


def _enough(overlap: int, size: int, low: int, high: int) -> bool:
    """Whether a set of this size can be similar to one of a size from low to high with such an overlap."""
    return overlap * (ABOVE + OF) >= ABOVE * (low + size) and OF * size >= ABOVE * low and ABOVE * size <= OF * high


def _meet(held: list[tuple[int, int]], depth: int, end: int, low: int, high: int, rest: int, size: list[int], met: dict) -> list:
    """Meet the leaves before end that hold a node's token; below it sizes are from low to high, and at most rest elements follow.

    Returns the leaves for which that changes something, with what was known of them.
    """
    changed = []
    for leaf, after in held:
        if leaf >= end:
            break
        was = met.get(leaf, UNMET)
        if was is None:
            continue
        between = was[1] - after if was != UNMET else 0
        if not _enough(between + 1 + min(rest, after), size[leaf], low, high):
            changed.append((leaf, was))
            met[leaf] = None
        elif was == UNMET:
            changed.append((leaf, was))
            met[leaf] = depth, after
    return changed


def _root(parent: dict[int, int], x: int) -> int:
    """The end of x's path, which is made shorter on the way; x is put in if it isn't there."""
    r = parent.setdefault(x, x)
    while parent[r] != r:
        parent[r] = parent[parent[r]]
        r = parent[r]
    parent[x] = r
    return r


def candidates(packed: DataFrame, buckets: int) -> DataFrame:
    """packed (bucket, sets, a, b) -> a, b, family: pairs of keys to compare in full, or (family) a set and the least of its family.

    A long list is never paired: its members are only told to be one family, a row each, and families are compared by
    compare_families(), so a large group of near copies gives as many rows as it has members.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        name = None

        def pairs() -> Iterator[pa.RecordBatch]:
            bucket = Bucket(held)
            found, family = bucket.pairs()
            for both, together in ((found, False), (np.array(sorted(family.items()), np.int64).reshape(-1, 2), True)):
                a, b = bucket.keys[both[:, 0]], bucket.keys[both[:, 1]]  # numbers go by key, so the least number has the least key
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([together] * len(a), pa.bool_())], names=["a", "b", "family"])

        for batch in batches:
            told = batch.filter(batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([told.column(2), told.column(3), pa.array([True] * len(told), pa.bool_())], names=["a", "b", "family"])
            batch = batch.filter(batch.column(1).is_valid())
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != name and held:
                    yield from pairs()
                    held = []
                name = bucket
                held.append(data)
        if held:
            yield from pairs()

    spread = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(join, "a long, b long, family boolean").distinct()


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size (1 MB) in which the cell of each key is set."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            cells[batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(np.packbits(cells).tobytes())], pa.binary())], names=["cells"])

    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in keys.coalesce(8).mapInArrow(fill, "cells binary").toLocalIterator():
        out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(row.cells), np.uint8)
    return np.unpackbits(out).astype(bool)


def full_sets(docs: DataFrame, wanted, counts) -> DataFrame:
    """docs (text) -> key, n, grams: whole sets in global order of documents whose key may be wanted, one per key.

    wanted: a broadcast variable with key_filter(). Copies within a task are left out, and one of those of all tasks stays.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cells, seen = counts.value, wanted.value, set()
        for batch in batches:
            keys, sizes, sets = [], [], []
            for _, grams in shingle_sets(batch.column(0)):
                key = set_key(grams)
                if key is None or key in seen or not cells[key & (len(cells) - 1)]:
                    continue
                seen.add(key)
                keys.append(key)
                sizes.append(len(grams))
                sets.append(grams[order_of(grams, table)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["key", "n", "grams"])

    return docs.select("text").mapInArrow(scan, "key long, n long, grams binary")


def family_links(keys: np.ndarray, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links (key, key) that make the components of a block of ordered sets; of two sides, only across if both are there.

    Sets are walked in order of their lists, as paths of a trie: overlaps with all others are kept for the current path, so
    what two sets begin with is counted once. A path is left when no other set outside its component can come near enough
    with the elements that remain, and links inside a component aren't looked for.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    edges = np.searchsorted(inverse[order], np.arange(len(tokens) + 1))
    shared = np.diff(edges) >= 2
    lists = [x[shared[x]].tolist() for x in np.split(inverse, np.cumsum(sizes)[:-1])]
    holders = owner[order]
    across = len(set(sides.tolist())) > 1
    component = np.arange(n)
    overlap = np.zeros(n, np.int64)
    path: list[int] = []
    links: list[tuple[int, int]] = []

    def leave(depth: int) -> None:
        while len(path) > depth:
            t = path.pop()
            overlap[holders[edges[t] : edges[t + 1]]] -= 1

    for i in sorted(range(n), key=lambda k: lists[k]):
        mine = lists[i]
        shared_depth = 0
        while shared_depth < len(path) and shared_depth < len(mine) and path[shared_depth] == mine[shared_depth]:
            shared_depth += 1
        leave(shared_depth)
        fits = (OF * np.minimum(sizes, sizes[i]) >= ABOVE * np.maximum(sizes, sizes[i])) & (component != component[i])
        if across:
            fits &= sides != sides[i]
        others = np.flatnonzero(fits)
        need = -(-ABOVE * (sizes[others] + sizes[i]) // (ABOVE + OF))
        left = True
        for d in range(shared_depth, len(mine)):
            if (d - shared_depth) % 16 == 0:
                near = overlap[others] + (len(mine) - d) >= need
                others, need = others[near], need[near]
                if not len(others):
                    left = False
                    break
            t = mine[d]
            path.append(t)
            overlap[holders[edges[t] : edges[t + 1]]] += 1
        if left:
            for j in others[overlap[others] >= need].tolist():
                if component[j] != component[i]:
                    component[component == component[j]] = component[i]
                    links.append((int(keys[i]), int(keys[j])))
    return links


def compare_families(members: DataFrame, docs: DataFrame, counts) -> DataFrame:
    """members (key, root) -> links (a, b) that make the components of each family.

    A family up to BLOCK_TOKENS is one block. A larger one is dealt to parts by class of size (ratio 5/4) and hash of key;
    parts of the same class and of neighbouring classes meet in pairs, others can't be similar. So a task holds two parts at
    most, and no pair of similar sets is missed.
    """
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(key_filter(members.select("key")))
    sets = store(full_sets(docs, wanted, counts).join(members, "key").dropDuplicates(["key"]), "sets")
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / ABOVE))).cast("int")
    sized = sets.withColumn("level", level)
    whole = sized.groupBy("root").agg(F.sum("n").alias("all_tokens"))
    parts = sized.groupBy("root", "level").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts"))
    near = lambda d, name: parts.select("root", (F.col("level") + d).alias("level"), F.col("parts").alias(name))
    plan = parts.join(whole, "root").join(near(1, "below"), ["root", "level"], "left").join(near(-1, "above"), ["root", "level"], "left")
    # a family can hold a third of all sets: its rows meet the plan in SALTS pieces
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(plan, ["root", "level", "salt"]).drop("salt")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda low, p, q, side: F.struct(low.alias("low"), p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<low:string,p:int,q:int,side:int>>")
    name = lambda kind, at: F.concat_ws(":", F.lit(kind), at.cast("string"))
    same = F.transform(up_to(F.col("parts")), lambda k: block(name("s", F.col("level")), F.least(k, F.col("part")), F.greatest(k, F.col("part")), 0))
    upper = F.when(F.col("above").isNull(), none).otherwise(F.transform(up_to(F.coalesce("above", F.lit(1))), lambda k: block(name("n", F.col("level")), F.col("part"), k, 0)))
    lower = F.when(F.col("below").isNull(), none).otherwise(F.transform(up_to(F.coalesce("below", F.lit(1))), lambda k: block(name("n", F.col("level") - 1), k, F.col("part"), 1)))
    small = F.array(block(F.lit("all"), F.lit(0), F.lit(0), 0))
    sized = sized.withColumn("part", part).withColumn("b", F.explode(F.when(F.col("all_tokens") <= BLOCK_TOKENS, small).otherwise(F.concat(same, upper, lower))))
    rows = sized.select("root", "b.low", "b.p", "b.q", "b.side", "key", "grams")

    def compare(table: pa.Table) -> pa.Table:
        keys, sides = table.column("key").to_numpy(), table.column("side").to_numpy()
        links = family_links(keys, [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()], sides)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": ends.min(axis=1, initial=(1 << 63) - 1) if len(ends) else ends[:, 0], "b": ends.max(axis=1, initial=-(1 << 63)) if len(ends) else ends[:, 1]})

    return rows.groupBy("root", "low", "p", "q").applyInArrow(compare, "a long, b long")


def verify(pairs: DataFrame, keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) of keys -> those whose sets, made anew from whole texts, are similar enough.

    keyed: key, doc_id of one document each. Each text is read for the pairs it is in; a pair's two texts meet in one row.
    """
    ids = keyed.select("key", F.col("doc_id").alias("id"))
    named = pairs.join(ids.select(F.col("key").alias("a"), F.col("id").alias("id_a")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("id_b")), "b")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    named = named.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    named = named.join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[int, np.ndarray]] = {}  # by column: the latest key and its set; rows of one text often follow each other
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            same = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                sets = []
                for k in (0, 1):
                    key = int(keys[k][i])
                    if k not in last or last[k][0] != key:
                        grams = next(shingle_sets(batch.column(2 + k).slice(i, 1)))[1]
                        if set_key(grams) != key:  # another row with the same id
                            break
                        last[k] = key, grams
                    sets.append(last[k][1])
                if len(sets) == 2:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    same[i] = OF * both >= ABOVE * (len(sets[0]) + len(sets[1]) - both)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(same)) for k in (0, 1)], names=["a", "b"])

    return named.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the smallest node of its component; nodes without edges are left out.

    Large-star and small-star rounds, each written to the shared folder; a hub's edges are reduced to a minimum before they
    are joined, never gathered. Rounds grow with the logarithm of the longest path.
    """
    edges = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = store(small.filter("u <> v").distinct(), "edges")
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = after


def similar_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id; one row per row of docs.

    A document's set holds the distinct 5-word shingles of its whole text, A-Z lower-cased; with fewer words, the whole
    sequence. Two documents link when 100 * intersection >= 80 * union; component_id is the smallest doc_id that links reach.
    Equal sets are one class from the start. Empty sets (null or wordless text) link with nothing. A row without doc_id can't
    name a component: it gets null and links nothing. Rows that share an id share its smallest component. An empty table
    gives no rows. Shingles are 64-bit hashes: pairs are decided on two sets, in which a false match is a matter of 1e-13.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiled = store(profile(docs), "profile")
    counts = spark.sparkContext.broadcast(total_counts(profiled))
    documents = profiled.filter("part is null").select("doc_id", "n", "key")
    named = documents.filter("key is not null and doc_id is not null")
    keyed = store(named.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "keys")
    tokens = named.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(tokens * 0.21 * 14 / BUCKET_BYTES) + 1)

    found = store(candidates(prefixes(docs.filter("doc_id is not null"), counts, buckets), buckets), "candidates")
    links = verify(found.filter("not family").select("a", "b"), keyed, docs)
    together = found.filter("family").select("a", "b")
    if not together.isEmpty():
        members = store(components(together).select(F.col("node").alias("key"), "root"), "families")
        links = links.unionByName(compare_families(members, docs.filter("doc_id is not null"), counts))
    roots = components(links)
    classes = keyed.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "root").select("key", "component_id")
    out = documents.join(classes, "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each group's smallest doc_id, with the columns of docs; rows without doc_id stay, repeats of one id go."""
    kept = similar_groups(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("of")).distinct()
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))  # so names can't clash
    named = rows.join(kept, F.col("id") == F.col("of"), "left_semi").dropDuplicates(["id"]).select("row.*")
    return named.unionByName(docs.filter("doc_id is null"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS gram
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b USING (gram) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id
"""
