"""Benchmark decontamination: SimHash windows of item size, multi-index Hamming search, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import SHINGLE, THRESHOLD, chunks, shingle_hashes, word_hashes

#: Fingerprints of 64 bits within RADIUS are all found: in one of 4 blocks of 16 bits they differ by RADIUS // 4 at most.
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
#: Items go to tasks in sets of about so many bytes, one pass over the documents each; larger benchmarks take more passes.
ITEM_BYTES = 32 << 20
_CELLS = 20


def fingerprints(grams: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of width shingle hashes; a repeated shingle counts as often as it occurs."""
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    upto = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=upto[1:])
    return np.packbits(upto[width:] - upto[:-width] > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; a shingle weighs as often as it occurs."""
    both = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return both / (a.total() + b.total() - both) if both else 0.0


class Items:
    """Benchmark items as fingerprints in a multi-index, with their shingles for verification."""

    def __init__(self, ids: list[int | None], texts: list[str | None], radius: int = RADIUS, threshold: float = THRESHOLD):
        self.radius, self.threshold = radius, threshold
        masks = [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), k)]
        self.near = np.array(masks, np.int64)
        self.ids, self.words, self.grams, prints = [], [], [], []
        for at, end, data, offsets in chunks(pa.array(texts, pa.string())):
            hashes, first = word_hashes(data, offsets)
            grams, begin = shingle_hashes(hashes, first)
            for i in range(end - at):
                own = grams[begin[i] : begin[i + 1]]
                if len(own):
                    self.ids.append(ids[at + i])
                    self.words.append(int(first[i + 1] - first[i]))
                    self.grams.append(Counter(own.tolist()))
                    prints.append(fingerprints(own, len(own))[0])
        self.prints, self.words = np.array(prints, np.uint64), np.array(self.words, np.int64)
        self.index = []
        for k in range(BLOCKS):
            block = ((self.prints >> np.uint64(k * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            self.index.append((np.searchsorted(block[order], np.arange((1 << BLOCK_BITS) + 1)), order))
        #: by number of words: its shingles, sorted, and a table that rules most others out
        self.known: dict[int, np.ndarray] = {}
        for n in set(self.words.tolist()):
            self.known[n] = np.unique(np.array([g for i in np.flatnonzero(self.words == n) for g in self.grams[i]], np.uint64))
        self.cells = np.zeros((SHINGLE, 1 << _CELLS), bool)
        for n, known in self.known.items():
            self.cells[min(n, SHINGLE) - 1, (known >> np.uint64(64 - _CELLS)).astype(np.int64)] = True

    def within(self, fingerprint: np.uint64) -> np.ndarray:
        """Numbers of all items whose fingerprint differs in at most radius bits."""
        found = []
        for k, (offsets, order) in enumerate(self.index):
            values = int(fingerprint >> np.uint64(k * BLOCK_BITS)) & ((1 << BLOCK_BITS) - 1) ^ self.near
            for v in values[offsets[values + 1] > offsets[values]]:
                found.append(order[offsets[v] : offsets[v + 1]])
        if not found:
            return np.zeros(0, np.int64)
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ fingerprint) <= self.radius]

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item number, similarity, first word, words) of the best window for each row and item at the threshold or above."""
        if not len(self.words):
            return
        for at, end, data, offsets in chunks(texts):
            hashes, first = word_hashes(data, offsets)
            for width in sorted({min(n, SHINGLE) for n in self.known}):
                grams, begin = shingle_hashes(hashes, first, width)
                maybe = np.flatnonzero(self.cells[width - 1][(grams >> np.uint64(64 - _CELLS)).astype(np.int64)])
                if not len(maybe):
                    continue
                for n, known in self.known.items():
                    if min(n, SHINGLE) != width:
                        continue
                    place = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
                    hits = maybe[known[place] == grams[maybe]]
                    row = np.searchsorted(begin, hits, side="right") - 1
                    rows, count = np.unique(row, return_counts=True)
                    for r in rows[count >= np.ceil(self._least(n - width + 1, np.diff(begin)[rows]))].tolist():
                        for item, (similar, start, words) in self._windows(grams[begin[r] : begin[r + 1]], hits[row == r] - begin[r], n, width).items():
                            yield at + r, item, similar, start, words

    def _least(self, own, other):
        """The overlap of two bags of shingles that are just similar enough, at the least: windows are no larger than items."""
        return self.threshold / (1 + self.threshold) * (own + np.minimum(own, other)) - 1e-9

    def _windows(self, grams: np.ndarray, hits: np.ndarray, n: int, width: int) -> dict[int, tuple[float, int, int]]:
        """The best windows of one text against items of n words. A text with fewer words is one window.

        Only windows with enough shingles that some item of this size has are fingerprinted: others can't be similar.
        """
        size = min(n - width + 1, len(grams))
        upto = np.zeros(len(grams) + 1, np.int64)
        np.add.at(upto, hits + 1, 1)
        upto = np.cumsum(upto)
        starts = np.flatnonzero(upto[size:] - upto[:-size] >= self._least(n - width + 1, size))
        best: dict[int, tuple[float, int, int]] = {}
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
            part = grams[run[0] : run[-1] + size]
            for start, fingerprint in zip(run.tolist(), fingerprints(part, size), strict=True):
                near = [i for i in self.within(fingerprint).tolist() if self.words[i] == n]
                if near:
                    bag = Counter(grams[start : start + size].tolist())
                    for i in near:
                        s = similarity(bag, self.grams[i])
                        if s >= self.threshold and (i not in best or s > best[i][0]):
                            best[i] = s, start, size + width - 1
        return best


def _item_sets(benchmark: DataFrame, **options) -> list:
    """Broadcast variables with Items; each holds about ITEM_BYTES of text at most."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = []
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id").collect()
        out.append(sc.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], **options)))
    return out


LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text) -> a row per document and item that it contains.

    similarity, first_word and n_words are those of the best window, the first of equals. Windows have as many words as the
    item and begin at every word; a shorter document is one window. Windows and items are compared as bags of 5-word
    shingles (a shorter item is its whole sequence), at a weighted Jaccard similarity of 0.8 or more. Candidates are all
    items within RADIUS bits of a window's fingerprint: no item that near is missed. At similarity 0.8 fingerprints differ
    by 10 bits on average, with a deviation of 3.

    Null or wordless texts and items match nothing. Repeated documents and items are each reported. Empty tables give no
    rows. Texts are read whole, each row on its own: no shuffle, and documents of any number.
    """

    def scan(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = items.value
            for batch in batches:
                found = list(own.leaks(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([own.ids[f[1]] for f in found], pa.int64()), *(pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [rows.mapInArrow(scan(items), LEAKS) for items in _item_sets(benchmark, **options)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that contain no benchmark item, with the columns of docs; rows are judged as they stream by."""
    text = docs.columns.index("text")

    def keep(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                for row, *_ in items.value.leaks(batch.column(text)):
                    mask[row] = False
                yield batch.filter(pa.array(mask))

        return run

    for items in _item_sets(benchmark, **options):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs
