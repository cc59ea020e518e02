"""Sharding by a minimax contiguous partition of atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, store

SHARDS = 16
#: Groups of equal texts are put in order by a hash of the text; its top bits make at most 2**16 atoms.
ATOM_BITS = 16


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which cutting the ordered sizes greedily needs at most that many shards."""
    upto = np.cumsum(sizes, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    low, high = max(int(sizes.max(initial=0)), -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(upto, middle)) <= shards - 1:
            high = middle
        else:
            low = middle + 1
    return low


def greedy_cuts(upto: np.ndarray, capacity: int) -> list[int]:
    """Positions at which a new shard begins when each takes as many atoms as fit; upto: running sums of the sizes."""
    cuts, done = [], 0
    while True:
        at = int(np.searchsorted(upto, done + capacity, side="right"))
        if at >= len(upto):
            return cuts
        cuts.append(at)
        done = int(upto[at - 1]) if at else 0
        if len(cuts) > 1 and cuts[-1] == cuts[-2]:
            raise ValueError("an atom is larger than the capacity")


def level_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Cuts for the smallest capacity, moved back to an even share of what is left wherever the rest still fits."""
    capacity = smallest_capacity(sizes, shards)
    upto = np.cumsum(sizes, dtype=np.int64)
    cuts, start, done = [], 0, 0
    for left in range(shards, 1, -1):
        furthest = int(np.searchsorted(upto, done + capacity, side="right"))
        if furthest >= len(upto):
            furthest = len(upto)
        even = int(np.searchsorted(upto, done + (int(upto[-1]) - done) / left, side="right"))
        for at in (min(max(even, start + 1), furthest), furthest):
            before = int(upto[at - 1])
            if at == furthest or len(greedy_cuts(upto[at:] - before, capacity)) <= left - 2:
                break
        if at >= len(upto):
            break
        cuts.append(at)
        start, done = at, before
    return cuts


def plan_shards(atoms: np.ndarray, sizes: np.ndarray, shards: int) -> tuple[list[int], list[int]]:
    """(atoms that get a shard of their own, atom numbers at which the other shards begin).

    An atom above the mean of what is left can't be levelled by cuts; it gets a shard alone (the last numbers), and the
    smallest capacity is searched for the rest, which keeps the rest even.
    """
    alone: list[int] = []
    rest = np.ones(len(sizes), bool)
    while len(alone) < shards - 1 and rest.any():
        top = int(np.argmax(np.where(rest, sizes, -1)))
        if rest.sum() == 1 or sizes[top] * (shards - len(alone)) <= sizes[rest].sum():
            break
        alone.append(int(atoms[top]))
        rest[top] = False
    cuts = level_cuts(sizes[rest], shards - len(alone)) if rest.any() else []
    return alone, [int(atoms[rest][i]) for i in cuts]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards hold about equal bytes and rows with equal text share a shard. Groups are ordered by a hash of
    their text; sums over its top 16 bits (65,536 longs at most, whatever the input) are all that reaches the driver, where
    a binary search with a greedy check finds the smallest shard capacity. Shards are runs of atoms, so a document's shard
    is a comparison with at most 15 cuts. An atom larger than an even share (a huge group of copies) has a shard alone.

    Slots are dealt per atom: counts give each atom its first slot, and rows are numbered inside atoms. Atoms with many
    rows are numbered in salted pieces, so no task numbers a shard as a whole.

    size is the text's UTF-8 bytes plus 1, null text counts as empty; grown_shard is null under this law. Repeated rows and
    null or repeated ids are kept, each with a slot of its own. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = store(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
        ).withColumn("atom", F.shiftrightunsigned("h", 64 - ATOM_BITS).cast("int")),
        "sizes",
    )
    found = base.groupBy("atom").agg(F.sum("size"), F.count(F.lit(1))).orderBy("atom").collect()
    atoms, sizes, rows = (np.array([r[i] for r in found], np.int64) for i in range(3))
    alone, cuts = plan_shards(atoms, sizes, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("atom") >= cut).cast("int")
    for k, atom in enumerate(alone):
        shard = F.when(F.col("atom") == atom, shards - 1 - k).otherwise(shard)
    pieces = 4 * partitions(docs.sparkSession)
    many = [int(a) for a, n in zip(atoms, rows, strict=True) if n > max(rows.sum() // pieces, 1000)]
    piece = F.when(F.col("atom").isin(many), F.pmod(F.xxhash64("doc_id", "size"), F.lit(pieces))).otherwise(0) if many else F.lit(0)
    placed = base.withColumn("shard", shard.cast("int")).withColumn("piece", piece.cast("int"))
    first = placed.groupBy("shard", "atom", "piece").agg(F.count(F.lit(1)).alias("n"))
    first = first.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("atom", "piece")) - F.col("n"))
    placed = placed.join(first.select("atom", "piece", "first"), ["atom", "piece"])
    slot = F.col("first") + F.row_number().over(W.partitionBy("atom", "piece").orderBy("h", "doc_id", "size")) - 1
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
