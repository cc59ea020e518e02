"""Bottom sketches of canonical k-mers, merged from partial ones, and near pairs of sketches without comparing all pairs.

A k-mer of up to 31 bases is a number of two bits per base; its hash is a bijection of the lesser of it and its reverse
complement, so that no two k-mers share one. Tasks keep the least hashes of each key and send them off packed; partial
sketches meet some at a time, so that neither a k-mer nor a sample's k-mers are ever rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

K, SIZE = 31, 100_000
#: Hashes that a task holds before it sends its partial sketches off, and partial sketches that meet in one merge, about.
HELD_HASHES, FAN = 1 << 22, 8
#: Sketches that hold one hash are compared in blocks of about so many.
HOT = 256
#: Sketches that one is compared with in one place, about.
PARTNERS = 256
#: Hashes that are told to all tasks as common, of those that so many sketches have at least, and the size of a bucket of places, about.
MOST_COMMON, COMMON, BUCKET_BYTES = 1 << 20, 8, 16 << 20
FACTOR = 0x9FB21C651E98DF25

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[[ord(_b), ord(_b.lower())]] = _i


def kmer_hashes(codes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Where k-mers without other letters than ACGT begin in an array of base codes, and the hashes of their canonical forms."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    bases = (codes & 3).astype(np.uint64)
    # numbers of 1, 2, 4... bases from every place, joined to those of k
    forward, backward, length = bases, np.uint64(3) - bases, 1
    whole = None
    while True:
        if k & length:
            if whole is None:
                whole = forward, backward, length
            else:
                f, b, l = whole  # noqa: E741
                m = len(codes) - l - length + 1
                whole = (f[:m] << np.uint64(2 * length)) | forward[l : l + m], b[:m] | (backward[l : l + m] << np.uint64(2 * l)), l + length
        if 2 * length > k:
            break
        m = len(codes) - 2 * length + 1
        forward, backward = (forward[:m] << np.uint64(2 * length)) | forward[length : length + m], backward[:m] | (backward[length : length + m] << np.uint64(2 * length))
        length *= 2
    x = np.minimum(whole[0], whole[1])[at]
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(FACTOR)
    return at, x ^ (x >> np.uint64(29))


def _packed(keys: list, sketches: list[np.ndarray], kind: pa.DataType, start: int) -> pa.RecordBatch:
    task = TaskContext.get()
    pieces = [f"{task.partitionId() if task else 0}:{start + i}" for i in range(len(keys))]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(pieces, pa.string()), pa.array([x.tobytes() for x in sketches], pa.binary())], ["key", "piece", "hashes"])


def partial_sketches(records: DataFrame, key: str, text: str, k: int = K, size: int = SIZE) -> DataFrame:
    """records -> key, piece, hashes: for each key that a task meets, its least hashes there, ascending, packed."""
    own = records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key's sketch, what is to be merged into it, and how much that is: sorted anew only when as much has come as a sketch holds
        held: dict = {}
        total = sent = 0

        def merged(key_) -> np.ndarray:
            nonlocal total
            own_, new, n = held[key_]
            if new:
                out = np.unique(np.concatenate((own_, *new)))[:size]
                total += len(out) - len(own_) - n
                held[key_] = [out, [], 0]
            return held[key_][0]

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key_, text_ in zip(keys, batch.column(1).to_pylist(), strict=True):
                _, hashes = kmer_hashes(_CODE[np.frombuffer((text_ or "").encode(), np.uint8)], k)
                if not len(hashes):
                    continue
                mine = held.setdefault(key_, [np.zeros(0, np.uint64), [], 0])
                if len(mine[0]) == size:
                    hashes = hashes[hashes < mine[0][-1]]
                mine[1].append(hashes)
                mine[2] += len(hashes)
                total += len(hashes)
                if mine[2] >= size:
                    merged(key_)
                if total > HELD_HASHES:
                    for x in list(held):
                        merged(x)
                    yield _packed(list(held), [x[0] for x in held.values()], batch.column(0).type, sent)
                    sent += len(held)
                    held, total = {}, 0
            kind = batch.column(0).type
        for x in list(held):
            merged(x)
        if held:
            yield _packed(list(held), [x[0] for x in held.values()], kind, sent)

    return own.mapInArrow(scan, f"key {own.schema['key'].dataType.simpleString()}, piece string, hashes binary")


def merge_sketches(partials: DataFrame, size: int = SIZE) -> DataFrame:
    """key, piece, hashes with any number of rows per key -> one row per key, by rounds of merges of about FAN sketches.

    The size least hashes of a union are among the size least of each side: the order of merging makes no difference.
    """

    def merge(own: tuple, part: pa.Table) -> pa.Table:
        out = np.zeros(0, np.uint64)
        for b in part.column("hashes").to_pylist():
            out = np.unique(np.concatenate((out, np.frombuffer(b, np.uint64))))[:size]
        return pa.table({"key": part.column("key").slice(0, 1), "piece": part.column("piece").slice(0, 1), "hashes": pa.array([out.tobytes()], pa.binary())})

    partials = cut(partials)
    while True:
        most = partials.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        if most == 1:
            return partials.select("key", "hashes")
        bucket = F.pmod(F.xxhash64("piece"), F.lit(-(-most // FAN))).alias("bucket")
        partials = cut(partials.groupBy("key", bucket).applyInArrow(merge, partials.schema))


def bottom_sketches(records: DataFrame, key: str, text: str, k: int = K, size: int = SIZE) -> DataFrame:
    """records (a key may have many) -> key, hashes: each key's size least hashes of canonical k-mers, ascending, packed.

    Null and short texts, and k-mers with other letters, add nothing; a key without k-mers has no row.
    """
    return merge_sketches(partial_sketches(records, key, text, k, size), size)


def sketch_hashes(sketches: DataFrame) -> DataFrame:
    """key, place (from 0), hash as a long of the same bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(h), np.int64))), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], ["key", "place", "hash"])

    return sketches.select("key", "hashes").mapInArrow(spread, f"key {sketches.schema['key'].dataType.simpleString()}, place int, hash long")


def least_jaccard(cutoff: float, k: int) -> float:
    """The Jaccard similarity at which the Mash distance -ln(2j / (1 + j)) / k is the cutoff."""
    x = math.exp(-cutoff * k)
    return x / (2 - x)


def common_hashes(sketches: DataFrame, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The commonest hashes, ascending, and about how many sketches have them: at most ``most``, whatever the input.

    Tasks count what they hold and send on what they hold twice. This only orders hashes: any order gives the same pairs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], ["hash", "n"])

        for batch in batches:
            for b in batch.column(0):
                held.append(np.frombuffer(b.as_py(), np.int64))
                total += len(held[-1])
                if total > HELD_HASHES:
                    yield counted()
                    held, total = [], 0
        if held:
            yield counted()

    counts = sketches.select("hashes").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "hash").limit(most).toArrow()
    h, n = found.column("hash").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_entries(sketches: DataFrame, jaccard: float) -> DataFrame:
    """key, size, hash, i: of the first n - ceil(jaccard * n) + 1 of each sketch's n hashes, common ones last, those that others have there.

    Places are packed by bucket of the hash and shuffled once; what one sketch alone has ends in its bucket.
    """
    spark = sketches.sparkSession
    told = spark.sparkContext.broadcast(common_hashes(sketches))
    total = sketches.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    buckets = max(64, int(total * (1 - jaccard) * 2 / BUCKET_BYTES) + 1)
    kind = sketches.schema["key"].dataType

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = told.value
        keys, sizes, hashes, places, total = [], [], [], [], 0

        def packed() -> pa.RecordBatch:
            h, i = np.concatenate(hashes), np.concatenate(places)
            own = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) for x in hashes])
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h, bucket))
            names, begin = np.unique(bucket[order], return_index=True)
            columns: list[list] = [[], [], [], []]
            for rows in np.split(order, begin[1:]):
                mine, at = np.unique(own[rows], return_inverse=True)
                columns[0].append([keys[k] for k in mine])
                columns[1].append([sizes[k] for k in mine])
                columns[2].append(h[rows].tobytes())
                columns[3].append(zlib.compress(np.concatenate([at.astype(np.uint32), i[rows].astype(np.uint32)]).view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            kinds = (pa.list_(batch.column(0).type), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["bucket", "keys", "sizes", "hashes", "places"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(data, np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.lexsort((h, np.where(known[at] == h, df[at], 0)))]
                h = h[: len(h) - math.ceil(jaccard * len(h) - 1e-9) + 1]
                keys.append(key)
                sizes.append(len(data) // 8)
                hashes.append(h)
                places.append(np.arange(len(h)))
                total += len(h)
                if total > HELD_HASHES:
                    yield packed()
                    keys, sizes, hashes, places, total = [], [], [], [], 0
        if keys:
            yield packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def shared() -> pa.RecordBatch:
            keys = pa.concat_arrays([x[0] for x in held])
            starts = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            sizes, h = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            pairs = [np.frombuffer(zlib.decompress(x[3]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().reshape(2, -1) for x in held]
            own = np.concatenate([p[0].astype(np.int64) + n for p, n in zip(pairs, starts.tolist(), strict=True)])
            i = np.concatenate([p[1] for p in pairs]).astype(np.int32)
            _, at, n = np.unique(h, return_inverse=True, return_counts=True)
            use = n[at] > 1
            return pa.RecordBatch.from_arrays([keys.take(pa.array(own[use])), pa.array(sizes[own[use]]), pa.array(h[use].view(np.int64)), pa.array(i[use])], ["key", "size", "hash", "i"])

        for batch in batches:
            for r in range(batch.num_rows):
                bucket = batch.column(0)[r].as_py()
                if bucket != name and held:
                    yield shared()
                    held = []
                name = bucket
                held.append((batch.column(1)[r].values, batch.column(2)[r].values.to_numpy(), np.frombuffer(batch.column(3)[r].as_py(), np.uint64), batch.column(4)[r].as_py()))
        if held:
            yield shared()

    key = kind.simpleString()
    dealt = sketches.select("key", "hashes").mapInArrow(deal, f"bucket int, keys array<{key}>, sizes array<int>, hashes binary, places binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, f"key {key}, size int, hash long, i int")


def candidate_pairs(sketches: DataFrame, jaccard: float, copies: DataFrame) -> DataFrame:
    """key_1 < key_2 of all pairs of sketches that may share so much of the least hashes of their union, and few others.

    Pairs with the keys of ``copies`` (key) are left out; they go where rows are narrow, so that no sketch is shuffled for it.

    Two such sketches share a hash among the first n - ceil(jaccard * n) + 1 of n of each, in any global order: here common
    hashes last. Each such place knows the one before it of those that others have too. Where both sketches of a pair have the
    same one before, the pair is met there already, so runs of equal hashes make one row. A hash that many have is met in blocks.
    """
    met = cut(prefix_entries(sketches, jaccard).join(copies, "key", "left_anti"))
    df = met.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = met.join(df, "hash", "left_semi")
    shared = met.groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("met"))
    entries = shared.select("key", "size", F.posexplode("met").alias("at", "e"), "met").select(
        "key", "size", F.col("e.i").alias("i"), F.col("e.hash").alias("hash"), F.when(F.col("at") > 0, F.get("met", F.col("at") - 1)["hash"]).alias("before")
    )
    entries = cut(entries.join(df, "hash"))
    blocks = F.ceil(F.col("df") / HOT).cast("int")
    every = entries.withColumns({"own": F.pmod(F.xxhash64("key"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    side = lambda n, a, b: every.select("hash", F.col(a).alias("b1"), F.col(b).alias("b2"), *[F.col(c).alias(f"{c}_{n}") for c in ("key", "before", "size", "i")])
    both = side(1, "own", "other").join(side(2, "other", "own"), ["hash", "b1", "b2"]).filter("key_1 < key_2 and not (before_1 <=> before_2 and before_1 is not null)")
    # what can still be shared from the first hash in common on; shared hashes are in both
    left = F.least(F.col("size_1") - F.col("i_1"), F.col("size_2") - F.col("i_2"))
    return both.filter(left >= F.lit(jaccard) * F.greatest("size_1", "size_2") - 1e-9).select("key_1", "key_2").distinct()


def near_sketches(sketches: DataFrame, cutoff: float, k: int = K, size: int = SIZE) -> DataFrame:
    """key_1, key_2, shared, jaccard, distance of all pairs of sketches (key, hashes) whose Mash distance is at most the cutoff.

    shared counts what both have of the size least hashes of both. Equal sketches are one node of the search and take part as
    all their keys; pairs are compared where their sketches meet, one pair at a time. Sketches are read four times and not
    written again: they should come from a table, as ``bottom_sketches`` gives them.
    """
    jaccard = least_jaccard(cutoff, k)
    named = cut(sketches.select("key", F.sha2("hashes", 256).alias("name"), (F.octet_length("hashes") / 8).cast("long").alias("size")))
    nodes = cut(named.groupBy("name").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size")))
    copies = named.join(nodes.select("name", F.col("key").alias("first")), "name").filter("key > first").select("key")
    pairs = cut(candidate_pairs(sketches, jaccard, copies))
    # a sketch is read once for all pairs that it is in, and sent once to each PARTNERS of those that come after it
    chunks = pairs.groupBy("key_1").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("chunks"))
    dealt = pairs.join(chunks, "key_1").select("key_1", "key_2", F.pmod(F.xxhash64("key_2"), F.col("chunks")).alias("chunk"))
    asked = dealt.select("key_1", "chunk", F.lit(0).alias("side"), F.col("key_1").alias("key")).distinct().unionByName(dealt.select("key_1", "chunk", F.lit(1).alias("side"), F.col("key_2").alias("key")))
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("key_1", F.col("key").alias("key_2"), "side", "chunk")).alias("x"))
    sides = sketches.join(asked, "key").select(F.explode("x").alias("x"), "hashes").select("x.key_1", "x.key_2", "x.side", "hashes", "x.chunk")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(0, np.uint64)
        for batch in batches:
            rows, shared, union = [], [], []
            for i, (side, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = np.frombuffer(data, np.uint64)
                if side:
                    u = np.union1d(before, own)[:size]
                    common = np.intersect1d(before, own, assume_unique=True)
                    rows.append(i)
                    shared.append(int(np.searchsorted(common, u[-1], side="right")) if len(u) else 0)
                    union.append(len(u))
                else:
                    before = own
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["key_1", "key_2", "shared", "total"])

    kind = nodes.schema["key"].dataType.simpleString()
    met = sides.repartition("key_1", "chunk").sortWithinPartitions("key_1", "chunk", "side", "key_2")
    near = met.mapInArrow(compare, f"key_1 {kind}, key_2 {kind}, shared long, total long")
    near = near.unionByName(nodes.filter("n > 1").select(F.col("key").alias("key_1"), F.col("key").alias("key_2"), F.col("size").alias("shared"), F.col("size").alias("total")))
    j = F.col("shared") / F.col("total")
    near = near.withColumn("jaccard", j).withColumn("distance", F.when(F.col("shared") > 0, -F.log(2 * j / (1 + j)) / k + 0.0)).filter(F.col("distance") <= cutoff)
    of = nodes.select(F.col("key").alias("node"), "name").join(named.select("name", "key"), "name").select("node", "key")
    near = near.withColumnsRenamed({"key_1": "n1", "key_2": "n2"}).join(of.withColumnsRenamed({"node": "n1", "key": "a"}), "n1").join(of.withColumnsRenamed({"node": "n2", "key": "b"}), "n2")
    near = near.filter("(n1 <> n2) or (a < b)")
    return near.select(F.least("a", "b").alias("key_1"), F.greatest("a", "b").alias("key_2"), "shared", "jaccard", "distance")
