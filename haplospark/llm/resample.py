"""Importance resampling toward a target distribution, over hashed word runs.

Documents and target texts are counted into a fixed table of buckets. A bucket's gain is the scaled logarithm of the ratio of
both shares; a document's weight is the sum of gains of its features, looked up in one array. Gumbel noise by hash of the id
turns "draw without replacement in proportion to the weights" into "take the highest scores", whose threshold is bisected by
exact counts over the stored scores, and then among the ids that tie there. Only the drawn rows are range-partitioned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, store
from .shingles import chunks

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, "42"
#: Each count job counts above this many thresholds at once, which is four steps of a bisection.
THRESHOLDS = 15
#: Words of up to so many bytes are hashed in array passes, longer ones one by one.
SHORT = 64
LAST_ID = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SCHEMA = "doc_id long, n_words long, n_features long, weight long"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 by byte, and for each length up to SHORT + 1 what so many further zero bytes make of each byte of a register."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    shift = np.zeros((SHORT + 2, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT + 2):
        shift[n] = byte[shift[n - 1] & 255] ^ (shift[n - 1] >> np.uint32(8))
    return byte, shift


_BYTE, _SHIFT = _tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC of a string, moved n bytes to the front: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out = _SHIFT[n, 0, crc & 255]
    for k in (1, 2, 3):
        out ^= _SHIFT[n, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def run_crcs(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """CRC-32 of all runs of 1 to LONGEST words of each text in text order, by length of run; and where each text's begin.

    Words are runs of digits, letters a to z (A to Z are lower-cased) and bytes beyond ASCII; a run's words are joined by a space.
    """
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _INSIDE[low]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(low))]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size, first = e - s, np.searchsorted(s, offsets)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    order = order[size[order] <= SHORT]
    at, have, left = s[order], np.full(len(order), 0xFFFFFFFF, np.uint32), size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # words with more than k bytes come first
        have[:n] = _BYTE[(have[:n] ^ low[at[:n] + k]) & 255] ^ (have[:n] >> np.uint32(8))
    crc = np.zeros(len(s), np.uint32)
    crc[order] = ~have
    long = np.flatnonzero(size > SHORT)
    words = {int(i): low[s[i] : e[i]].tobytes() for i in long}
    for i, w in words.items():
        crc[i] = zlib.crc32(w)
    tail = np.minimum(size, SHORT)
    spaced = _shifted(np.full(len(s), _SPACE), tail) ^ crc
    runs, begins = [crc], [first]
    for k in range(1, LONGEST):
        before = runs[-1][: max(len(s) - k, 0)]
        run = _shifted(before, tail[k:] + 1) ^ spaced[k:]
        for i, w in words.items():
            if i >= k:
                run[i - k] = zlib.crc32(b" " + w, int(before[i - k]))
        runs.append(run)
        begins.append(first)
    whole = []
    for k, run in enumerate(runs):
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[: len(run)]
        fits = np.arange(len(run)) + k < first[text + 1] if len(run) else np.zeros(0, bool)
        whole.append(run[fits])
        begins[k] = np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - k, 0))))
    return whole, begins


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts (text, ...) -> bucket, n: occurrences of features by crc32 modulo buckets. A task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                for run in run_crcs(data, offsets)[0]:
                    total += np.bincount(run % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: floor(1000 * ln of the target's smoothed share over that of docs)."""
    spark = docs.sparkSession
    both = bucket_counts(docs, buckets).withColumn("t", F.lit(0).cast("long")).withColumnRenamed("n", "s").select("bucket", "s", "t")
    both = both.unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = store(both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "buckets")
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return sums.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(share)).cast("long").alias("gain"))


def _weigher(gains: np.ndarray):
    def weigh(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, end, data, offsets in chunks(texts):
            runs, begins = run_crcs(data, offsets)
            words[at:end] = np.diff(begins[0])
            for run, begin in zip(runs, begins, strict=True):
                upto = np.concatenate(([0], np.cumsum(gains[run % np.uint32(len(gains))])))
                features[at:end] += np.diff(begin)
                weight[at:end] += upto[begin[1:]] - upto[begin[:-1]]
        return words, features, weight

    return weigh


def noisy_score(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """weight plus scaled Gumbel noise from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def score_documents(docs: DataFrame, target: DataFrame, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs -> doc_id, n_words, n_features, weight, score; a row per row of docs, without its texts."""
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(docs, target, buckets).collect():  # a row per bucket, whatever the input
        gains[r.bucket] = r.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = _weigher(gains)
        for batch in batches:
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in weigh(batch.column(1))]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
    return weighed.withColumn("score", noisy_score(F.col("doc_id"), F.col("weight"), seed))


def _bisect(rows: DataFrame, key: Column, need: int) -> int | None:
    """The least value v of the long key with count(key <= v) >= need, by exact count jobs; None if there are fewer rows."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if n < need or need < 1:
        return None
    low -= 1  # count(key <= low) < need <= count(key <= high)
    while high - low > 1:
        points = sorted({low + (high - low) * i // (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)} - {low, high})
        counts = rows.agg(*[F.count_if(key <= F.lit(p)) for p in points]).first()
        for p, c in zip(points, counts, strict=True):
            if c >= need:
                high = p
                break
            low = p
    return high


def find_cutoff(scored: DataFrame, draws: int) -> tuple[int, int] | None:
    """(score, id): the last of the first draws rows by score descending, id ascending; null ids come last. None draws nothing.

    scored must be a stored table: each job reads its score and id columns only.
    """
    down = _bisect(scored, -F.col("score"), draws)
    if down is None:
        return None
    above = scored.filter(F.col("score") > F.lit(-down)).count()
    last = _bisect(scored.filter(F.col("score") == F.lit(-down)), _id(), draws - above)
    return -down, last


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(LAST_ID))


def _drawn(cutoff: tuple[int, int], least_words: int) -> Column:
    score, last = cutoff
    return (F.col("n_words") >= least_words) & ((F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & (_id() <= F.lit(last))))


def ranked_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text, ...), target (text, ...) -> doc_id, n_words, n_features, weight, score, rank; a row per row of docs.

    Of the N rows with at least least_words words, N * percent // 100 are drawn: those with the highest scores, ties to the
    smaller id. rank counts them from 1 in that order and is null for all others.

    Null text has no words, weight 0 and is never drawn while least_words is above 0. A null doc_id is hashed as the text
    "null" and comes last among ties. Repeated ids are rows of their own with the same noise; where two of them tie at the end
    of the draw, those with fewer features go first. Empty docs give no rows; without target texts all targets' counts are 0.
    Other columns aren't read.
    """
    scored = store(score_documents(docs, target, seed, buckets), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    draws = able.count() * percent // 100
    cutoff = find_cutoff(able, draws)
    unranked = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select("*", unranked)
    order = [F.desc("score"), _id().asc(), F.asc("n_features")]
    drawn = scored.filter(_drawn(cutoff, least_words)).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = store(drawn.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part, slot = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rank = F.col("before") + slot + 1
    ranked = placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= draws, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~_drawn(cutoff, least_words)).select("*", unranked))


def draw_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The drawn rows of docs, with all their columns. Of repeated ids that tie at the end of the draw all are kept.

    Texts aren't shuffled or joined: a second pass weighs them again and compares with the cutoff.
    """
    spark = docs.sparkSession
    gains = store(bucket_gains(docs, target, buckets), "gains")
    table = np.zeros(buckets, np.int64)
    for r in gains.collect():
        table[r.bucket] = r.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = _weigher(table)
        for batch in batches:
            extra = [pa.array(x, pa.int64()) for x in weigh(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *extra], ["row", "doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = rows.select("row", "doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    weighed = rows.mapInArrow(run, schema).withColumn("score", noisy_score(F.col("doc_id"), F.col("weight"), seed))
    able = store(weighed.drop("row").filter(F.col("n_words") >= least_words), "scores")
    cutoff = find_cutoff(able, able.count() * percent // 100)
    if cutoff is None:
        return spark.createDataFrame([], docs.schema)
    return weighed.filter(_drawn(cutoff, least_words)).select("row.*")
