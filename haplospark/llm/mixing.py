"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import store
from .shingles import WORD

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: A document's place is a 36-bit hash, read as three digits of 12 bits.
DIGITS, DIGIT_BITS = 3, 12
SALTS = 64


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def place_of(doc_id: Column) -> Column:
    """A 36-bit hash of the id; equal on every run and in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes (source, source_size) with weight, target: shares of the total by weight, none above max_repeats sizes.

    Water filling: with sources in order of cap per weight, those whose cap is below the level are capped, and the level
    is what the caps leave, by weight. One row per source goes through the window, never a row per document.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    level = level.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _boundary(histogram: DataFrame) -> DataFrame:
    """The first bucket of each source whose running sum exceeds what is left of the budget, and what is left there."""
    order = W.partitionBy("source").orderBy("bucket")
    upto = histogram.withColumn("upto", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = upto.filter((F.col("left") > 0) & (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")) & (F.col("words") > 0))
    return found.select("source", "bucket", "words", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, source, size, source_size, target, repeats, taken.

    A source with target t and size s takes each document floor(t/s) times, and those with a place below the source's
    threshold once more. Thresholds are nested: a larger budget takes all that a smaller one takes. They come from sums by
    source and bucket of 12 hash bits; only the bucket that holds the budget is split again, three times in all, and
    documents are filtered against the threshold, never sorted. The last bucket (36 bits) goes in if that brings the
    source nearer to its target, so a source misses it by half a document, or by half of those that share a place.

    Null text counts 0 words and is taken 0 words. A null source is a source of its own, the last in order. Null or
    repeated doc_id: rows with one id share a place and are taken alike. Sources without words have target 0. Empty
    tables give no rows. Other columns of docs are not read.
    """
    base = store(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), place_of(F.col("doc_id")).alias("place")), "sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    whole = F.floor(F.try_divide("target", "source_size"))
    targets = targets.withColumn("whole", F.least(F.coalesce(whole, F.lit(0)), F.lit(max_repeats)))
    targets = store(targets.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    scope, left = base, targets.select("source", "left")
    prefix = None
    for digit in range(DIGITS):
        shift = (DIGITS - 1 - digit) * DIGIT_BITS
        bucket = F.shiftright("place", shift)
        sums = scope.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        sums = sums.join(left.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        prefix = store(_boundary(sums), f"boundary{digit}")
        left = prefix.select("source", "left")
        edge = prefix.select(F.col("source").alias("of"), "bucket")
        scope = scope.join(edge, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("bucket")), "left_semi")
    threshold = prefix.select(F.col("source").alias("of"), (F.col("bucket") + (F.col("left") * 2 >= F.col("words")).cast("long")).alias("threshold"))
    plan = targets.join(threshold, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "left", "weight")
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    mixed = base.withColumn("salt", (F.col("place") % SALTS).cast("int"))
    mixed = mixed.join(plan, F.col("source").eqNullSafe(F.col("of")) & (mixed["salt"] == plan["salt"]))
    repeats = F.col("whole") + (F.col("place") < F.coalesce(F.col("threshold"), F.lit(0))).cast("long")
    repeats = F.least(repeats, F.lit(max_repeats)).cast("int")
    return mixed.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that it takes 0 times go. Columns are those of docs.

    Rows of one id in one source share a place and are taken alike; an id that stands in several sources is taken by each
    source's own plan. A row's repeats follow from its source, its place and its source's threshold, so that rows with the
    same source and id are told by both.
    """
    taken = mix_sources(docs, **options).select(F.col("doc_id").alias("of"), F.col("source").alias("from"), "repeats").filter("repeats > 0").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # names of docs can't meet those used here
    joined = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("of")) & F.col("row.source").eqNullSafe(F.col("from")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 9))::BIGINT AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 3 AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE cap::DOUBLE / weight > level), 0.0) * weight) AS target
  FROM levels),
split AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END::BIGINT AS whole FROM targets),
places AS (SELECT source, place, sum(size)::BIGINT AS words FROM base GROUP BY source, place),
running AS (
  SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM places),
edge AS (
  SELECT r.source, r.place + CASE WHEN (s.target - s.whole * s.source_size - r.upto + r.words) * 2 >= r.words THEN 1 ELSE 0 END AS threshold
  FROM running r JOIN split s ON r.source IS NOT DISTINCT FROM s.source
  WHERE r.words > 0 AND r.upto > s.target - s.whole * s.source_size AND r.upto - r.words <= s.target - s.whole * s.source_size)
SELECT b.doc_id, b.size, s.source_size, s.target,
       (b.size * (s.whole + CASE WHEN b.place < coalesce(e.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN split s ON b.source IS NOT DISTINCT FROM s.source
LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM b.source
"""
