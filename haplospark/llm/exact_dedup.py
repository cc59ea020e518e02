"""Exact deduplication by a content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, store

#: Fewer rows than this never make a text hot.
HOT_ROWS = 256
#: Splitters are sampled on so many characters and a hash: whole texts stay where they are.
SPLITTER_CHARS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256; one row per row of docs.

    Texts are equal when identical after all ASCII white space is deleted. Sampled splitters deal the normalised texts
    into ranges of their first characters and a hash, Spark's external sort puts equals next to each other, and neighbours
    are compared in full (the window's key ends with the text itself). Of equals the row with the most code points in its original text stays, then the smallest
    doc_id.

    A text that holds more than 1/(4 * partitions) of the rows would overfill its range. Counts of 64-bit hashes find
    such texts (by that bound at most 4 * partitions of them, so the list is broadcast); each is sorted in salted runs, and
    one row per run is merged by SHA-256.

    Null text is empty text. A null doc_id stays only if all of its group are null; of rows with equal text and id each is
    marked kept, as ids tell rows apart. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    hot = rows.groupBy("h").count().filter(F.col("count") > max(docs.count() // n, HOT_ROWS)).select("h", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "h", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "chars"), F.lit(n))).otherwise(0))
    rows = rows.withColumn("start", F.substring("norm", 1, SPLITTER_CHARS))
    run = W.partitionBy("start", "h", "salt", "norm")
    best = run.orderBy(F.desc("chars"), F.col("doc_id").asc_nulls_last())
    runs = rows.repartitionByRange("start", "h", "salt").select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.first("doc_id").over(best).alias("keep_id"),
        F.first("chars").over(best).alias("keep_chars"),
        F.row_number().over(best).alias("at"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        F.coalesce("hot", F.lit(False)).alias("hot"),
    )
    runs = store(runs, "runs")
    heads = runs.filter("hot and at = 1")
    merged = heads.groupBy("text_sha256").agg(
        F.min_by("keep_id", F.struct(-F.col("keep_chars"), F.col("keep_id").isNull(), "keep_id")).alias("hot_keep"),
        F.sum("group_size").alias("hot_size"),
    )
    out = runs.join(F.broadcast(merged), "text_sha256", "left")
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(F.col("keep_id"))
    out = out.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("hot_size", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
