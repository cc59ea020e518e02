"""Ranks, running values and order statistics of groups of any size: sorted by range of values, with carries between ranges.

A window over a whole group sorts it in one task. Here rows are dealt by range of (group, value), each range is numbered on its
own, and what the ranges before it hold is added; ranges are as many as Spark's shuffle has partitions, however few the groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import finite
from .lineage import cut

#: Buckets into which a level of a selection divides each group's range of values.
BUCKETS = 1024


def spread_number(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """rows with _n, each row's place from 1 in its group by ascending value (nulls first; equal ones in any order), and _size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # many equal values may lie in several ranges
    dealt = tied.repartitionByRange(parts, *by, value, "_tie").withColumn("_part", F.spark_partition_id())
    placed = cut(dealt)
    inner = F.row_number().over(W.partitionBy("_part", *by).orderBy(value, "_tie"))
    sizes = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"))  # a row per range and group
    order = W.partitionBy(*by).orderBy("_part")
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carries = sizes.withColumn("_before", before).withColumn("_size", F.sum("_rows").over(W.partitionBy(*by))).drop("_rows")
    same = [F.col(f"_c.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in ("_part", *by)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    numbered = placed.withColumn("_inner", inner).alias("_r").join(carries.alias("_c"), condition)
    return numbered.select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns], (F.col("_inner") + F.col("_before")).alias("_n"), F.col("_size").alias("_size"))


def spread_average_rank(rows: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """rows with out: the rank of value in its group, equal values sharing the mean of theirs."""
    numbered = cut(spread_number(rows, value, *by))
    ties = numbered.groupBy(*by, value).agg(((F.min("_n") + F.max("_n")) / 2.0).alias(out))
    same = F.lit(True)
    for c in (*by, value):
        same = same & F.col(f"_r.{c}").eqNullSafe(F.col(f"_t.{c}"))
    return numbered.alias("_r").join(ties.alias("_t"), same).select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns], F.col(f"_t.{out}").alias(out))


def spread_bh_adjust(tests: DataFrame, p: str, *by: str) -> DataFrame:
    """tests with q: Benjamini-Hochberg within by, as columns.bh_adjust. The running minimum from the largest p down is taken
    per distinct p within each range, and with the least of all ranges above."""
    numbered = spread_number(tests, p, *by)
    raw = numbered.withColumn("_raw", F.col(p) * F.col("_size") / F.col("_n"))
    steps = raw.groupBy(*by, p).agg(F.min("_raw").alias("_raw"))  # equal p have one q: the least of theirs and of those above
    parts = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(steps.repartitionByRange(parts, *by, p).withColumn("_part", F.spark_partition_id()))
    inner = F.min("_raw").over(W.partitionBy("_part", *by).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, W.currentRow))
    least = placed.groupBy("_part", *by).agg(F.min("_raw").alias("_least"))
    above = F.min("_least").over(W.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1))
    carries = least.withColumn("_above", above).drop("_least")
    key = ["_part", *by]
    q = placed.withColumn("_inner", inner).join(carries, key).select(*by, p, F.least(F.lit(1.0), F.least("_inner", "_above")).alias("q"))
    return tests.join(q, [*by, p])


def spread_ecdf(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by..., value, fraction: the k-th of a group's n values at k / n, as columns.ecdf."""
    return spread_number(rows.filter(F.col(value).isNotNull()).select(*by, value), value, *by).select(*by, value, (F.col("_n") / F.col("_size")).alias("fraction"))


def select_order_statistics(rows: DataFrame, value: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """by..., and a column per fraction q: a group's finite values in order, that at int(q * (n - 1)).

    Nested histograms: each level divides a group's range of values into BUCKETS, counts the rows of each, and goes on with
    the bucket that holds the rank, until its least and largest value are equal. Only sums by bucket leave a task.
    """
    own = cut(rows.select(*by, (finite(F.col(value).cast("double")) + 0.0).alias("v")).filter("v is not null"))
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("stat"), F.lit(q).alias("q")) for name, q in fractions.items()]))
    goals = sizes.withColumn("s", named).select(*by, "s.stat", F.floor(F.col("s.q") * (F.col("n") - 1)).cast("long").alias("rank"), "low", "high")
    goals, found = cut(goals), None
    while True:
        done = goals.filter("low = high").select(*by, "stat", F.col("low").alias("v"))
        found = done if found is None else found.unionByName(done)
        goals = goals.filter("low < high")
        if goals.isEmpty():
            break
        step = (F.col("high") - F.col("low")) / BUCKETS
        bucket = F.when(step > 0, F.least(F.floor((F.col("v") - F.col("low")) / step), F.lit(BUCKETS - 1))).otherwise(F.when(F.col("v") > F.col("low"), 1).otherwise(0)).cast("int")
        same = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
        for c in by:
            same = same & F.col(f"_o.{c}").eqNullSafe(F.col(f"_g.{c}"))
        inside = own.alias("_o").join(goals.alias("_g"), same)
        inside = inside.select(*[F.col(f"_g.{c}").alias(c) for c in by], "stat", "rank", bucket.alias("bucket"), "v")
        counts = inside.groupBy(*by, "stat", "rank", "bucket").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("k").over(W.partitionBy(*by, "stat").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        at = counts.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
        goals = cut(at.select(*by, "stat", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "low", "high"))
    wide = found.groupBy(*by) if by else found.groupBy()
    return wide.agg(*[F.max(F.when(F.col("stat") == name, F.col("v"))).alias(name) for name in fractions])
