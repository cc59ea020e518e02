"""Scalar and aggregate column expressions. NaN never leaves an expression: undefined is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def is_callable(base: Column) -> Column:
    return F.upper(base).isin(*BASES)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that gives NULL on a zero denominator."""
    as_double = lambda x: (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.try_divide(as_double(numerator), as_double(denominator))


def finite(x: Column) -> Column:
    """NULL for NULL, NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def hash_int(*parts) -> Column:
    """The first 32 bits of the md5 of the parts joined by ``:``, as a long: equal in any engine that has md5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def average_rank(value: str, *by: str) -> Column:
    """Rank within ``by``; ties get the mean of their ranks."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / F.lit(2.0)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation from sums; NULL where a side has no variance or there are fewer than two rows."""
    n = F.count(F.lit(1)).cast("double")
    sx, sy = F.sum(x).cast("double"), F.sum(y).cast("double")  # products of whole sums may pass 64 bits
    var = (n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy)
    return F.when(n >= 2, F.try_divide(n * F.sum(x * y) - sx * sy, F.sqrt(F.greatest(var, F.lit(0.0)))))


def percentile_of(values: Column, q: float) -> Column:
    """Aggregate: linearly interpolated quantile."""
    return F.percentile(values, F.lit(q))


def order_statistic(values: Column, q: float) -> Column:
    """Aggregate: the finite values in order, that at int(q * (n - 1)); NULL without any."""
    ordered = F.array_sort(F.collect_list(finite(values)))
    return F.when(F.size(ordered) > 0, F.get(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1)).cast("int")))


def spearman(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """by..., rho, n_pairs (both finite), n_dropped. Ranks average ties; fewer than two pairs or no variance give NULL."""
    keyed = pairs.select(*by, finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y"))
    both = keyed.filter("x is not null and y is not null")
    ranked = both.withColumn("rx", average_rank("x", *by)).withColumn("ry", average_rank("y", *by))
    rho = ranked.groupBy(*by).agg(pearson(F.col("rx"), F.col("ry")).alias("rho"), F.count(F.lit(1)).alias("n_pairs"))
    counts = keyed.groupBy(*by).agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_dropped"))
    if not by:
        counts, rho, by = counts.withColumn("k", F.lit(0)), rho.withColumn("k", F.lit(0)), ("k",)
        return counts.join(rho, list(by), "left").select("rho", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "n_dropped")
    return counts.join(rho, list(by), "left").select(*by, "rho", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "n_dropped")


def bh_adjust(tests: DataFrame, p: str, *by: str) -> DataFrame:
    """tests with q: Benjamini-Hochberg within by. From the largest p down, the running minimum of p * m / rank, at most 1."""
    order = W.partitionBy(*by).orderBy(F.col(p))
    ranked = tests.withColumn("_rank", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy(*by)))
    down = W.partitionBy(*by).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def ecdf(table: DataFrame, value: str, *by: str) -> DataFrame:
    """by..., value, fraction: the k-th of n values at k / n; ties keep steps of their own."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(value))
    return table.filter(F.col(value).isNotNull()).select(*by, value, (k / F.count(F.lit(1)).over(W.partitionBy(*by))).alias("fraction"))
