"""Comparing scenarios: agreement of statistics, threshold ladders, extremes, and roll-ups of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, percentile_of, ratio, spearman

SEVERITY = ("PASS", "CAVEAT", "FAIL")


def compare(baseline: DataFrame, scenario: DataFrame, value: str, *key: str) -> DataFrame:
    """key..., baseline, scenario for keys that both have with finite values."""
    a = baseline.select(*key, finite(F.col(value)).alias("baseline")).filter("baseline is not null")
    b = scenario.select(*key, finite(F.col(value)).alias("scenario")).filter("scenario is not null")
    return a.join(b, list(key))


def pi_comparison(pairs: DataFrame, *by: str) -> DataFrame:
    """Compared pi -> per group: common rows, rho, median and largest proportional change, and transitions from and to 0."""
    change = F.when(F.col("baseline") != 0, F.abs(F.col("scenario") - F.col("baseline")) / F.abs("baseline"))
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("common"), percentile_of(change, 0.5).alias("median_change"), F.max(change).alias("max_change"),
        F.count_if((F.col("baseline") == 0) & (F.col("scenario") != 0)).alias("from_zero"), F.count_if((F.col("baseline") != 0) & (F.col("scenario") == 0)).alias("to_zero"),
    )
    return out.join(spearman(pairs, "baseline", "scenario", *by).select(*by, "rho"), list(by), "left")


def fst_comparison(pairs: DataFrame, *by: str) -> DataFrame:
    """Compared FST -> per group: common rows, rho, median and largest absolute change."""
    change = F.abs(F.col("scenario") - F.col("baseline"))
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("common"), percentile_of(change, 0.5).alias("median_change"), F.max(change).alias("max_change"))
    return out.join(spearman(pairs, "baseline", "scenario", *by).select(*by, "rho"), list(by), "left")


def ladder(rho: Column, change: Column, limits: tuple[tuple[str, float, float], ...]) -> Column:
    """The first rung (label, least rho, largest change) that holds, else FAIL."""
    out = F
    for label, r, c in limits:
        out = out.when((rho >= r) & (change <= c), label)
    return out.otherwise("FAIL")


def classify_pi(rho: Column, change: Column) -> Column:
    return ladder(rho, change, (("PASS", 0.95, 0.10), ("CAVEAT", 0.90, 0.25)))


def classify_fst(rho: Column, change: Column) -> Column:
    return ladder(rho, change, (("PASS", 0.95, 0.05), ("CAVEAT", 0.90, 0.10)))


def classify_pca(r: Column, p: Column) -> Column:
    return F.when((r >= 0.90) & (p < 0.001), "PASS").when(r >= 0.80, "CAVEAT").otherwise("FAIL")


def likelihood_decision(centre: Column, side: Column, conflict: Column, centre_limit: float = 0.15, side_limit: float = 0.20) -> Column:
    return F.when(centre > centre_limit, "insufficient").when((side > side_limit) & conflict, "network").otherwise("tree_like")


def rank_extremes(pairs: DataFrame, metric: str, limit: int, key: str, *by: str) -> DataFrame:
    """The largest changes per group, ten or so. pi: changes between zero and non-zero first, then by proportional change;
    fst: by absolute change. Changes up to 1e-12 don't count; ties go by key."""
    delta = F.col("scenario") - F.col("baseline")
    rows = pairs.filter(F.abs(delta) > 1e-12).withColumn("change", delta)
    transition = ((F.col("baseline") == 0) != (F.col("scenario") == 0)).cast("int") if metric == "pi" else F.lit(0)
    size = F.when(F.col("baseline") != 0, F.abs(delta) / F.abs("baseline")).otherwise(F.abs(delta)) if metric == "pi" else F.abs(delta)
    rows = rows.withColumns({"transition": transition, "size": F.round(size, 12)})
    order = W.partitionBy(*by).orderBy(F.desc("transition"), F.desc("size"), key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def cross_contig_agreement(fst: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of populations with their FST in both contigs, and whether each is defined."""
    side = lambda c, n: fst.filter(F.col("contig") == c).select("population_1", "population_2", F.col("fst").alias(n))
    both = side(first, "fst_1").join(side(second, "fst_2"), ["population_1", "population_2"])
    return both.withColumn("defined_1", F.col("fst_1").isNotNull()).withColumn("defined_2", F.col("fst_2").isNotNull())


def claim_rollup(claims: DataFrame, *by: str) -> DataFrame:
    """The worst status of each group, unknown statuses being worst, and how many there are of each."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status")), F.lit(0))
    rank = F.when(rank == 0, len(SEVERITY)).otherwise(rank)
    return claims.groupBy(*by).agg(F.get(F.array(*map(F.lit, SEVERITY)), (F.max(rank) - 1).cast("int")).alias("worst"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in SEVERITY])


def resolve_claims(claims: DataFrame, likelihood: DataFrame, comparison: DataFrame, resampling: DataFrame, technical: DataFrame) -> DataFrame:
    """claims (claim, status) with placeholder statuses taken from result tables of a few rows each.

    likelihood (decision, composition_failures, centre): any insufficient decision fails, else composition failures or a centre
    of .14 are a caveat. comparison (rf): above 0 is a caveat. resampling (on_top, below): both PASS, one CAVEAT, none FAIL.
    technical (status): a FAIL there wins over everything.
    """
    l = likelihood.agg(F.bool_or(F.col("decision") == "insufficient").alias("bad"), F.bool_or((F.col("composition_failures") > 0) | (F.col("centre") >= 0.14)).alias("weak"))  # noqa: E741
    r = comparison.agg((F.max("rf") > 0).alias("differs"))
    s = resampling.agg(F.bool_and("on_top").alias("top"), F.bool_and("below").alias("low"))
    t = technical.agg(F.bool_or(F.col("status") == "FAIL").alias("failed"))
    facts = l.join(r).join(s).join(t)
    both = claims.join(F.broadcast(facts))  # one row of facts
    status = (
        F.when(F.col("failed"), "FAIL")
        .when(F.col("claim") == "tree_signal", F.when(F.col("bad"), "FAIL").when(F.col("weak"), "CAVEAT").otherwise("PASS"))
        .when(F.col("claim") == "tree_agreement", F.when(F.col("differs"), "CAVEAT").otherwise("PASS"))
        .when(F.col("claim") == "resampling", F.when(F.col("top") & F.col("low"), "PASS").when(F.col("top") | F.col("low"), "CAVEAT").otherwise("FAIL"))
        .otherwise(F.col("status"))
    )
    return both.select("claim", F.when(F.col("status") == "PENDING", status).otherwise(F.col("status")).alias("status"))


def canonical_summary(eligible: DataFrame, layers: DataFrame, diversity: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per contig: eligible samples, sites of each layer, populations, pairs, and the range of finite pi."""
    parts = [
        eligible.groupBy("contig").agg(F.count_if("eligible").alias("eligible_samples")),
        layers.groupBy("contig").agg(*[F.count_if(c).alias(f"{c}_sites") for c in ("high_confidence", "primary", "ordination")]),
        diversity.groupBy("contig").agg(F.count(F.lit(1)).alias("populations"), F.min(finite(F.col("pi"))).alias("min_pi"), F.max(finite(F.col("pi"))).alias("max_pi")),
        pairs.groupBy("contig").agg(F.count(F.lit(1)).alias("pairs")),
    ]
    return reduce(lambda a, b: a.join(b, "contig", "left"), parts)


def symmetric_limit(values: DataFrame, value: str, *by: str) -> DataFrame:
    """The largest finite size of a value, 1 where that is 0, NULL where there is none."""
    top = F.max(F.abs(finite(F.col(value))))
    return values.groupBy(*by).agg(F.when(top == 0, 1.0).otherwise(top).alias("limit"))


def report_delta(reports: DataFrame) -> DataFrame:
    """Reports (contig, run, resolved, side, centre): restricted minus primary."""
    side = lambda run, p: reports.filter(F.col("run") == run).select("contig", *[F.col(c).alias(f"{p}{c}") for c in ("resolved", "side", "centre")])
    both = side("primary", "a_").join(side("restricted", "b_"), "contig")
    return both.select("contig", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_change") for c in ("resolved", "side", "centre")])


def cv_select_k(errors: DataFrame, *by: str) -> DataFrame:
    """errors (by..., k, replicate, cv) -> the k with the least mean error (the smaller of equals), whether it is at the edge of
    the tested range, and its best replicate."""
    means = errors.groupBy(*by, "k").agg(F.round(F.avg("cv"), 12).alias("mean_cv"), F.min_by("replicate", F.struct("cv", "replicate")).alias("best_replicate"))
    best = means.groupBy(*by).agg(F.min_by(F.struct("k", "mean_cv", "best_replicate"), F.struct("mean_cv", "k")).alias("b"), F.min("k").alias("low"), F.max("k").alias("high"))
    return best.select(*by, F.col("b.k").alias("k"), F.col("b.mean_cv").alias("mean_cv"), F.col("b.best_replicate").alias("best_replicate"), ((F.col("b.k") == F.col("low")) | (F.col("b.k") == F.col("high"))).alias("at_boundary"))
