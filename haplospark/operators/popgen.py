"""Diversity within and differentiation between populations, from allele counts per population and site.

calls here have popcode; rows without one are left out, as every statistic here is of named populations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BASES, hash_int, is_callable, order_statistic, ratio
from .distance import all_pairs, chosen_distances, pack_calls


def allele_counts(calls: DataFrame) -> DataFrame:
    """(contig, popcode, pos, n, called, cA, cC, cG, cT); n: samples, called: those with a base."""
    counts = [F.count_if(F.upper("base") == b).alias(f"c{b}") for b in BASES]
    rows = calls.filter(F.col("popcode").isNotNull() & (F.col("popcode") != ""))
    return rows.groupBy("contig", "popcode", "pos").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_callable(F.col("base"))).alias("called"), *counts)


def nucleotide_diversity(calls: DataFrame) -> DataFrame:
    """Per population: joint sites (all samples callable), differences and comparisons over all pairs there, pi."""
    return diversity_of_counts(allele_counts(calls))


def diversity_of_counts(counts: DataFrame) -> DataFrame:
    """The same from allele counts.

    No pairs are formed: n samples with allele counts c differ in (n * n - sum(c * c)) / 2 pairs at a site.
    """
    joint = F.col("called") == F.col("n")
    squares = sum((F.col(f"c{b}") * F.col(f"c{b}") for b in BASES), F.lit(0))
    sites = counts.groupBy("contig", "popcode").agg(
        F.max("n").alias("samples"), F.count_if(joint).alias("joint_sites"), F.coalesce(F.sum(F.when(joint, ((F.col("n") * F.col("n") - squares) / 2).cast("long"))), F.lit(0)).alias("differences")
    )
    sites = sites.withColumn("compared", (F.col("joint_sites") * F.col("samples") * (F.col("samples") - 1) / 2).cast("long"))
    return sites.withColumn("pi", ratio("differences", "compared"))


def population_pairs(calls: DataFrame) -> DataFrame:
    """All unordered pairs of populations per contig, whether or not they have sites; a list of names per contig."""
    names = calls.filter(F.col("popcode").isNotNull() & (F.col("popcode") != "")).groupBy("contig").agg(F.array_sort(F.collect_set("popcode")).alias("names"))
    first = names.select("contig", "names", F.posexplode("names").alias("i", "population_1"))
    return first.select("contig", "population_1", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("population_2"))


def hudson_sites(counts: DataFrame) -> DataFrame:
    """Allele counts -> per pair and site with two calls in both populations: num and den, NULL unless the pool has two alleles."""
    pairs = all_pairs(counts.filter("called >= 2").drop("n"), "popcode", "contig", "pos", blocks=1)
    pool = {b: F.col(f"a_c{b}") + F.col(f"b_c{b}") for b in BASES}
    two = sum(((pool[b] > 0).cast("int") for b in BASES), F.lit(0)) == 2
    larger = lambda side: F.coalesce(*[F.when(pool[b] > 0, F.col(f"{side}_c{b}")) for b in reversed(BASES)])
    pairs = pairs.withColumn("p1", F.when(two, larger("a") / F.col("a_called"))).withColumn("p2", F.when(two, larger("b") / F.col("b_called")))
    p, q = F.col("p1"), F.col("p2")
    num = (p - q) * (p - q) - p * (1 - p) / (F.col("a_called") - 1) - q * (1 - q) / (F.col("b_called") - 1)
    den = p * (1 - q) + q * (1 - p)
    return pairs.select("contig", F.col("a_popcode").alias("population_1"), F.col("b_popcode").alias("population_2"), "pos", F.when(den > 0, num).alias("num"), F.when(den > 0, den).alias("den"))


def callable_sites(counts: DataFrame) -> DataFrame:
    """Per pair of populations, the sites with two calls in both, from 64-site masks: a row per word instead of per site."""
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    masks = counts.filter("called >= 2").groupBy("contig", "popcode", word).agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("mask"))
    pairs = all_pairs(masks, "popcode", "contig", "word", blocks=1)
    return pairs.groupBy("contig", F.col("a_popcode").alias("population_1"), F.col("b_popcode").alias("population_2")).agg(F.sum(F.expr("bit_count(a_mask & b_mask)")).cast("long").alias("callable_sites"))


def hudson_fst(calls: DataFrame) -> DataFrame:
    """Per pair of populations: callable sites, sums of the components, and their ratio (signed, never clamped).

    Pairs without such sites are there with 0 and NULL. Sites at which all populations show one allele add nothing to the
    sums, so only the others are joined by site.
    """
    counts = allele_counts(calls)
    variable = counts.groupBy("contig", "pos").agg(sum(((F.sum(f"c{b}") > 0).cast("int") for b in BASES), F.lit(0)).alias("alleles")).filter("alleles > 1")
    key = ["contig", "population_1", "population_2"]
    sums = hudson_sites(counts.join(variable, ["contig", "pos"], "left_semi")).groupBy(*key).agg(F.sum("num").alias("numerator"), F.sum("den").alias("denominator"))
    out = population_pairs(calls).join(callable_sites(counts), key, "left").join(sums, key, "left")
    zero = lambda c: F.when(F.col("callable_sites") > 0, F.coalesce(c, F.lit(0.0)))
    out = out.select(*key, F.coalesce("callable_sites", F.lit(0).cast("long")).alias("callable_sites"), zero(F.col("numerator")).alias("numerator"), zero(F.col("denominator")).alias("denominator"))
    return out.withColumn("fst", ratio("numerator", "denominator"))


def hudson_blocks(calls: DataFrame, block_size: int = 1000) -> DataFrame:
    """Components summed per physical block; a block is kept if any of its sites is callable, even with zero sums."""
    sites = hudson_sites(allele_counts(calls)).withColumn("block", F.floor(F.col("pos") / block_size).cast("int"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias
    return sites.groupBy("contig", "population_1", "population_2", "block").agg(zero("num")("numerator"), zero("den")("denominator"))


def block_bootstrap(blocks: DataFrame, replicates: int = 1000, seed: int = 1729, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Blocks -> per pair: blocks, estimates that are defined, and limits by order statistics.

    A replicate draws as many blocks as there are, with replacement, by a hash of seed, pair, replicate and slot.
    """
    key = ["contig", "population_1", "population_2"]
    packed = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "numerator", "denominator"))).alias("blocks"))
    packed = packed.withColumn("n", F.size("blocks"))
    draws = packed.select(*key, "n", "blocks", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    at = lambda slot: (hash_int(seed, F.col("contig"), F.col("population_1"), F.col("population_2"), F.col("replicate"), slot) % F.col("n")).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda slot: F.get("blocks", at(slot)))  # so the blocks stay in the row
    total = lambda c: F.aggregate(F.col("drawn"), F.lit(0.0), lambda sum_, b: sum_ + b[c])
    estimates = draws.select(*key, "n", "replicate", drawn.alias("drawn")).select(*key, "n", "replicate", total("numerator").alias("num"), total("denominator").alias("den"))
    estimates = estimates.withColumn("fst", F.round(F.when(F.col("den") > 1e-12, F.col("num") / F.col("den")), 9) + F.lit(0.0))
    return estimates.groupBy(*key, "n").agg(F.count("fst").alias("defined"), order_statistic(F.col("fst"), low).alias("low"), order_statistic(F.col("fst"), high).alias("high")).withColumnRenamed("n", "blocks")


def private_variants(calls: DataFrame, strict: bool = False) -> DataFrame:
    """calls (with ref) -> per population: sites with a non-reference allele that no other population has.

    strict: only sites at which every sample is callable. Populations without such sites are there with 0.
    """
    named = calls.filter(F.col("popcode").isNotNull() & (F.col("popcode") != ""))
    rows = named
    if strict:
        joint = named.groupBy("contig", "pos").agg(F.count_if(~is_callable(F.col("base"))).alias("missing")).filter("missing = 0")
        rows = named.join(joint, ["contig", "pos"], "left_semi")
    seen = rows.filter(is_callable(F.col("base")) & (F.upper("base") != F.upper("ref"))).groupBy("contig", "pos", F.upper("base").alias("base"))
    alone = seen.agg(F.min("popcode").alias("popcode"), F.max("popcode").alias("last")).filter("popcode = last")
    counted = alone.groupBy("contig", "popcode").agg(F.count_distinct("pos").alias("private_sites"))
    return named.select("contig", "popcode").distinct().join(counted, ["contig", "popcode"], "left").select("contig", "popcode", F.coalesce("private_sites", F.lit(0).cast("long")).alias("private_sites"))


def haplotype_diversity(assignments: DataFrame, ambiguous: str = "AMBIGUOUS") -> DataFrame:
    """(contig, popcode, haplotype) -> n, haplotypes, diversity n / (n - 1) * (1 - sum f^2); 0 for one sample, NULL for none."""
    key = ["contig", "popcode"]
    counts = assignments.groupBy(*key, "haplotype").agg(F.count(F.lit(1)).alias("c"))
    named = F.col("haplotype") != ambiguous
    out = counts.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(named, F.col("c"))), F.lit(0)).alias("assigned"), F.count_if(named).alias("haplotypes"), F.coalesce(F.sum(F.when(~named, F.col("c"))), F.lit(0)).alias("ambiguous"),
        F.sum(F.when(named, F.col("c") * F.col("c"))).alias("squares"),
    )
    n = F.col("assigned")
    value = F.when(n == 1, 0.0).when(n > 1, (n * n - F.col("squares")) / (n * (n - 1)).cast("double"))
    return out.withColumn("diversity", value).drop("squares")


def population_summary(calls: DataFrame, assignments: DataFrame) -> DataFrame:
    """A row per contig and population: diversity, haplotype diversity, private sites, and the list of samples."""
    key = ["contig", "popcode"]
    samples = calls.select(*key, "sample_id").distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ";").alias("sample_ids"))
    observed, strict = private_variants(calls), private_variants(calls, strict=True).withColumnRenamed("private_sites", "strict_private_sites")
    return nucleotide_diversity(calls).join(haplotype_diversity(assignments), key, "left").join(observed, key, "left").join(strict, key, "left").join(samples, key, "left")


def diversity_by_pairs(calls: DataFrame) -> DataFrame:
    """Nucleotide diversity from pairs of samples at joint sites: a second formula for cross-checks."""
    named = calls.filter(F.col("popcode").isNotNull() & (F.col("popcode") != ""))
    joint = named.groupBy("contig", "popcode", "pos").agg(F.count_if(~is_callable(F.col("base"))).alias("missing")).filter("missing = 0")
    sites = named.join(joint, ["contig", "popcode", "pos"], "left_semi").select("contig", "popcode", "pos", "sample_id", F.upper("base").alias("base"))
    pairs = all_pairs(sites, "sample_id", "contig", "popcode", "pos", blocks=1)
    return pairs.groupBy("contig", "popcode").agg(F.count_if(F.col("a_base") != F.col("b_base")).alias("differences"), F.count(F.lit(1)).alias("compared"))


def cross_check(calls: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Both formulas of nucleotide diversity side by side: counts must be equal, ratios within the tolerance."""
    one = nucleotide_diversity(calls).filter("compared > 0").select("contig", "popcode", "differences", "compared", "pi")
    two = diversity_by_pairs(calls).select("contig", "popcode", F.col("differences").alias("differences_2"), F.col("compared").alias("compared_2"))
    both = one.join(two, ["contig", "popcode"], "full_outer")
    agrees = (F.col("differences") == F.col("differences_2")) & (F.col("compared") == F.col("compared_2")) & (F.abs(F.col("pi") - ratio("differences_2", "compared_2")) <= tolerance)
    return both.withColumn("agrees", F.coalesce(agrees, F.lit(False)))


def joint_ratio(components: DataFrame, numerator: str, denominator: str, *by: str) -> DataFrame:
    """Ratio of sums over rows where both components are defined, and the number of those rows."""
    both = F.col(numerator).isNotNull() & F.col(denominator).isNotNull() & ~F.isnan(numerator) & ~F.isnan(denominator)
    sums = components.groupBy(*by).agg(F.sum(F.when(both, F.col(numerator))).alias("n"), F.sum(F.when(both, F.col(denominator))).alias("d"), F.count_if(both).alias("sites"))
    return sums.select(*by, "sites", ratio("n", "d").alias("ratio"))


def standardised_diversity(calls: DataFrame, draws: int = 1000, size: int = 4, seed: int = 1729, joint: bool = False) -> DataFrame:
    """Per population with at least ``size`` samples and draw: pi of ``size`` samples drawn without replacement.

    Differences and sites are summed over the pairs of the draw at pairwise-callable sites, or with ``joint`` at sites where
    all samples of the population are callable. A draw takes the samples with the least hashes; only pairs that are drawn are compared.
    """
    named = calls.filter(F.col("popcode").isNotNull() & (F.col("popcode") != ""))
    if joint:
        sites = named.groupBy("contig", "popcode", "pos").agg(F.count_if(~is_callable(F.col("base"))).alias("missing")).filter("missing = 0")
        named = named.join(sites, ["contig", "popcode", "pos"], "left_semi")
    within = named.withColumn("contig", F.concat_ws("\t", "contig", "popcode"))  # pairs only inside a population
    members = calls.filter("popcode <> ''").groupBy("contig", "popcode").agg(F.array_sort(F.collect_set("sample_id")).alias("ids")).filter(F.size("ids") >= size)
    drawn = members.select("contig", "popcode", "ids", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    ranked = F.array_sort(F.transform("ids", lambda s: F.struct(hash_int(seed, F.col("popcode"), F.col("draw"), s).alias("h"), s.alias("s"))))
    drawn = drawn.select("contig", "popcode", "draw", F.array_sort(F.transform(F.slice(ranked, 1, size), lambda x: x["s"])).alias("ids"))
    one = drawn.select("contig", "popcode", "draw", "ids", F.explode("ids").alias("sample_1"))
    two = one.select("contig", "popcode", "draw", "sample_1", F.explode("ids").alias("sample_2")).filter("sample_1 < sample_2")
    keyed = two.withColumn("_own", F.concat_ws("\t", "contig", "popcode"))
    pairs = chosen_distances(pack_calls(within), keyed.select(F.col("_own").alias("contig"), "sample_1", "sample_2")).withColumnRenamed("contig", "_own")
    sums = keyed.join(pairs, ["_own", "sample_1", "sample_2"], "left").groupBy("contig", "popcode", "draw")
    return sums.agg(F.coalesce(F.sum("differences"), F.lit(0)).alias("differences"), F.coalesce(F.sum("sites_compared"), F.lit(0)).alias("sites")).withColumn("pi", ratio("differences", "sites"))


def pair_count_errors(pairs: DataFrame, populations: DataFrame) -> DataFrame:
    """Contigs whose number of pairs isn't p * (p - 1) / 2 for their number of populations."""
    have = pairs.groupBy("contig").agg(F.count(F.lit(1)).alias("pairs"))
    want = populations.groupBy("contig").agg(F.count_distinct("popcode").alias("p")).select("contig", (F.col("p") * (F.col("p") - 1) / 2).cast("long").alias("expected"))
    return want.join(have, "contig", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long"))).filter("pairs <> expected")
