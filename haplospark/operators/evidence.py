"""From depth and genotypes to eligible samples, supported positions, filtered sites and callable sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BASES, is_callable, percentile_of, ratio

DEPTHS = (1, 3, 5, 10)
EXCLUDED_FLAGS = 3844


def densify(depth: DataFrame, samples: DataFrame, length: int) -> DataFrame:
    """Sparse depth (sample_id, pos, depth) -> a row per sample and position, zeros where there was none."""
    dense = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    return dense.join(depth.select("sample_id", "pos", "depth"), ["sample_id", "pos"], "left").select("sample_id", "pos", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def depth_summary(depth: DataFrame, thresholds: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Per contig and sample: sites, mean depth, and the share of sites at each depth or more."""
    shares = [F.avg((F.col("depth") >= t).cast("double")).alias(f"breadth_dp{t}") for t in thresholds]
    return depth.groupBy("contig", "sample_id").agg(F.count(F.lit(1)).alias("sites"), F.avg("depth").alias("mean_depth"), *shares)


def eligibility(summary: DataFrame, depth: int = 5, breadth: float = 0.8) -> DataFrame:
    """Per contig and sample, whether its breadth at a depth reaches the cut-off, which is included."""
    return summary.select("contig", "sample_id", (F.col(f"breadth_dp{depth}") >= breadth).alias("eligible"))


def shared_samples(eligible: DataFrame, contigs: int = 2) -> DataFrame:
    """Samples that are eligible for all contigs."""
    return eligible.filter("eligible").groupBy("sample_id").agg(F.count_distinct("contig").alias("n")).filter(F.col("n") == contigs).select("sample_id")


def position_support(depth: DataFrame, eligible: DataFrame, at_least: int) -> DataFrame:
    """Per contig and position: eligible samples, and those with enough depth. Eligibility goes first."""
    own = depth.join(eligible.filter("eligible").select("contig", "sample_id"), ["contig", "sample_id"], "left_semi")
    return own.groupBy("contig", "pos").agg(F.count_if(F.col("depth") >= at_least).alias("support"), F.count(F.lit(1)).alias("samples"))


def mask_genotypes(genotypes: DataFrame, min_depth: int = 5, min_quality: int = 20) -> DataFrame:
    """gt is NULL where depth or quality is missing or low; the site and the other samples stay."""
    return genotypes.withColumn("gt", F.when((F.col("dp") >= min_depth) & (F.col("gq") >= min_quality), F.col("gt")))


def reference_call(pl: Column, ref: Column, alts: Column, depth: Column, min_depth: int = 5, min_quality: int = 20) -> Column:
    """True where evidence is for the reference: a single-letter REF, likelihoods for all genotypes of its alleles, and the
    reference better than every homozygous alternate by min_quality. Allele k's homozygote is at k * (k + 3) / 2."""
    alleles = F.size(alts) + 1
    complete = F.size(pl) == F.floor(alleles * (alleles + 1) / 2)
    alternate = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(alleles - 1, F.lit(1))), lambda k: F.get(pl, F.floor(k * (k + 3) / 2).cast("int"))))
    return F.coalesce((depth >= min_depth) & (F.length(ref) == 1) & complete & (alternate - F.get(pl, F.lit(0)) >= min_quality) & (alternate > F.get(pl, F.lit(0))), F.lit(False))


def callable_sequence(reference: DataFrame, invariant: DataFrame, variants: DataFrame, accepted: DataFrame) -> DataFrame:
    """Calls of all samples over the reference (contig, pos, ref): N, then reference calls, then alleles at accepted sites.

    invariant: (contig, sample_id, pos, base); variants: the same, of which only single letters at accepted (contig, pos)
    count and win over the former.
    """
    win = variants.join(accepted.select("contig", "pos").distinct(), ["contig", "pos"], "left_semi").filter(F.length("base") == 1)
    evidence = invariant.select("contig", "sample_id", "pos", "base", F.lit(1).alias("rank")).unionByName(win.select("contig", "sample_id", "pos", "base", F.lit(2).alias("rank")))
    best = evidence.groupBy("contig", "sample_id", "pos").agg(F.max_by("base", "rank").alias("called"))
    samples = evidence.select("sample_id").distinct()
    spread = reference.groupBy("contig").agg(F.collect_list(F.struct("pos", "ref")).alias("sites"))
    own = samples.select("sample_id", F.lit(1).alias("_k")).join(spread.withColumn("_k", F.lit(1)), "_k").select("sample_id", "contig", F.explode("sites").alias("s")).select("contig", "sample_id", "s.pos", "s.ref")
    return own.join(best, ["contig", "sample_id", "pos"], "left").select("contig", "sample_id", "pos", "ref", F.coalesce("called", F.lit("N")).alias("base"))


def site_layers(genotypes: DataFrame, min_quality: float = 30.0, max_missing: float = 0.2) -> DataFrame:
    """Per site: genotypes, called, alternate count, missing share, and the layers it belongs to.

    All layers take biallelic SNPs with enough quality and few missing genotypes (of all, called or not): high_confidence all
    of them, primary those with both alleles, ordination those with each allele twice.
    """
    sites = genotypes.groupBy("contig", "pos", "ref", "alt").agg(
        F.count(F.lit(1)).alias("samples"), F.count("gt").alias("called"), F.coalesce(F.sum("gt"), F.lit(0)).cast("long").alias("alternate"), F.max("qual").alias("qual")
    )
    sites = sites.withColumn("missing", ratio(F.col("samples") - F.col("called"), F.col("samples")))
    snp = (F.length("ref") == 1) & (F.length("alt") == 1) & F.col("ref").isin(*BASES) & F.col("alt").isin(*BASES)
    good = snp & (F.col("qual") >= min_quality) & (F.col("missing") <= max_missing)
    sites = sites.withColumn("high_confidence", good & (F.col("alternate") >= 1))
    for name, n in (("primary", 1), ("ordination", 2)):
        sites = sites.withColumn(name, good & F.col("alternate").between(n, F.col("called") - n))
    return sites


def site_filter(genotypes: DataFrame, min_mac: int = 1, min_quality: float = 30.0, max_missing: float = 0.2) -> DataFrame:
    """Sites that pass quality and missingness with at least min_mac samples of the rarer allele."""
    sites = site_layers(genotypes, min_quality, max_missing)
    good = (F.col("qual") >= min_quality) & (F.col("missing") <= max_missing) & F.col("alternate").between(min_mac, F.col("called") - min_mac)
    return sites.filter(good).select("contig", "pos", "ref", "alt", "called", "alternate", "missing")


def complete_markers(genotypes: DataFrame) -> DataFrame:
    """Genotypes at markers that every sample has."""
    full = genotypes.groupBy("contig", "pos").agg(F.count("gt").alias("g"), F.count(F.lit(1)).alias("n")).filter("g = n")
    return genotypes.join(full, ["contig", "pos"], "left_semi")


def haploid_to_diploid(genotypes: DataFrame) -> DataFrame:
    """Two equal alleles per haploid genotype, 0 and 0 where it is missing or an allele has more than a letter."""
    allele = F.when(F.col("gt") == 0, F.col("ref")).when(F.col("gt") == 1, F.col("alt"))
    allele = F.coalesce(F.when(F.length(allele) == 1, allele), F.lit("0"))
    return genotypes.select("contig", "sample_id", "pos", allele.alias("allele_1"), allele.alias("allele_2"))


def flag_filter(records: DataFrame, excluded: int = EXCLUDED_FLAGS, min_quality: int = 20) -> DataFrame:
    """Counts of alignment records kept, rejected by flag, and rejected by mapping quality."""
    bad = F.col("flag").bitwiseAND(F.lit(excluded)) != 0
    return records.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~bad & (F.col("mapq") >= min_quality)).alias("kept"), F.count_if(bad).alias("flagged"), F.count_if(~bad & (F.col("mapq") < min_quality)).alias("low_quality")
    )


def boundary_depth(depth: DataFrame, length: int, window: int = 1000) -> DataFrame:
    """Per contig and sample: mean depth of the first and last positions and of the interior; the window is at most length / 4."""
    w = min(window, length // 4)
    first, last = F.col("pos") < w, F.col("pos") >= length - w
    return depth.groupBy("contig", "sample_id").agg(
        F.avg(F.when(first, F.col("depth"))).alias("start_depth"), F.avg(F.when(last, F.col("depth"))).alias("end_depth"), F.avg(F.when(~first & ~last, F.col("depth"))).alias("interior_depth")
    )


def boundary_summary(boundaries: DataFrame) -> DataFrame:
    """Per contig: means over samples, and the median of the lower end's share of the interior depth."""
    low = F.least("start_depth", "end_depth")
    return boundaries.groupBy("contig").agg(
        F.avg("start_depth").alias("start_depth"), F.avg("end_depth").alias("end_depth"), F.avg("interior_depth").alias("interior_depth"), percentile_of(ratio(low, F.col("interior_depth")), 0.5).alias("median_ratio")
    )


def repeat_ratio(depth: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per sample: mean depth inside and outside the repeat intervals, and their ratio (NULL where outside is 0)."""
    inside = repeats.filter("start < end").select(F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().withColumn("repeat", F.lit(True))
    marked = depth.join(inside, "pos", "left").withColumn("repeat", F.coalesce("repeat", F.lit(False)))
    out = marked.groupBy("sample_id").agg(F.avg(F.when(F.col("repeat"), F.col("depth"))).alias("repeat_depth"), F.avg(F.when(~F.col("repeat"), F.col("depth"))).alias("unique_depth"))
    return out.withColumn("ratio", ratio("repeat_depth", "unique_depth"))


def coordinate_windows(calls: DataFrame, repeats: DataFrame, variants: DataFrame, size: int = 5000) -> DataFrame:
    """Per contig and window: callable sites (any sample), repeat bases, variants, variants per callable kb, mean depth."""
    window = F.floor(F.col("pos") / size).cast("int").alias("window")
    sites = calls.groupBy("contig", "pos").agg(F.max(is_callable(F.col("base")).cast("int")).alias("callable"), F.sum("depth").alias("d"), F.count(F.lit(1)).alias("n"))
    inside = repeats.filter("start < end").select(F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().withColumn("repeat", F.lit(1))
    seen = variants.select("contig", "pos").distinct().withColumn("variant", F.lit(1))
    out = sites.join(inside, "pos", "left").join(seen, ["contig", "pos"], "left").groupBy("contig", window).agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.sum("callable").alias("callable"), F.count("repeat").alias("repeat_bases"), F.count("variant").alias("variants"), ratio(F.sum("d"), F.sum("n")).alias("mean_depth")
    )
    return out.withColumn("variants_per_kb", ratio(F.col("variants") * 1000, F.col("callable")))


def mixed_allele_screen(genotypes: DataFrame, least_mixed: int = 10) -> DataFrame:
    """Per sample: sites with two alleles in sizeable shares, their rate, and whether it stands out from the other samples.

    Mixed: depth of 20, three reads of each allele, and a minor share between 0.2 and 0.8. Suspected: at least least_mixed
    such sites and a rate above the median by five median absolute deviations. Both statistics are over a row per sample.
    """
    ref, alt = F.col("ad")[0], F.col("ad")[1]
    share = ratio(alt, ref + alt)
    mixed = (F.col("dp") >= 20) & (ref >= 3) & (alt >= 3) & share.between(0.2, 0.8)
    rates = genotypes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("sites"), F.count_if(mixed).alias("mixed")).withColumn("rate", ratio("mixed", "sites"))
    middle = rates.agg(F.percentile("rate", F.lit(0.5)).alias("median"))
    both = rates.join(F.broadcast(middle))
    spread = both.agg(F.percentile(F.abs(F.col("rate") - F.col("median")), F.lit(0.5)).alias("mad"))
    both = both.join(F.broadcast(spread))
    return both.withColumn("suspected", (F.col("mixed") >= least_mixed) & (F.col("rate") > F.col("median") + 5 * F.col("mad")))


def preprocessing_rollup(reports: DataFrame) -> DataFrame:
    """Reports (input_reads, passing_reads, bases, q30_rate, duplication) -> totals, base-weighted rate, retention, median."""
    return reports.agg(
        F.count(F.lit(1)).alias("reports"), F.sum("input_reads").alias("input_reads"), F.sum("passing_reads").alias("passing_reads"), F.sum("bases").alias("bases"),
        ratio(F.sum(F.col("q30_rate") * F.col("bases")), F.sum("bases")).alias("q30_rate"), ratio(F.sum("passing_reads"), F.sum("input_reads")).alias("retention"), percentile_of(F.col("duplication"), 0.5).alias("median_duplication"),
    )
