"""Long call tables (contig, sample_id, pos, base, ...): one row per sample and 0-based position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import is_callable, ratio


def explode_alignment(alignment: DataFrame) -> DataFrame:
    """(contig, sample_id, seq) -> calls; letters are upper-cased once, here."""
    return alignment.select("contig", "sample_id", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base"))


def collapse_calls(calls: DataFrame) -> DataFrame:
    """calls -> (contig, sample_id, seq), bases in order of position. A sequence is a row, so only for the edges."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "base")))
    return calls.groupBy("contig", "sample_id").agg(F.array_join(F.transform(ordered, lambda x: x["base"]), "").alias("seq"))


def restrict_to_mask(calls: DataFrame, mask: DataFrame) -> DataFrame:
    """Calls at positions inside any of the half-open intervals of mask (start, end); positions are kept once."""
    inside = mask.filter(F.col("start") < F.col("end")).select(F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct()
    return calls.join(inside, "pos", "left_semi")


def restricted_length_errors(alignment: DataFrame, expected: int) -> DataFrame:
    return alignment.filter(F.length("seq") != expected).select("contig", "sample_id", F.length("seq").alias("found"), F.lit(expected).alias("expected"))


def trim_sequence(alignment: DataFrame, keep: int) -> DataFrame:
    """Sequences cut at a length: kept and removed; shorter ones have nothing removed and are flagged."""
    return alignment.select("contig", "sample_id", F.substring("seq", 1, keep).alias("kept"), F.substring("seq", keep + 1, 1 << 30).alias("removed"), (F.length("seq") < keep).alias("too_short"))


def site_callability(calls: DataFrame) -> DataFrame:
    """Per contig: span, and the sites at which at least one, at least two, and all samples are callable."""
    sites = calls.groupBy("contig", "pos").agg(F.count_if(is_callable(F.col("base"))).alias("called"), F.count(F.lit(1)).alias("n"))
    return sites.groupBy("contig").agg(
        F.count(F.lit(1)).alias("span"), F.count_if(F.col("called") >= 1).alias("at_least_one"), F.count_if(F.col("called") >= 2).alias("at_least_two"), F.count_if(F.col("called") == F.col("n")).alias("joint")
    )


def _alleles(calls: DataFrame, *by: str) -> DataFrame:
    return calls.filter(is_callable(F.col("base"))).groupBy(*by, "contig", "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def variable_sites(calls: DataFrame) -> DataFrame:
    """Positions with more than one callable allele."""
    return _alleles(calls).groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("alleles"), F.count_if(F.col("n") >= 2).alias("common")).filter("alleles > 1")


def site_counts(calls: DataFrame) -> DataFrame:
    """Per contig: variable sites, and parsimony-informative ones (two alleles with two samples each)."""
    sites = _alleles(calls).groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("alleles"), F.count_if(F.col("n") >= 2).alias("common"))
    return sites.groupBy("contig").agg(F.count_if(F.col("alleles") > 1).alias("variable"), F.count_if(F.col("common") >= 2).alias("informative"))


def partition_contribution(calls: DataFrame) -> DataFrame:
    """Each contig's counts and its share of the totals; NULL where a total is 0. The window runs over a row per contig."""
    counts = site_callability(calls).join(site_counts(calls), "contig", "left").na.fill(0, ["variable", "informative"])
    total = W.partitionBy(F.lit(1))
    out = ["contig"]
    for c in ("span", "at_least_two", "joint", "variable", "informative"):
        counts = counts.withColumn(f"{c}_share", F.round(ratio(F.col(c), F.sum(c).over(total)), 9))
        out += [c, f"{c}_share"]
    return counts.select(*out)


def reference_concordance(calls: DataFrame) -> DataFrame:
    """calls (with ref) -> per sample and contig: callable bases, matches, differences, identity."""
    call = is_callable(F.col("base"))
    same = F.upper("base") == F.upper("ref")
    out = calls.groupBy("contig", "sample_id").agg(F.count_if(call).alias("callable"), F.count_if(call & same).alias("matches"), F.count_if(call & ~same).alias("differences"))
    return out.withColumn("identity", F.round(ratio("matches", "callable"), 9))


def concat_partitions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two alignments (sample_id, seq) -> one over the shared samples, with the end of the first part (1-based charset)."""
    a, b = first.select("sample_id", F.col("seq").alias("a")), second.select("sample_id", F.col("seq").alias("b"))
    return a.join(b, "sample_id").select("sample_id", F.concat("a", "b").alias("seq"), F.length("a").alias("first_end"), F.length(F.concat("a", "b")).alias("second_end"))


def alignment_errors(alignment: DataFrame) -> DataFrame:
    """Violations per contig: unequal lengths, empty sequences, letters outside ACGTN. Empty: valid."""
    found = alignment.groupBy("contig").agg(
        F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"), F.count_if(F.length("seq") == 0).alias("empty"), F.count_if(F.upper("seq").rlike("[^ACGTN]")).alias("bad_letters")
    )
    return found.filter("shortest <> longest or empty > 0 or bad_letters > 0")
