"""Many scenarios of one evidence table in one scan: which of them a row takes part in is a bit mask, not a copy per scenario.

A scenario is a set of thresholds. Its samples have enough breadth; its sites lie in islands of enough support among those;
its genotypes have enough depth and quality; and alternate alleles count only at sites that pass its site filter. Rows are
multiplied by scenarios only after they have been added up by site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BASES, is_callable
from .intervals import support_islands

#: Shortest island of supported positions.
LENGTH = 50


@dataclass(frozen=True)
class Scenario:
    """Thresholds. A mask-only scenario names another one in ``samples_of``, whose samples it takes, and may be of some contigs only."""

    name: str
    depth: int
    quality: int
    breadth: float
    support: float
    max_missing: float = 0.2
    samples_of: str | None = None
    contigs: tuple[str, ...] = ()


def _bits(flags: list[Column]) -> Column:
    """A long with bit i set where flag i is true."""
    out = F.lit(0).cast("long")
    for i, flag in enumerate(flags):
        out = out + F.when(flag, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def _has(mask: str, i: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << i).cast("long")) != 0


def eligible_samples(evidence: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """contig, sample_id, members: the scenarios of which the sample has the breadth, in those of the contig."""
    by_name = {s.name: s for s in scenarios}
    basis = [by_name[s.samples_of] if s.samples_of else s for s in scenarios]
    depths = sorted({b.depth for b in basis})
    breadth = evidence.groupBy("contig", "sample_id").agg(*[F.avg((F.col("dp") >= d).cast("double")).alias(f"b{d}") for d in depths])
    flags = [(F.col(f"b{b.depth}") >= b.breadth) & (F.col("contig").isin(*s.contigs) if s.contigs else F.lit(True)) for s, b in zip(scenarios, basis, strict=True)]
    return breadth.select("contig", "sample_id", _bits(flags).alias("members")).filter("members <> 0")


def scenario_islands(marked: DataFrame, scenarios: list[Scenario], length: int = LENGTH) -> DataFrame:
    """scenario (its number), contig, start, end: runs of at least length positions with enough support.

    marked: evidence with members. A position has support if at least ceil(samples * support) of the scenario's samples have
    its depth there.
    """
    counts = [F.struct(F.lit(i).alias("scenario"), F.count_if(_has("members", i)).alias("samples"), F.count_if(_has("members", i) & (F.col("dp") >= s.depth)).alias("support"), F.lit(s.support).alias("fraction")) for i, s in enumerate(scenarios)]
    sites = marked.groupBy("contig", "pos").agg(F.array(*counts).alias("all")).select("contig", "pos", F.explode("all").alias("s")).select("contig", "pos", "s.*").filter("samples > 0")
    enough = sites.filter(F.col("support") >= F.ceil(F.col("samples") * F.col("fraction"))).select("contig", "pos", "scenario", F.lit(1).alias("support"), F.lit(1).alias("of"))
    return support_islands(enough, "of", 1.0, length, "scenario", "contig")


def scenario_evidence(evidence: DataFrame, scenarios: list[Scenario], length: int = LENGTH, least_quality: float = 30.0) -> DataFrame:
    """Evidence (contig, sample_id, pos, ref, base, gt, dp, gq, qual, ...) with members and called, as masks of scenarios.

    members: the sample is eligible and the site in an island. called: the genotype passes there, and is the reference's base
    or at an accepted site. Rows of no scenario go. accepted and ordination mark sites: enough quality, few genotypes missing
    and an alternate allele, or each allele at least twice.
    """
    marked = evidence.join(eligible_samples(evidence, scenarios), ["contig", "sample_id"])
    islands = scenario_islands(marked, scenarios, length)
    inside = islands.select("contig", "scenario", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    inside = inside.groupBy("contig", "pos").agg(F.bit_or(F.expr("shiftleft(1L, scenario)")).alias("inside"))
    own = marked.join(inside, ["contig", "pos"]).withColumn("members", F.col("members").bitwiseAND(F.col("inside"))).drop("inside").filter("members <> 0")
    own = own.withColumn("passing", _bits([_has("members", i) & (F.col("dp") >= s.depth) & (F.col("gq") >= s.quality) & is_callable(F.col("base")) for i, s in enumerate(scenarios)]))
    sums = [F.struct(F.count_if(_has("members", i)).alias("n"), F.count_if(_has("passing", i) & F.col("gt").isNotNull()).alias("called"), F.coalesce(F.sum(F.when(_has("passing", i), F.col("gt"))), F.lit(0)).cast("long").alias("alt")).alias(f"s{i}") for i in range(len(scenarios))]
    sites = own.groupBy("contig", "pos").agg(F.max("qual").alias("best"), *sums)
    good = [(F.col("best") >= least_quality) & (F.col(f"s{i}.n") > 0) & ((F.col(f"s{i}.n") - F.col(f"s{i}.called")) / F.col(f"s{i}.n") <= s.max_missing) for i, s in enumerate(scenarios)]
    accepted = _bits([g & (F.col(f"s{i}.alt") >= 1) for i, g in enumerate(good)])
    twice = _bits([g & F.col(f"s{i}.alt").between(F.lit(2), F.col(f"s{i}.called") - 2) for i, g in enumerate(good)])
    own = own.join(sites.select("contig", "pos", accepted.alias("accepted"), twice.alias("ordination")), ["contig", "pos"])
    called = F.when(F.upper("base") == F.upper("ref"), F.col("passing")).otherwise(F.col("passing").bitwiseAND(F.col("accepted")))
    return own.withColumn("called", called)


def keyed(scenario: Column, names: list[str], contig: str = "contig") -> Column:
    """``scenario|contig``: operators that group by contig keep scenarios apart by it."""
    return F.concat_ws("|", F.element_at(F.array(*map(F.lit, names)), scenario + 1), contig)


def scenario_counts(own: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Allele counts as of popgen.allele_counts, with ``scenario|contig`` as contig: one aggregation for all scenarios."""
    one = lambda i: F.struct(
        F.lit(i).alias("scenario"), F.count_if(_has("members", i)).alias("n"), F.count_if(_has("called", i)).alias("called"),
        *[F.count_if(_has("called", i) & (F.upper("base") == b)).alias(f"c{b}") for b in BASES],
    )
    rows = own.filter(F.col("popcode").isNotNull() & (F.col("popcode") != "")).groupBy("contig", "popcode", "pos").agg(F.array(*[one(i) for i in range(len(scenarios))]).alias("all"))
    each = rows.select("contig", "popcode", "pos", F.explode("all").alias("s")).select("contig", "popcode", "pos", "s.*").filter("n > 0")
    return each.withColumn("contig", keyed(F.col("scenario"), [s.name for s in scenarios])).drop("scenario")


def scenario_markers(own: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """``scenario|contig`` as contig, pos, sample_id, g at the sites fit for ordination; g is null where the genotype fails."""
    both = F.col("members").bitwiseAND(F.col("ordination"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(len(scenarios) - 1)), lambda i: F.call_function("getbit", both, i) == 1)
    each = own.filter(both != 0).withColumn("scenario", F.explode(numbers))
    g = F.when(F.call_function("getbit", F.col("passing"), F.col("scenario")) == 1, F.col("gt"))
    return each.select(keyed(F.col("scenario"), [s.name for s in scenarios]).alias("contig"), "pos", "sample_id", g.alias("g"))
