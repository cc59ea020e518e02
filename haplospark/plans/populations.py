"""Queries over populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..catalog import query
from ..fixtures import with_ctes
from ..operators import popgen

COUNTS = """counts AS (SELECT contig, popcode, pos, count(*) AS n, count(*) FILTER (WHERE base <> 'N') AS called, count(*) FILTER (WHERE base = 'A') AS ca,
  count(*) FILTER (WHERE base = 'C') AS cc, count(*) FILTER (WHERE base = 'G') AS cg, count(*) FILTER (WHERE base = 'T') AS ct FROM calls GROUP BY ALL)"""
DIVERSITY = """diversity AS (SELECT contig, popcode, max(n) AS samples, count(*) FILTER (WHERE called = n) AS joint_sites,
  coalesce(sum((n * n - ca * ca - cc * cc - cg * cg - ct * ct) // 2) FILTER (WHERE called = n), 0)::BIGINT AS differences,
  (count(*) FILTER (WHERE called = n) * max(n) * (max(n) - 1) // 2)::BIGINT AS compared FROM counts GROUP BY ALL)"""
HUDSON = """pairs AS (SELECT DISTINCT a.contig, a.popcode AS population_1, b.popcode AS population_2 FROM counts a JOIN counts b ON a.contig = b.contig AND a.popcode < b.popcode),
joined AS (SELECT a.contig, a.popcode AS population_1, b.popcode AS population_2, a.pos, a.called AS n1, b.called AS n2,
  ((a.ca + b.ca > 0)::INT + (a.cc + b.cc > 0)::INT + (a.cg + b.cg > 0)::INT + (a.ct + b.ct > 0)::INT) AS alleles,
  CASE WHEN a.ct + b.ct > 0 THEN a.ct WHEN a.cg + b.cg > 0 THEN a.cg WHEN a.cc + b.cc > 0 THEN a.cc ELSE a.ca END::DOUBLE / a.called AS p,
  CASE WHEN a.ct + b.ct > 0 THEN b.ct WHEN a.cg + b.cg > 0 THEN b.cg WHEN a.cc + b.cc > 0 THEN b.cc ELSE b.ca END::DOUBLE / b.called AS q
  FROM counts a JOIN counts b ON a.contig = b.contig AND a.pos = b.pos AND a.popcode < b.popcode WHERE a.called >= 2 AND b.called >= 2),
comp AS (SELECT contig, population_1, population_2, pos, CASE WHEN alleles = 2 THEN (p - q) * (p - q) - p * (1 - p) / (n1 - 1) - q * (1 - q) / (n2 - 1) END AS num,
  CASE WHEN alleles = 2 THEN p * (1 - q) + q * (1 - p) END AS den FROM joined),
fst AS (SELECT pairs.contig, pairs.population_1, pairs.population_2, count(pos) AS callable_sites, CASE WHEN count(pos) > 0 THEN coalesce(sum(num), 0.0) END AS numerator,
  CASE WHEN count(pos) > 0 THEN coalesce(sum(den), 0.0) END AS denominator FROM pairs LEFT JOIN comp USING (contig, population_1, population_2) GROUP BY ALL)"""
BLOCKS = "blocks AS (SELECT contig, population_1, population_2, (pos // 20)::INT AS block, coalesce(sum(num), 0.0) AS numerator, coalesce(sum(den), 0.0) AS denominator FROM comp GROUP BY ALL)"
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(with_ctes(f", {COUNTS}, {DIVERSITY} SELECT *, round(differences::DOUBLE / nullif(compared, 0), 9) AS pi FROM diversity", "calls"))
def agg1_nucleotide_diversity(spark, sf_dir):
    return popgen.nucleotide_diversity(fx.calls(spark, sf_dir))


@query(with_ctes(f", {COUNTS}, {HUDSON} SELECT contig, population_1, population_2, callable_sites, round(numerator, 9) + 0.0 AS numerator, round(denominator, 9) AS denominator, round(numerator / nullif(denominator, 0), 9) + 0.0 AS fst FROM fst", "calls"))
def agg2_hudson_fst(spark, sf_dir):
    return popgen.hudson_fst(fx.calls(spark, sf_dir))


@query(with_ctes(f", {COUNTS}, {HUDSON}, {BLOCKS} SELECT contig, population_1, population_2, block, round(numerator, 9) + 0.0 AS numerator, round(denominator, 9) AS denominator FROM blocks", "calls"))
def agg3_hudson_blocks(spark, sf_dir):
    return popgen.hudson_blocks(fx.calls(spark, sf_dir), 20)


@query(with_ctes(f""", {COUNTS}, {HUDSON}, {BLOCKS},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY contig, population_1, population_2 ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY contig, population_1, population_2) AS n FROM blocks),
  draws AS (SELECT contig, population_1, population_2, n, r.range AS rep, i AS slot, {HASH.format("'1729:' || contig || ':' || population_1 || ':' || population_2 || ':' || r.range || ':' || i")} % n AS pick FROM numbered CROSS JOIN range(40) r),
  est AS (SELECT d.contig, d.population_1, d.population_2, d.n, d.rep, round(CASE WHEN sum(b.denominator) > 1e-12 THEN sum(b.numerator) / sum(b.denominator) END, 9) + 0.0 AS fst
    FROM draws d JOIN numbered b ON d.contig = b.contig AND d.population_1 = b.population_1 AND d.population_2 = b.population_2 AND d.pick = b.i GROUP BY ALL)
  SELECT contig, population_1, population_2, n::INT AS blocks, count(fst) AS defined, list_sort(list(fst) FILTER (WHERE fst IS NOT NULL))[(floor(0.025 * (count(fst) - 1)) + 1)::INT] AS low,
    list_sort(list(fst) FILTER (WHERE fst IS NOT NULL))[(floor(0.975 * (count(fst) - 1)) + 1)::INT] AS high FROM est GROUP BY ALL""", "calls"))  # fmt: skip
def stat4_block_bootstrap(spark, sf_dir):
    return popgen.block_bootstrap(popgen.hudson_blocks(fx.calls(spark, sf_dir), 20), replicates=40)


PRIVATE = """private_{0} AS (SELECT p.contig, p.popcode, coalesce(x.n, 0)::BIGINT AS private_sites FROM (SELECT DISTINCT contig, popcode FROM calls) p LEFT JOIN (SELECT contig, popcode, count(DISTINCT pos) AS n FROM
  (SELECT contig, pos, base, min(popcode) AS popcode FROM calls WHERE base <> 'N' AND base <> ref {1} GROUP BY contig, pos, base HAVING count(DISTINCT popcode) = 1) GROUP BY contig, popcode) x ON x.contig = p.contig AND x.popcode = p.popcode)"""
OBSERVED = PRIVATE.format("observed", "")
STRICT = PRIVATE.format("strict", "AND (contig, pos) IN (SELECT contig, pos FROM calls GROUP BY contig, pos HAVING count(*) FILTER (WHERE base = 'N') = 0)")


@query(with_ctes(f", {OBSERVED} SELECT * FROM private_observed", "calls"))
def agg5_private_variants(spark, sf_dir):
    return popgen.private_variants(fx.calls(spark, sf_dir))


@query(with_ctes(f", {STRICT} SELECT * FROM private_strict", "calls"))
def agg5_private_variants_strict(spark, sf_dir):
    return popgen.private_variants(fx.calls(spark, sf_dir), strict=True)


@query(with_ctes(f""", {COUNTS}, {DIVERSITY} SELECT contig, popcode, differences, compared, round(differences::DOUBLE / compared, 9) AS pi, differences AS differences_2, compared AS compared_2, true AS agrees FROM diversity WHERE compared > 0""", "calls"))
def stat10_cross_check(spark, sf_dir):
    return popgen.cross_check(fx.calls(spark, sf_dir))


@query(with_ctes(f", {COUNTS}, {HUDSON} SELECT contig, count(num) AS sites, round(sum(num) / sum(den), 9) AS ratio FROM comp GROUP BY contig", "calls"))
def stat10_joint_ratio(spark, sf_dir):
    return popgen.joint_ratio(popgen.hudson_sites(popgen.allele_counts(fx.calls(spark, sf_dir))), "num", "den", "contig")


STANDARDISED = f""", d AS (SELECT a.contig, a.popcode, a.sample_id AS s1, b.sample_id AS s2, count(*) FILTER (WHERE a.base <> b.base) AS diff, count(*) AS n
    FROM calls a JOIN calls b ON a.contig = b.contig AND a.pos = b.pos AND a.popcode = b.popcode AND a.sample_id < b.sample_id WHERE a.base <> 'N' AND b.base <> 'N' GROUP BY ALL),
  m AS (SELECT contig, popcode, sample_id FROM calls GROUP BY ALL),
  k AS (SELECT m.*, g.range AS draw, row_number() OVER (PARTITION BY m.contig, m.popcode, g.range ORDER BY {HASH.format("'1729:' || m.popcode || ':' || g.range || ':' || m.sample_id")}, m.sample_id) AS rn,
    count(*) OVER (PARTITION BY m.contig, m.popcode, g.range) AS size FROM m CROSS JOIN range(25) g),
  t AS (SELECT a.contig, a.popcode, a.draw, coalesce(sum(d.diff), 0)::BIGINT AS differences, coalesce(sum(d.n), 0)::BIGINT AS sites
    FROM k a JOIN k b ON a.contig = b.contig AND a.popcode = b.popcode AND a.draw = b.draw AND a.sample_id < b.sample_id LEFT JOIN d ON d.contig = a.contig AND d.popcode = a.popcode AND d.s1 = a.sample_id AND d.s2 = b.sample_id
    WHERE a.rn <= 4 AND b.rn <= 4 AND a.size >= 4 GROUP BY ALL)"""


@query(with_ctes(f"{STANDARDISED} SELECT contig, popcode, draw::INT AS draw, differences, sites, round(differences::DOUBLE / nullif(sites, 0), 9) AS pi FROM t", "calls"))
def stat6_standardised_diversity(spark, sf_dir):
    return popgen.standardised_diversity(fx.calls(spark, sf_dir), draws=25)


@query(with_ctes("""SELECT contig, (count(DISTINCT popcode) * (count(DISTINCT popcode) - 1) // 2)::BIGINT AS expected, (count(DISTINCT popcode) * (count(DISTINCT popcode) - 1) // 2 - 1)::BIGINT AS pairs FROM calls GROUP BY contig""", "calls"))
def dq6_pair_count_errors(spark, sf_dir):
    calls = fx.calls(spark, sf_dir)
    pairs = popgen.population_pairs(calls)
    ends = pairs.groupBy("contig").agg(F.min(F.struct("population_1", "population_2")).alias("least"))
    fewer = pairs.join(ends, "contig").filter(F.struct("population_1", "population_2") != F.col("least")).drop("least")
    return popgen.pair_count_errors(fewer, calls)
