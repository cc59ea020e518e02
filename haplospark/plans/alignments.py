"""Queries over calls and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..catalog import query
from ..fixtures import with_ctes
from ..functions.columns import is_callable
from ..operators import calls as ops
from ..operators import distance

CALLABLE = "base IN ('A','C','G','T')"
ALIGNMENT = "alignment AS (SELECT contig, sample_id, string_agg(base, '' ORDER BY pos) AS seq FROM calls GROUP BY contig, sample_id)"
DISTANCES = """distances AS (SELECT a.contig, a.sample_id AS sample_1, b.sample_id AS sample_2, count(*) FILTER (WHERE a.base <> b.base) AS differences, count(*) AS sites_compared
  FROM calls a JOIN calls b ON a.contig = b.contig AND a.pos = b.pos AND a.sample_id < b.sample_id WHERE a.base <> 'N' AND b.base <> 'N' GROUP BY ALL)"""


def _alignment(spark, sf_dir):
    return ops.collapse_calls(fx.calls(spark, sf_dir))


@query(with_ctes("SELECT contig, sample_id, (row_number() OVER (PARTITION BY contig, sample_id ORDER BY pos) - 1)::INT AS pos, base FROM calls", "calls"))
def src2_explode_alignment(spark, sf_dir):
    return ops.explode_alignment(_alignment(spark, sf_dir))


@query(with_ctes("SELECT contig, sample_id, string_agg(base, '' ORDER BY pos) AS seq FROM calls GROUP BY contig, sample_id", "calls"))
def src1_alignment_sequences(spark, sf_dir):
    return _alignment(spark, sf_dir)


@query(with_ctes(", m AS (SELECT DISTINCT unnest(range(start, \"end\")) AS pos FROM intervals WHERE name = '1-URGENT') SELECT contig, sample_id, string_agg(base, '' ORDER BY pos) AS seq FROM calls WHERE pos IN (SELECT pos FROM m) GROUP BY contig, sample_id", "calls", "intervals"))
def prj7_restrict_to_mask(spark, sf_dir):
    mask = fx.intervals(spark, sf_dir).filter("name = '1-URGENT'")
    return ops.collapse_calls(ops.restrict_to_mask(fx.calls(spark, sf_dir), mask))


@query(with_ctes(f", {ALIGNMENT} SELECT contig, sample_id, substr(seq, 1, 100) AS kept, substr(seq, 101) AS removed, length(seq) < 100 AS too_short FROM alignment", "calls"))
def prj8_trim_sequence(spark, sf_dir):
    return ops.trim_sequence(_alignment(spark, sf_dir), 100)


@query(with_ctes(f"""SELECT contig, count(*) AS span, count(*) FILTER (WHERE called >= 1) AS at_least_one, count(*) FILTER (WHERE called >= 2) AS at_least_two, count(*) FILTER (WHERE called = n) AS joint
  FROM (SELECT contig, pos, count(*) AS n, count(*) FILTER (WHERE {CALLABLE}) AS called FROM calls GROUP BY contig, pos) GROUP BY contig""", "calls"))  # fmt: skip
def agg7_site_callability(spark, sf_dir):
    return ops.site_callability(fx.calls(spark, sf_dir))


SITES = """sites AS (SELECT contig, pos, count(*) AS alleles, count(*) FILTER (WHERE n >= 2) AS common FROM
  (SELECT contig, pos, base, count(*) AS n FROM calls WHERE base <> 'N' GROUP BY ALL) GROUP BY contig, pos)"""


@query(with_ctes(f", {SITES} SELECT contig, count(*) FILTER (WHERE alleles > 1) AS variable, count(*) FILTER (WHERE common >= 2) AS informative FROM sites GROUP BY contig", "calls"))
def agg8_site_counts(spark, sf_dir):
    return ops.site_counts(fx.calls(spark, sf_dir))


@query(with_ctes(f", {SITES} SELECT contig, pos, alleles, common FROM sites WHERE alleles > 1", "calls"))
def agg8_variable_sites(spark, sf_dir):
    return ops.variable_sites(fx.calls(spark, sf_dir))


@query(with_ctes(f""", {SITES}, c AS (SELECT contig, count(*) AS span, count(*) FILTER (WHERE called >= 2) AS at_least_two, count(*) FILTER (WHERE called = n) AS joint
  FROM (SELECT contig, pos, count(*) AS n, count(*) FILTER (WHERE {CALLABLE}) AS called FROM calls GROUP BY contig, pos) GROUP BY contig),
  v AS (SELECT contig, count(*) FILTER (WHERE alleles > 1) AS variable, count(*) FILTER (WHERE common >= 2) AS informative FROM sites GROUP BY contig)
  SELECT contig, """ + ", ".join(f"{c}, round({c}::DOUBLE / nullif(sum({c}) OVER (), 0)::DOUBLE, 9) AS {c}_share" for c in ("span", "at_least_two", "joint", "variable", "informative")) + " FROM c LEFT JOIN v USING (contig)", "calls"))  # fmt: skip
def agg9_partition_contribution(spark, sf_dir):
    return ops.partition_contribution(fx.calls(spark, sf_dir))


@query(with_ctes(f"""SELECT contig, sample_id, count(*) FILTER (WHERE {CALLABLE}) AS callable, count(*) FILTER (WHERE base = ref) AS matches, count(*) FILTER (WHERE {CALLABLE} AND base <> ref) AS differences,
  round(count(*) FILTER (WHERE base = ref)::DOUBLE / nullif(count(*) FILTER (WHERE {CALLABLE}), 0), 9) AS identity FROM calls GROUP BY contig, sample_id""", "calls"))  # fmt: skip
def agg13_reference_concordance(spark, sf_dir):
    return ops.reference_concordance(fx.calls(spark, sf_dir))


@query(with_ctes(f", {ALIGNMENT} SELECT a.sample_id, a.seq || b.seq AS seq, length(a.seq)::INT AS first_end, length(a.seq || b.seq)::INT AS second_end FROM alignment a JOIN alignment b USING (sample_id) WHERE a.contig = 'c1' AND b.contig = 'c2'", "calls"))
def snk5_concat_partitions(spark, sf_dir):
    a = _alignment(spark, sf_dir)
    return ops.concat_partitions(a.filter("contig = 'c1'"), a.filter("contig = 'c2'"))


@query(with_ctes(f", {ALIGNMENT}, cut AS (SELECT contig, CASE WHEN sample_id % 9 = 0 AND contig = 'c1' THEN substr(seq, 2) ELSE seq END AS seq FROM alignment) SELECT contig, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest, count(*) FILTER (WHERE seq = '') AS empty, count(*) FILTER (WHERE regexp_matches(seq, '[^ACGTN]')) AS bad_letters FROM cut GROUP BY contig HAVING min(length(seq)) <> max(length(seq))", "calls"))
def dq5_alignment_errors(spark, sf_dir):
    cut = F.when((F.col("sample_id") % 9 == 0) & (F.col("contig") == "c1"), F.substring("seq", 2, 1000)).otherwise(F.col("seq"))
    return ops.alignment_errors(_alignment(spark, sf_dir).withColumn("seq", cut))


@query(with_ctes(f", {DISTANCES} SELECT contig, sample_1, sample_2, differences, sites_compared, round(differences::DOUBLE / sites_compared, 9) AS p_distance FROM distances", "calls"))
def jn3_pairwise_distance(spark, sf_dir):
    return distance.pairwise_distance(fx.calls(spark, sf_dir))


@query(with_ctes("SELECT a.taxon, a.sample_id AS a_sample_id, b.sample_id AS b_sample_id FROM samples a JOIN samples b ON a.taxon = b.taxon AND a.sample_id < b.sample_id", "samples"))
def jn2_all_pairs(spark, sf_dir):
    return distance.all_pairs(fx.samples(spark, sf_dir).select("taxon", "sample_id"), "sample_id", "taxon")


@query(with_ctes(f", {DISTANCES} SELECT contig, count(*) AS pairs, min(differences) AS least, round(median(differences), 9) AS median, max(differences) AS largest FROM distances GROUP BY contig", "calls"))
def agg23_distance_summary(spark, sf_dir):
    return distance.calls_summary(fx.calls(spark, sf_dir))


POPULATIONS = ("NATION_1", "NATION_3", "NATION_5", "NATION_7", "NATION_9")
REGION_CALLS = "region_calls AS (SELECT * FROM calls WHERE popcode IN ('NATION_1','NATION_3','NATION_5','NATION_7','NATION_9'))"
PAIR_VALUE = "SELECT a.contig, a.popcode AS r, b.popcode AS c, count(*) AS v FROM region_calls a JOIN region_calls b ON a.contig = b.contig AND a.pos = b.pos AND a.sample_id < b.sample_id AND a.popcode <> b.popcode AND a.base <> 'N' AND b.base <> 'N' AND a.base <> b.base GROUP BY ALL"


@query(with_ctes(f""", {REGION_CALLS}, p AS (SELECT contig, least(r, c) AS r, greatest(r, c) AS c, sum(v)::BIGINT AS v FROM ({PAIR_VALUE}) GROUP BY ALL), b AS (SELECT contig, r, c, v FROM p UNION ALL SELECT contig, c, r, v FROM p)
  SELECT contig, r AS "row", """ + ", ".join(f"CASE WHEN r = '{p}' THEN 0 ELSE max(v) FILTER (WHERE c = '{p}') END::BIGINT AS \"{p}\"" for p in POPULATIONS) + " FROM b GROUP BY contig, r", "calls"))  # fmt: skip
def snk2_distance_matrix(spark, sf_dir):
    calls = fx.calls(spark, sf_dir).filter(F.col("popcode").isin(*POPULATIONS))
    pops = calls.select(F.col("sample_id"), "popcode").distinct()
    pairs = distance.pairwise_distance(calls)
    pairs = pairs.join(F.broadcast(pops.withColumnsRenamed({"sample_id": "sample_1", "popcode": "p1"})), "sample_1").join(F.broadcast(pops.withColumnsRenamed({"sample_id": "sample_2", "popcode": "p2"})), "sample_2").filter("p1 <> p2 and differences > 0")
    sums = pairs.groupBy("contig", F.least("p1", "p2").alias("sample_1"), F.greatest("p1", "p2").alias("sample_2")).agg(F.sum("differences").alias("v"))
    return distance.distance_matrix(sums, "v", list(POPULATIONS), 0)


@query(with_ctes(f""", {DISTANCES}, bad AS (SELECT contig, sample_1, sample_2, CASE WHEN (sample_1 + sample_2) % 50 = 0 THEN sites_compared + 1 ELSE differences END AS differences, sites_compared FROM distances)
  SELECT 'more_differences_than_sites' AS "check", contig, sample_1, sample_2 FROM bad WHERE differences > sites_compared""", "calls"))  # fmt: skip
def dq1_distance_errors(spark, sf_dir):
    d = distance.pairwise_distance(fx.calls(spark, sf_dir))
    d = d.withColumn("differences", F.when((F.col("sample_1") + F.col("sample_2")) % 50 == 0, F.col("sites_compared") + 1).otherwise(F.col("differences")))
    d = d.withColumn("p_distance", F.try_divide(F.col("differences").cast("double"), F.col("sites_compared").cast("double")))
    return distance.distance_errors(d)


@query(with_ctes("SELECT contig, sample_id, pos, base IN ('A', 'C', 'G', 'T') AS callable FROM calls", "calls"))
def prj6_is_callable(spark, sf_dir):
    return fx.calls(spark, sf_dir).select("contig", "sample_id", "pos", is_callable(F.col("base")).alias("callable"))
