"""The scenario pipeline as one plan: a scenario is a key column, so evidence is scanned once for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..catalog import query
from ..fixtures import with_ctes
from ..functions.lineage import cut
from ..operators import evidence as ev
from ..operators import haplotypes as hap
from ..operators import popgen
from ..operators import resampling as rs
from ..operators import scenarios as sc
from ..operators import sensitivity as ops
from .haplotypes import CHECKED, INPUTS, LABELS, MARKERS, checked_pca
from .haplotypes import TABLE as HAPLOTYPES
from .populations import COUNTS, DIVERSITY, HUDSON

#: name -> (depth, breadth at that depth, support fraction): the three scenarios of the fixtures.
SCENARIOS = {"baseline": (1, 0.95, 0.6), "middle": (2, 0.75, 0.6), "strict": (3, 0.58, 0.6)}


def scenario_calls(depth: DataFrame, calls: DataFrame, scenarios: dict[str, tuple[int, float, float]] = SCENARIOS) -> DataFrame:
    """Calls of every scenario: samples with enough breadth, positions with enough support among those, bases with enough depth.

    depth (contig, sample_id, pos, depth); calls (..., depth, base). The scenario's limits travel as columns.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(d).alias("least_depth"), F.lit(b).alias("breadth"), F.lit(s).alias("support")) for n, (d, b, s) in scenarios.items()])
    summary = depth.groupBy("contig", "sample_id").agg(*[F.avg((F.col("depth") >= d).cast("double")).alias(f"b{d}") for d in sorted({d for d, *_ in scenarios.values()})])
    breadth = F.coalesce(*[F.when(F.col("s.least_depth") == d, F.col(f"b{d}")) for d in sorted({d for d, *_ in scenarios.values()})])
    eligible = summary.withColumn("s", F.explode(rows)).filter(breadth >= F.col("s.breadth")).select("s.scenario", "contig", "sample_id", "s.least_depth", "s.support")
    own = calls.join(eligible, ["contig", "sample_id"])
    support = own.groupBy("scenario", "contig", "pos").agg((F.count_if(F.col("depth") >= F.col("least_depth")) >= F.count(F.lit(1)) * F.max("support")).alias("good")).filter("good")
    own = own.join(support.select("scenario", "contig", "pos"), ["scenario", "contig", "pos"], "left_semi")
    return own.withColumn("base", F.when(F.col("depth") >= F.col("least_depth"), F.col("base")).otherwise("N")).drop("least_depth", "support")


def by_scenario(calls: DataFrame) -> DataFrame:
    """Scenario calls with scenario and contig in one key, as population operators group by contig."""
    return calls.withColumn("contig", F.concat_ws("|", "scenario", "contig")).drop("scenario")


def split_key(df: DataFrame) -> DataFrame:
    return df.withColumn("scenario", F.split_part("contig", F.lit("|"), F.lit(1))).withColumn("contig", F.split_part("contig", F.lit("|"), F.lit(2)))


def _scenario_calls(spark, sf_dir):
    return scenario_calls(fx.depth(spark, sf_dir), fx.calls(spark, sf_dir))


BREADTH = """scen AS (SELECT * FROM (VALUES ('baseline', 1, 0.95::DOUBLE, 0.6::DOUBLE), ('middle', 2, 0.75, 0.6), ('strict', 3, 0.58, 0.6)) s(scenario, d, b, f)),
elig AS (SELECT s.scenario, x.contig, x.sample_id, s.d, s.f FROM scen s JOIN depth x ON true GROUP BY ALL HAVING avg((x.depth >= s.d)::INT) >= any_value(s.b)),
own AS (SELECT e.scenario, e.d, e.f, c.* FROM calls c JOIN elig e USING (contig, sample_id)),
good AS (SELECT scenario, contig, pos FROM own GROUP BY ALL HAVING count(*) FILTER (WHERE depth >= d) >= count(*) * max(f)),
kept AS (SELECT scenario, contig, sample_id, popcode, taxon, pos, depth, ref, CASE WHEN depth >= d THEN base ELSE 'N' END AS base FROM own SEMI JOIN good USING (scenario, contig, pos))"""


@query(with_ctes(f", {BREADTH} SELECT scenario, contig, sample_id, pos, base FROM kept", "depth", "calls"))
def stat13_scenario_calls(spark, sf_dir):
    return _scenario_calls(spark, sf_dir).select("scenario", "contig", "sample_id", "pos", "base")


KEYED = f"{BREADTH}, keyed AS (SELECT * REPLACE (scenario || '|' || contig AS contig) FROM kept)"
S_DIV = COUNTS.replace("FROM calls", "FROM keyed") + ", " + DIVERSITY
PI = "pi AS (SELECT split_part(contig, '|', 1) AS scenario, split_part(contig, '|', 2) AS contig, popcode, samples, joint_sites, round(differences::DOUBLE / nullif(compared, 0), 9) AS pi FROM diversity)"
FST = "fs AS (SELECT split_part(contig, '|', 1) AS scenario, split_part(contig, '|', 2) AS contig, population_1, population_2, callable_sites, round(numerator / nullif(denominator, 0), 9) + 0.0 AS fst FROM fst)"


def _pi(spark, sf_dir):
    d = popgen.nucleotide_diversity(by_scenario(_scenario_calls(spark, sf_dir)))
    return split_key(d).select("scenario", "contig", "popcode", "samples", "joint_sites", F.round("pi", 9).alias("pi"))


def _fst(spark, sf_dir):
    d = popgen.hudson_fst(by_scenario(_scenario_calls(spark, sf_dir)))
    return split_key(d).select("scenario", "contig", "population_1", "population_2", "callable_sites", (F.round("fst", 9) + F.lit(0.0)).alias("fst"))


@query(with_ctes(f", {KEYED}, {S_DIV}, {PI} SELECT * FROM pi", "depth", "calls"))
def stat13_scenario_diversity(spark, sf_dir):
    return _pi(spark, sf_dir)


@query(with_ctes(f", {KEYED}, {S_DIV}, {HUDSON}, {FST} SELECT * FROM fs", "depth", "calls"))
def stat13_scenario_fst(spark, sf_dir):
    return _fst(spark, sf_dir)


@query(with_ctes(f", {KEYED}, {LABELS.replace('FROM calls', 'FROM keyed')}, {HAPLOTYPES} SELECT split_part(contig, '|', 1) AS scenario, split_part(contig, '|', 2) AS contig, haplotype, haplotype_seq, samples, populations FROM haps", "depth", "calls"))
def stat13_scenario_haplotypes(spark, sf_dir):
    return split_key(hap.haplotypes(hap.haplotype_labels(by_scenario(_scenario_calls(spark, sf_dir)))))


#: The scenarios of the filtered runs: three whole ones, and two that change only the support of the mask, on one contig.
FILTERED = [
    sc.Scenario("baseline", 1, 10, 0.9, 0.6, 0.5),
    sc.Scenario("middle", 2, 15, 0.7, 0.55, 0.5),
    sc.Scenario("strict", 3, 20, 0.5, 0.5, 0.5),
    sc.Scenario("mask70", 2, 15, 0.0, 0.7, 0.5, "baseline", ("c1",)),
    sc.Scenario("mask80", 2, 15, 0.0, 0.8, 0.5, "baseline", ("c1",)),
]
FILTERED_SQL = """scen AS (SELECT * FROM (VALUES ('baseline', 1, 10, 1, 0.9::DOUBLE, 0.6::DOUBLE, 0.5::DOUBLE, NULL), ('middle', 2, 15, 2, 0.7, 0.55, 0.5, NULL), ('strict', 3, 20, 3, 0.5, 0.5, 0.5, NULL), ('mask70', 2, 15, 1, 0.9, 0.7, 0.5, 'c1'), ('mask80', 2, 15, 1, 0.9, 0.8, 0.5, 'c1')) s(scenario, d, q, bd, b, f, mm, only_contig)),
elig AS (SELECT s.scenario, g.contig, g.sample_id FROM scen s JOIN genotypes g ON s.only_contig IS NULL OR s.only_contig = g.contig GROUP BY s.scenario, g.contig, g.sample_id, s.bd, s.b HAVING avg((g.dp >= s.bd)::INT) >= s.b),
own AS (SELECT s.*, g.* FROM genotypes g JOIN elig e USING (contig, sample_id) JOIN scen s ON s.scenario = e.scenario),
good AS (SELECT scenario, contig, pos FROM own GROUP BY scenario, contig, pos, f HAVING count(*) FILTER (WHERE dp >= d) >= ceil(count(*) * f)),
runs AS (SELECT scenario, contig, min(pos) AS start, max(pos) + 1 AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY scenario, contig ORDER BY pos) AS run FROM good) GROUP BY scenario, contig, run),
islands AS (SELECT * FROM runs WHERE "end" - start >= 50),
inside AS (SELECT o.* FROM own o JOIN islands i ON o.scenario = i.scenario AND o.contig = i.contig AND o.pos >= i.start AND o.pos < i."end"),
passed AS (SELECT *, dp >= d AND gq >= q AND base <> 'N' AS pass FROM inside),
sites AS (SELECT scenario, contig, pos, any_value(mm) AS mm, max(qual) AS best, count(*) AS n, count(gt) FILTER (WHERE pass) AS called, coalesce(sum(gt) FILTER (WHERE pass), 0) AS alt FROM passed GROUP BY ALL),
layers AS (SELECT *, best >= 30 AND (n - called)::DOUBLE / n <= mm AS ok FROM sites),
keyed AS (SELECT p.scenario || '|' || p.contig AS contig, p.sample_id, p.popcode, p.pos, CASE WHEN p.pass AND (p.base = p.ref OR (l.ok AND l.alt >= 1)) THEN p.base ELSE 'N' END AS base FROM passed p JOIN layers l USING (scenario, contig, pos)),
genotyped AS (SELECT p.scenario || '|' || p.contig AS contig, p.sample_id, p.pos, CASE WHEN p.pass THEN p.gt END AS g FROM passed p JOIN layers l USING (scenario, contig, pos) WHERE l.ok AND l.alt BETWEEN 2 AND l.called - 2)"""
NAMED = "split_part(contig, '|', 1) AS scenario, split_part(contig, '|', 2) AS contig"


def _filtered(spark, sf_dir):
    return sc.scenario_evidence(fx.genotypes(spark, sf_dir), FILTERED)


@query(with_ctes(f', {FILTERED_SQL} SELECT scenario, contig, start, "end" FROM islands', "genotypes"))
def stat13_scenario_islands(spark, sf_dir):
    """Islands of at least 50 supported positions of each scenario, mask-only ones among them."""
    g = fx.genotypes(spark, sf_dir)
    found = sc.scenario_islands(g.join(sc.eligible_samples(g, FILTERED), ["contig", "sample_id"]), FILTERED)
    names = F.array(*[F.lit(s.name) for s in FILTERED])
    return found.select(F.element_at(names, F.col("scenario") + 1).alias("scenario"), "contig", "start", "end")


@query(with_ctes(f", {FILTERED_SQL}, {S_DIV} SELECT {NAMED}, popcode, samples, joint_sites, round(differences::DOUBLE / nullif(compared, 0), 9) AS pi FROM diversity", "genotypes"))
def stat13_filtered_diversity(spark, sf_dir):
    d = popgen.diversity_of_counts(sc.scenario_counts(_filtered(spark, sf_dir), FILTERED))
    return split_key(d).select("scenario", "contig", "popcode", "samples", "joint_sites", "pi")


SCENARIO_INPUTS = INPUTS.replace(MARKERS, "markers AS (SELECT contig, sample_id, pos, g FROM genotyped)")


@query(with_ctes(f", {FILTERED_SQL}, {SCENARIO_INPUTS} SELECT {NAMED}, pos, sample_id, round(z, 9) + 0.0 AS z FROM inputs", "genotypes"))
def stat13_scenario_pca_inputs(spark, sf_dir):
    """Standardised genotypes at each scenario's sites with either allele twice."""
    return split_key(rs.pca_inputs(sc.scenario_markers(_filtered(spark, sf_dir), FILTERED))).select("scenario", "contig", "pos", "sample_id", "z")


@query(with_ctes(f", {FILTERED_SQL}, {SCENARIO_INPUTS}, sizes AS (SELECT contig FROM inputs GROUP BY contig HAVING least(count(DISTINCT sample_id) - 1, count(DISTINCT pos)) >= 2), checked AS ({CHECKED.replace('FROM inputs', 'FROM inputs SEMI JOIN sizes USING (contig)')}) SELECT * REPLACE (split_part(contig, '|', 2) AS contig), split_part(contig, '|', 1) AS scenario FROM checked", "genotypes"))
def stat13_scenario_pca_checks(spark, sf_dir):
    """The ordination of each scenario, by what any correct one meets; scenarios without two components have none."""
    inputs = rs.pca_inputs(sc.scenario_markers(_filtered(spark, sf_dir), FILTERED))
    sizes = inputs.groupBy("contig").agg(F.least(F.count_distinct("sample_id") - 1, F.count_distinct("pos")).alias("n")).filter("n >= 2")
    return split_key(checked_pca(cut(inputs.join(sizes, "contig", "left_semi"))))


def _pairs(df, value, *key):
    base = df.filter("scenario = 'baseline'").drop("scenario")
    other = df.filter("scenario <> 'baseline'")
    return ops.compare(base, other.withColumnRenamed("scenario", "s"), value, *key)


PI_PAIRS = "pp AS (SELECT o.scenario, o.contig, o.popcode AS k, b.pi AS x, o.pi AS y FROM pi b JOIN pi o USING (contig, popcode) WHERE b.scenario = 'baseline' AND o.scenario <> 'baseline' AND b.pi IS NOT NULL AND o.pi IS NOT NULL)"
FST_PAIRS = "pp AS (SELECT o.scenario, o.contig, o.population_1 || '/' || o.population_2 AS k, b.fst AS x, o.fst AS y FROM fs b JOIN fs o USING (contig, population_1, population_2) WHERE b.scenario = 'baseline' AND o.scenario <> 'baseline' AND b.fst IS NOT NULL AND o.fst IS NOT NULL)"
RHO = """rk AS (SELECT *, rank() OVER (PARTITION BY scenario, contig ORDER BY x) + (count(*) OVER (PARTITION BY scenario, contig, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY scenario, contig ORDER BY y) + (count(*) OVER (PARTITION BY scenario, contig, y) - 1) / 2.0::DOUBLE AS ry FROM pp),
rho AS (SELECT scenario, contig, CASE WHEN count(*) >= 2 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 9) END AS rho FROM rk GROUP BY ALL)"""


def _compared(spark, sf_dir, pi: bool):
    """scenario, contig, k, baseline, scenario value as baseline and scenario."""
    df = _pi(spark, sf_dir).withColumn("k", F.col("popcode")) if pi else _fst(spark, sf_dir).withColumn("k", F.concat_ws("/", "population_1", "population_2"))
    value = "pi" if pi else "fst"
    base = df.filter("scenario = 'baseline'").select("contig", "k", F.col(value).alias("v"))
    other = df.filter("scenario <> 'baseline'").select(F.col("scenario").alias("name"), "contig", "k", F.col(value).alias("v"))
    names = other.select("name").distinct()
    left = base.join(names.withColumn("one", F.lit(1)), F.col("one") == F.lit(1)).select("name", "contig", "k", "v")
    return ops.compare(left, other, "v", "name", "contig", "k")


@query(with_ctes(f", {KEYED}, {S_DIV}, {PI}, {PI_PAIRS} SELECT scenario AS name, contig, k, x AS baseline, y AS scenario FROM pp", "depth", "calls"))
def jn10_scenario_compare(spark, sf_dir):
    return _compared(spark, sf_dir, True)


@query(with_ctes(f""", {KEYED}, {S_DIV}, {PI}, {PI_PAIRS}, {RHO} SELECT scenario AS name, contig, count(*) AS common, round(median(abs(y - x) / abs(x)) FILTER (WHERE x <> 0), 9) AS median_change, round(max(abs(y - x) / abs(x)) FILTER (WHERE x <> 0), 9) AS max_change,
  count(*) FILTER (WHERE x = 0 AND y <> 0) AS from_zero, count(*) FILTER (WHERE x <> 0 AND y = 0) AS to_zero, any_value(rho) AS rho FROM pp LEFT JOIN rho USING (scenario, contig) GROUP BY scenario, contig""", "depth", "calls"))  # fmt: skip
def agg26_pi_comparison(spark, sf_dir):
    return ops.pi_comparison(_compared(spark, sf_dir, True), "name", "contig")


@query(with_ctes(f""", {KEYED}, {S_DIV}, {HUDSON}, {FST}, {FST_PAIRS}, {RHO}, s AS (SELECT scenario AS name, contig, count(*) AS common, round(median(abs(y - x)), 9) AS median_change, round(max(abs(y - x)), 9) AS max_change, any_value(rho) AS rho FROM pp LEFT JOIN rho USING (scenario, contig) GROUP BY scenario, contig)
  SELECT *, CASE WHEN rho >= 0.95 AND median_change <= 0.05 THEN 'PASS' WHEN rho >= 0.9 AND median_change <= 0.1 THEN 'CAVEAT' ELSE 'FAIL' END AS "class" FROM s""", "depth", "calls"))  # fmt: skip
def agg27_fst_sensitivity(spark, sf_dir):
    s = ops.fst_comparison(_compared(spark, sf_dir, False), "name", "contig")
    return s.withColumn("class", ops.classify_fst(F.col("rho"), F.col("median_change")))


@query(with_ctes(f""", {KEYED}, {S_DIV}, {PI}, {PI_PAIRS}, {RHO}, s AS (SELECT scenario AS name, contig, any_value(rho) AS rho, round(median(abs(y - x) / abs(x)) FILTER (WHERE x <> 0), 9) AS median_change FROM pp LEFT JOIN rho USING (scenario, contig) GROUP BY scenario, contig)
  SELECT *, CASE WHEN rho >= 0.95 AND median_change <= 0.1 THEN 'PASS' WHEN rho >= 0.9 AND median_change <= 0.25 THEN 'CAVEAT' ELSE 'FAIL' END AS "class" FROM s""", "depth", "calls"))  # fmt: skip
def prj15_classify_pi(spark, sf_dir):
    s = ops.pi_comparison(_compared(spark, sf_dir, True), "name", "contig").select("name", "contig", "rho", F.round("median_change", 9).alias("median_change"))
    return s.withColumn("class", ops.classify_pi(F.col("rho"), F.col("median_change")))


EXTREMES = """ex AS (SELECT scenario AS name, contig, k, x AS baseline, y AS scenario, y - x AS change, {t} AS transition, round({s}, 12) AS size FROM pp WHERE abs(y - x) > 1e-12),
top AS (SELECT *, row_number() OVER (PARTITION BY name, contig ORDER BY transition DESC, size DESC, k)::INT AS "rank" FROM ex) SELECT name, contig, k, baseline, scenario, round(change, 9) + 0.0 AS change, transition, round(size, 9) AS size, "rank" FROM top WHERE "rank" <= 10"""


@query(with_ctes(f", {KEYED}, {S_DIV}, {PI}, {PI_PAIRS}, " + EXTREMES.format(t="((x = 0) <> (y = 0))::INT", s="CASE WHEN x <> 0 THEN abs(y - x) / abs(x) ELSE abs(y - x) END"), "depth", "calls"))
def top1_rank_extremes_pi(spark, sf_dir):
    return ops.rank_extremes(_compared(spark, sf_dir, True), "pi", 10, "k", "name", "contig")


@query(with_ctes(f", {KEYED}, {S_DIV}, {HUDSON}, {FST}, {FST_PAIRS}, " + EXTREMES.format(t="0", s="abs(y - x)"), "depth", "calls"))
def top1_rank_extremes_fst(spark, sf_dir):
    return ops.rank_extremes(_compared(spark, sf_dir, False), "fst", 10, "k", "name", "contig")


F_CTE = f", {COUNTS}, {HUDSON}, f AS (SELECT contig, population_1, population_2, round(numerator / nullif(denominator, 0), 9) + 0.0 AS fst FROM fst)"


def _plain_fst(spark, sf_dir):
    return popgen.hudson_fst(fx.calls(spark, sf_dir)).withColumn("fst", F.round("fst", 9) + F.lit(0.0))


@query(with_ctes(F_CTE + " SELECT a.population_1, a.population_2, a.fst AS fst_1, b.fst AS fst_2, a.fst IS NOT NULL AS defined_1, b.fst IS NOT NULL AS defined_2 FROM f a JOIN f b USING (population_1, population_2) WHERE a.contig = 'c1' AND b.contig = 'c2'", "calls"))
def jn11_cross_contig_agreement(spark, sf_dir):
    return ops.cross_contig_agreement(_plain_fst(spark, sf_dir), "c1", "c2")


@query(with_ctes(F_CTE + " SELECT contig, CASE WHEN max(abs(fst)) = 0 THEN 1.0 ELSE max(abs(fst)) END AS \"limit\" FROM f GROUP BY contig", "calls"))
def agg30_symmetric_limit(spark, sf_dir):
    return ops.symmetric_limit(_plain_fst(spark, sf_dir), "fst", "contig")


CLAIMS = "claims AS (SELECT o_orderpriority AS metric, CASE WHEN o_orderkey % 97 = 0 AND o_orderpriority <> '5-LOW' THEN 'FAIL' WHEN o_orderkey % 10 = 0 AND o_orderpriority <> '1-URGENT' THEN 'CAVEAT' ELSE 'PASS' END AS status FROM orders)"


@query(f"WITH {CLAIMS} SELECT metric, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'CAVEAT') THEN 'CAVEAT' ELSE 'PASS' END AS worst, count(*) FILTER (WHERE status = 'PASS') AS pass, count(*) FILTER (WHERE status = 'CAVEAT') AS caveat, count(*) FILTER (WHERE status = 'FAIL') AS fail FROM claims GROUP BY metric")
def agg28_claim_rollup(spark, sf_dir):
    o, k, p = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderpriority")
    return ops.claim_rollup(o.select(p.alias("metric"), F.when((k % 97 == 0) & (p != "5-LOW"), "FAIL").when((k % 10 == 0) & (p != "1-URGENT"), "CAVEAT").otherwise("PASS").alias("status")), "metric")


REPORTS = "rep AS (SELECT n_name AS contig, r.run, count(*)::DOUBLE / 100 AS resolved, sum(s_suppkey % 7 + r.i)::DOUBLE / 100 AS side, sum(s_suppkey % 5)::DOUBLE * (1 + r.i) / 100 AS centre FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (VALUES ('primary', 0), ('restricted', 1)) r(run, i) GROUP BY ALL, r.i)"


def _reports(spark, sf_dir):
    s, n = fx.table(spark, sf_dir, "supplier"), fx.table(spark, sf_dir, "nation")
    runs = F.explode(F.array(F.struct(F.lit("primary").alias("run"), F.lit(0).alias("i")), F.struct(F.lit("restricted").alias("run"), F.lit(1).alias("i")))).alias("r")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("contig"), "s_suppkey", runs)
    return rows.groupBy("contig", "r.run", "r.i").agg((F.count(F.lit(1)) / 100.0).alias("resolved"), (F.sum(F.col("s_suppkey") % 7 + F.col("r.i")) / 100.0).alias("side"), (F.sum(F.col("s_suppkey") % 5) * (1 + F.first("r.i")) / 100.0).alias("centre"))


@query("""WITH b AS (SELECT n_name AS contig, count(*)::DOUBLE AS n, sum(s_suppkey % 7)::DOUBLE AS s, sum(s_suppkey % 5)::DOUBLE AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT contig, 0.0::DOUBLE AS resolved_change, round((s + n) / 100 - s / 100, 9) AS side_change, round(c * 2 / 100 - c / 100, 9) AS centre_change FROM b""")  # fmt: skip
def agg31_report_delta(spark, sf_dir):
    return ops.report_delta(_reports(spark, sf_dir))


@query("""WITH b AS (SELECT n_name AS contig, sum(s_suppkey % 7)::DOUBLE / 100 AS side, sum(s_suppkey % 5)::DOUBLE / 100 AS centre FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT contig, CASE WHEN centre > 0.15 THEN 'insufficient' WHEN side > 0.2 AND contig LIKE '%1%' THEN 'network' ELSE 'tree_like' END AS decision FROM b""")  # fmt: skip
def prj16_likelihood_decision(spark, sf_dir):
    r = _reports(spark, sf_dir).filter("run = 'primary'")
    return r.select("contig", ops.likelihood_decision(F.col("centre"), F.col("side"), F.col("contig").contains("1")).alias("decision"))


CV = "cv AS (SELECT o_orderpriority AS grp, (1 + o_custkey % 6)::INT AS k, (1 + o_orderkey % 5)::INT AS replicate, round(avg(((o_custkey % 6) * 17 + (o_orderkey % 5) * 7 + o_orderkey % 3) % 40 / 100.0::DOUBLE), 9) AS cv FROM orders GROUP BY ALL)"


@query(f"""WITH {CV}, m AS (SELECT grp, k, round(avg(cv), 12) AS mean_cv, arg_min(replicate, (cv, replicate)) AS best_replicate FROM cv GROUP BY ALL)
  SELECT grp, arg_min(k, (mean_cv, k)) AS k, round(min(mean_cv), 9) AS mean_cv, arg_min(best_replicate, (mean_cv, k)) AS best_replicate, arg_min(k, (mean_cv, k)) IN (min(k), max(k)) AS at_boundary FROM m GROUP BY grp""")  # fmt: skip
def agg25_cv_select_k(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    cv = o.groupBy(F.col("o_orderpriority").alias("grp"), (1 + c % 6).cast("int").alias("k"), (1 + k % 5).cast("int").alias("replicate")).agg(F.round(F.avg(((c % 6) * 17 + (k % 5) * 7 + k % 3) % 40 / 100), 9).alias("cv"))
    return ops.cv_select_k(cv, "grp")


@query("""WITH s AS (SELECT sum(s_suppkey % 5)::DOUBLE / 1000 AS centre, count(*) AS n FROM supplier) SELECT * FROM (SELECT 'tree_signal' AS claim, CASE WHEN centre > 0.15 THEN 'FAIL' WHEN centre >= 0.14 OR n % 2 > 0 THEN 'CAVEAT' ELSE 'PASS' END AS status FROM s
  UNION ALL SELECT 'tree_agreement', CASE WHEN n > 0 THEN 'CAVEAT' ELSE 'PASS' END FROM s UNION ALL SELECT 'resampling', 'CAVEAT' UNION ALL SELECT 'other', 'PASS')""")  # fmt: skip
def prj22_resolve_claims(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").agg((F.sum(F.col("s_suppkey") % 5) / 1000).alias("centre"), F.count(F.lit(1)).alias("n"))
    likelihood = s.select(F.when(F.col("centre") > 0.15, "insufficient").otherwise("tree_like").alias("decision"), (F.col("n") % 2).alias("composition_failures"), "centre")
    claims = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("claim"), F.lit(x).alias("status")) for c, x in (("tree_signal", "PENDING"), ("tree_agreement", "PENDING"), ("resampling", "PENDING"), ("other", "PASS"))])).alias("c")).select("c.*")
    return ops.resolve_claims(claims, likelihood, s.select(F.col("n").alias("rf")), s.select((F.col("n") > 0).alias("on_top"), (F.col("n") < 0).alias("below")), s.select(F.lit("PASS").alias("status")))


@query(with_ctes(f""", {COUNTS}, {DIVERSITY}, e AS (SELECT contig, count(*) FILTER (WHERE b >= 0.58) AS eligible_samples FROM (SELECT contig, sample_id, avg((depth >= 3)::INT) AS b FROM depth GROUP BY ALL) GROUP BY contig),
  st AS (SELECT contig, pos, count(*) AS n, count(gt) AS called, coalesce(sum(gt), 0) AS alt, max(qual) AS q FROM genotypes GROUP BY ALL), l AS (SELECT *, q >= 25 AND (n - called)::DOUBLE / n <= 0.6 AS ok FROM st),
  ly AS (SELECT contig, count(*) FILTER (WHERE ok AND alt >= 1) AS high_confidence_sites, count(*) FILTER (WHERE ok AND alt BETWEEN 1 AND called - 1) AS primary_sites, count(*) FILTER (WHERE ok AND alt BETWEEN 2 AND called - 2) AS ordination_sites FROM l GROUP BY contig),
  d AS (SELECT contig, count(*) AS populations, round(min(differences::DOUBLE / nullif(compared, 0)), 9) AS min_pi, round(max(differences::DOUBLE / nullif(compared, 0)), 9) AS max_pi, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM diversity GROUP BY contig)
  SELECT * FROM e JOIN ly USING (contig) JOIN d USING (contig)""", "calls", "genotypes"))  # fmt: skip
def agg29_canonical_summary(spark, sf_dir):
    c = fx.calls(spark, sf_dir)
    return ops.canonical_summary(ev.eligibility(ev.depth_summary(fx.depth(spark, sf_dir)), 3, 0.58), ev.site_layers(fx.genotypes(spark, sf_dir), 25.0, 0.6), popgen.nucleotide_diversity(c), popgen.population_pairs(c))


@query(with_ctes(", s AS (SELECT sample_id FROM samples), o AS (SELECT DISTINCT o_custkey AS sample_id FROM orders) SELECT sample_id FROM s INTERSECT SELECT sample_id FROM o", "samples"))
def set1_intersect(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("sample_id").intersect(fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id")))


@query(with_ctes(f", {KEYED}, {S_DIV}, {PI} SELECT scenario, contig, count(*) AS populations FROM pi GROUP BY ALL UNION ALL SELECT 'all', contig, count(DISTINCT popcode) FROM calls GROUP BY contig", "depth", "calls"))
def set4_stack(spark, sf_dir):
    one = _pi(spark, sf_dir).groupBy("scenario", "contig").agg(F.count(F.lit(1)).alias("populations"))
    two = fx.calls(spark, sf_dir).groupBy("contig").agg(F.count_distinct("popcode").alias("populations")).withColumn("scenario", F.lit("all"))
    return one.unionByName(two)


ORDERED = "ord AS (SELECT sample_id, row_number() OVER (ORDER BY popcode, sample_id)::INT AS place FROM samples), pops AS (SELECT ord.*, popcode FROM ord JOIN samples USING (sample_id))"


@query(with_ctes(f", {ORDERED}, b AS (SELECT *, lag(popcode) OVER (ORDER BY place) AS before FROM pops) SELECT place, popcode FROM b WHERE before <> popcode", "samples"))
def win10_group_boundaries(spark, sf_dir):
    from ..operators.presentation import group_boundaries, tip_order

    return group_boundaries(tip_order(fx.samples(spark, sf_dir), "sample_id", "popcode"), "popcode").select("place", "popcode")


@query(with_ctes(f", {ORDERED}, d AS (SELECT a.sample_id AS sample_1, b.sample_id AS sample_2, count(*) FILTER (WHERE a.base <> b.base) AS differences FROM calls a JOIN calls b ON a.contig = b.contig AND a.pos = b.pos AND a.sample_id < b.sample_id WHERE a.base <> 'N' AND b.base <> 'N' AND a.contig = 'c2' GROUP BY ALL) SELECT x.place AS \"row\", y.place AS \"column\", differences FROM d JOIN ord x ON x.sample_id = sample_1 JOIN ord y ON y.sample_id = sample_2", "samples", "calls"))
def win9_tip_order_matrix(spark, sf_dir):
    from ..operators.distance import pairwise_distance
    from ..operators.presentation import order_pairs, tip_order

    return order_pairs(pairwise_distance(fx.calls(spark, sf_dir).filter("contig = 'c2'")), tip_order(fx.samples(spark, sf_dir), "sample_id", "popcode")).select("row", "column", "differences")


@query(with_ctes(f", {KEYED}, {S_DIV}, {PI}, m AS (SELECT popcode, round(median(pi), 9) AS median_pi FROM pi GROUP BY popcode) SELECT * FROM m WHERE median_pi IS NOT NULL ORDER BY median_pi DESC, popcode LIMIT 12", "depth", "calls"))
def top5_top_populations(spark, sf_dir):
    from ..operators.presentation import top_populations

    return top_populations(_pi(spark, sf_dir), 12)
