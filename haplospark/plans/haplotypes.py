"""Queries over haplotypes, resampling and ordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..catalog import query
from ..fixtures import with_ctes
from ..functions import columns as fn
from ..functions import ranks
from ..operators import haplotypes as ops
from ..operators import ordination, popgen
from ..operators import resampling as rs
from ..operators.calls import variable_sites
from .populations import COUNTS, DIVERSITY, HASH, OBSERVED, STANDARDISED, STRICT

LABELS = """var AS (SELECT contig, pos FROM calls WHERE base <> 'N' GROUP BY ALL HAVING count(DISTINCT base) > 1),
seqs AS (SELECT c.contig, c.sample_id, c.popcode, c.taxon, string_agg(c.base, '' ORDER BY c.pos) AS s, count(*) FILTER (WHERE c.base = 'N') AS missing FROM calls c JOIN var USING (contig, pos) GROUP BY ALL),
labels AS (SELECT contig, sample_id, popcode, taxon, CASE WHEN missing = 0 THEN s END AS haplotype_seq,
  CASE WHEN missing = 0 THEN dense_rank() OVER (PARTITION BY contig, missing = 0 ORDER BY s)::INT END AS label_no,
  CASE WHEN missing = 0 THEN 'H' || dense_rank() OVER (PARTITION BY contig, missing = 0 ORDER BY s) ELSE 'AMBIGUOUS' END AS haplotype FROM seqs)"""
TABLE = """named AS (SELECT contig, haplotype, haplotype_seq, popcode, count(*) AS n FROM labels WHERE haplotype <> 'AMBIGUOUS' GROUP BY ALL),
haps AS (SELECT contig, haplotype, haplotype_seq, sum(n)::BIGINT AS samples, string_agg(popcode || ':' || n, ';' ORDER BY popcode || ':' || n) AS populations FROM named GROUP BY ALL)"""


def _labels(spark, sf_dir):
    return ops.haplotype_labels(fx.calls(spark, sf_dir))


@query(with_ctes(f", {LABELS} SELECT contig, sample_id, popcode, taxon, haplotype_seq, label_no, haplotype FROM labels", "calls"))
def win8_haplotype_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(with_ctes(f", {LABELS}, {TABLE} SELECT contig, haplotype, haplotype_seq, samples, populations FROM haps", "calls"))
def agg22_haplotypes(spark, sf_dir):
    return ops.haplotypes(_labels(spark, sf_dir))


TAXA = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(with_ctes(f", {LABELS} SELECT contig, haplotype, " + ", ".join(f"count(*) FILTER (WHERE taxon = '{t}') AS \"{t}\"" for t in TAXA) + " FROM labels GROUP BY ALL", "calls"))
def agg22_composition_counts(spark, sf_dir):
    return ops.composition_counts(_labels(spark, sf_dir), list(TAXA))


@query(with_ctes(f", {LABELS} SELECT contig, sample_id, taxon FROM labels WHERE taxon NOT IN ('AFRICA', 'ASIA')", "calls"))
def dq13_unknown_taxa(spark, sf_dir):
    return ops.unknown_taxa(_labels(spark, sf_dir), ["AFRICA", "ASIA"])


DIVERSE = """, hd AS (SELECT contig, popcode, count(*) FILTER (WHERE haplotype <> 'AMBIGUOUS') AS assigned, count(DISTINCT haplotype) FILTER (WHERE haplotype <> 'AMBIGUOUS') AS haplotypes, count(*) FILTER (WHERE haplotype = 'AMBIGUOUS') AS ambiguous FROM labels GROUP BY ALL),
sq AS (SELECT contig, popcode, sum(n * n) AS squares FROM (SELECT contig, popcode, haplotype, count(*) AS n FROM labels WHERE haplotype <> 'AMBIGUOUS' GROUP BY ALL) GROUP BY ALL),
hdiv AS (SELECT contig, popcode, assigned, haplotypes, ambiguous, round(CASE WHEN assigned = 1 THEN 0.0 WHEN assigned > 1 THEN (assigned * assigned - squares)::DOUBLE / (assigned * (assigned - 1)) END, 9) AS diversity FROM hd LEFT JOIN sq USING (contig, popcode))"""


@query(with_ctes(f", {LABELS} {DIVERSE} SELECT * FROM hdiv", "calls"))
def agg4_haplotype_diversity(spark, sf_dir):
    return popgen.haplotype_diversity(_labels(spark, sf_dir))


@query(with_ctes(f""", {LABELS} {DIVERSE}, {COUNTS}, {DIVERSITY}, {OBSERVED}, {STRICT}, ids AS (SELECT contig, popcode, string_agg(sample_id::VARCHAR, ';' ORDER BY sample_id) AS sample_ids FROM (SELECT DISTINCT contig, popcode, sample_id FROM calls) GROUP BY ALL)
  SELECT d.*, round(d.differences::DOUBLE / nullif(d.compared, 0), 9) AS pi, h.assigned, h.haplotypes, h.ambiguous, h.diversity, o.private_sites, s.private_sites AS strict_private_sites, i.sample_ids
  FROM diversity d LEFT JOIN hdiv h USING (contig, popcode) LEFT JOIN private_observed o USING (contig, popcode) LEFT JOIN private_strict s USING (contig, popcode) LEFT JOIN ids i USING (contig, popcode)""", "calls"))  # fmt: skip
def agg6_population_summary(spark, sf_dir):
    return popgen.population_summary(fx.calls(spark, sf_dir), _labels(spark, sf_dir))


@query(with_ctes(f""", var AS (SELECT contig, pos FROM calls WHERE base <> 'N' GROUP BY ALL HAVING count(DISTINCT base) > 1), w AS (SELECT contig, sample_id, popcode, string_agg(base, '' ORDER BY pos) AS s FROM calls JOIN var USING (contig, pos) GROUP BY ALL), g AS (SELECT contig, s, count(*) AS n, count(DISTINCT popcode) AS pops FROM w WHERE s NOT LIKE '%N%' GROUP BY ALL)
  SELECT contig, sum(n)::BIGINT AS assigned, count(*) AS haplotypes, count(*) FILTER (WHERE pops > 1) AS shared FROM g GROUP BY contig""", "calls"))  # fmt: skip
def agg21_haplotype_sharing(spark, sf_dir):
    c = fx.calls(spark, sf_dir)
    return ops.haplotype_sharing(c.join(variable_sites(c).select("contig", "pos"), ["contig", "pos"], "left_semi"))


@query(with_ctes(f", {LABELS}, {TABLE} SELECT contig, haplotype, samples FROM haps WHERE samples >= 3", "calls"))
def top5_major_labels(spark, sf_dir):
    return ops.major_labels(ops.haplotypes(_labels(spark, sf_dir)), 3)


HAP_PAIRS = "hp AS (SELECT a.contig, a.haplotype AS h1, b.haplotype AS h2, hamming(a.haplotype_seq, b.haplotype_seq)::INT AS weight FROM haps a JOIN haps b ON a.contig = b.contig AND a.haplotype < b.haplotype)"


@query(with_ctes(f", {LABELS}, {TABLE}, {HAP_PAIRS} SELECT * FROM hp", "calls"))
def jn2_haplotype_distances(spark, sf_dir):
    return ops.haplotype_distances(ops.haplotypes(_labels(spark, sf_dir)))


def _boruvka_sql(rounds: int = 8) -> str:
    """CTEs that join the parts of hp's haplotypes round by round over each part's least edge; enough for 2**rounds haplotypes."""
    out = ["part0 AS MATERIALIZED (SELECT DISTINCT contig, node, node AS part FROM (SELECT contig, h1 AS node FROM hp UNION ALL SELECT contig, h2 FROM hp))"]
    for r in range(rounds):
        out.append(f"""ends{r} AS MATERIALIZED (SELECT hp.*, x.part AS p1, y.part AS p2 FROM hp JOIN part{r} x ON hp.contig = x.contig AND h1 = x.node JOIN part{r} y ON hp.contig = y.contig AND h2 = y.node WHERE x.part <> y.part)""")
        out.append(f"""least{r} AS MATERIALIZED (SELECT * FROM (SELECT contig, p1 AS own, p2 AS other, weight, h1, h2 FROM ends{r} UNION ALL SELECT contig, p2, p1, weight, h1, h2 FROM ends{r}) QUALIFY row_number() OVER (PARTITION BY contig, own ORDER BY weight, h1, h2) = 1)""")
        out.append(f"""jump{r}_0 AS MATERIALIZED (SELECT l.contig, l.own, CASE WHEN b.other = l.own AND l.own < l.other THEN l.own ELSE l.other END AS root FROM least{r} l JOIN least{r} b ON b.contig = l.contig AND b.own = l.other)""")
        for k in range(rounds):
            out.append(f"jump{r}_{k + 1} AS MATERIALIZED (SELECT a.contig, a.own, b.root FROM jump{r}_{k} a JOIN jump{r}_{k} b ON a.contig = b.contig AND a.root = b.own)")
        out.append(f"part{r + 1} AS MATERIALIZED (SELECT p.contig, p.node, coalesce(j.root, p.part) AS part FROM part{r} p LEFT JOIN jump{r}_{rounds} j ON p.contig = j.contig AND p.part = j.own)")
    out.append("network AS (" + " UNION ".join(f"SELECT contig, h1, h2, weight FROM least{r}" for r in range(rounds)) + ")")
    return ", ".join(out)


@query(with_ctes(f", {LABELS}, {TABLE}, {HAP_PAIRS}, {_boruvka_sql()} SELECT contig, h1, h2, weight FROM network", "calls"))
def gr1_haplotype_network(spark, sf_dir):
    """The minimum spanning network of all haplotypes, found by growing radius; its SQL compares all pairs."""
    return ops.haplotype_network(ops.haplotypes(_labels(spark, sf_dir)))


@query(with_ctes(f""", p AS (SELECT DISTINCT contig, pos FROM calls), k AS (SELECT contig, pos, g.range::INT AS draw, row_number() OVER (PARTITION BY contig, g.range ORDER BY {HASH.format("'1729:' || contig || ':' || g.range || ':' || pos")}, pos) AS rn FROM p CROSS JOIN range(20) g),
  w AS (SELECT k.draw, c.contig, c.sample_id, c.popcode, string_agg(c.base, '' ORDER BY c.pos) AS s FROM k JOIN calls c USING (contig, pos) WHERE rn <= 12 GROUP BY ALL), g AS (SELECT draw, contig, s, count(*) AS n, count(DISTINCT popcode) AS pops FROM w WHERE s NOT LIKE '%N%' GROUP BY ALL)
  SELECT draw, contig, coalesce(sum(n), 0)::BIGINT AS assigned, count(n) AS haplotypes, count(*) FILTER (WHERE pops > 1) AS shared FROM (SELECT DISTINCT draw, contig FROM w) LEFT JOIN g USING (draw, contig) GROUP BY ALL""", "calls"))  # fmt: skip
def stat5_site_downsampling(spark, sf_dir):
    return ops.site_downsampling(fx.calls(spark, sf_dir), 12, draws=20)


COVARIATES = """cov AS (SELECT contig, sample_id, avg((base = 'N')::INT) AS missing, ln(1 + avg(depth)) AS log_depth, avg((base = ref)::INT) AS concordance FROM calls GROUP BY ALL)"""


def _covariates(spark, sf_dir):
    c = fx.calls(spark, sf_dir)
    return c.groupBy("contig", "sample_id").agg(
        F.round(F.avg((F.col("base") == "N").cast("double")), 9).alias("missing"), F.round(F.log1p(F.avg("depth")), 9).alias("log_depth"), F.round(F.avg((F.col("base") == F.col("ref")).cast("double")), 9).alias("concordance")
    )


RCOV = "cov AS (SELECT contig, sample_id, round(avg((base = 'N')::INT), 9) AS missing, round(ln(1 + avg(depth)), 9) AS log_depth, round(avg((base = ref)::INT), 9) AS concordance FROM calls GROUP BY ALL)"
RANKS = """rk AS (SELECT contig, sample_id, rank() OVER (PARTITION BY contig ORDER BY {x}) + (count(*) OVER (PARTITION BY contig, {x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY contig ORDER BY {y}) + (count(*) OVER (PARTITION BY contig, {y}) - 1) / 2.0::DOUBLE AS ry FROM cov)"""


@query(with_ctes(f", {RCOV}, {RANKS.format(x='missing', y='log_depth')} SELECT contig, round(corr(rx, ry), 9) AS rho, count(*) AS n_pairs, 0::BIGINT AS n_dropped FROM rk GROUP BY contig", "calls"))
def stat1_spearman(spark, sf_dir):
    return fn.spearman(_covariates(spark, sf_dir), "missing", "log_depth", "contig")


@query(with_ctes(f", {RCOV}, {RANKS.format(x='missing', y='log_depth')} SELECT contig, sample_id, rx, ry FROM rk", "calls"))
def win4_average_rank(spark, sf_dir):
    ranked = ranks.spread_average_rank(_covariates(spark, sf_dir), "missing", "rx", "contig")
    return ranks.spread_average_rank(ranked, "log_depth", "ry", "contig").select("contig", "sample_id", "rx", "ry")


#: Doubled average ranks are whole numbers, so that replicates equal to the observed one are counted exactly.
PERMUTED = """d2 AS (SELECT contig, sample_id, (2 * rx)::BIGINT AS rx, (2 * ry)::BIGINT AS ry FROM rk),
  d AS (SELECT d2.*, g.range AS rep, row_number() OVER (PARTITION BY contig, g.range ORDER BY sample_id) AS slot, row_number() OVER (PARTITION BY contig, g.range ORDER BY {hash}, sample_id) AS dest FROM d2 CROSS JOIN range({n}) g),
  r AS (SELECT a.contig, a.rep, sum(a.rx * b.ry) AS sxy FROM d a JOIN d b ON a.contig = b.contig AND a.rep = b.rep AND a.slot = b.dest GROUP BY ALL),
  o AS (SELECT contig, corr(rx, ry) AS rho, count(*) AS n, sum(rx * ry) AS sxy, sum(rx) * sum(ry) AS sxsy FROM d2 GROUP BY contig)"""


@query(with_ctes(f""", {RCOV}, {RANKS.format(x='missing', y='log_depth')}, {PERMUTED.format(n=9999, hash=HASH.format("'1729:' || contig || ':' || g.range || ':' || sample_id"))}
  SELECT o.contig, round(o.rho, 9) AS rho, o.n, round((count(*) FILTER (WHERE abs(o.n * r.sxy - o.sxsy) >= abs(o.n * o.sxy - o.sxsy)) + 1) / 10000.0::DOUBLE, 9) AS p FROM o JOIN r USING (contig) GROUP BY ALL""", "calls"))  # fmt: skip
def stat2_permutation_spearman(spark, sf_dir):
    return rs.permutation_spearman(_covariates(spark, sf_dir), "missing", "log_depth", "sample_id", "contig")


@query("""WITH t AS (SELECT o_orderpriority AS grp, o_orderkey AS id, round(((o_orderkey * 7919) % 1009 + 1) / 1010.0::DOUBLE, 9) AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY grp) AS m FROM t)
  SELECT grp, id, p, round(least(1.0, min(p * m / rk) OVER (PARTITION BY grp ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")  # fmt: skip
def win5_bh_adjust(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return ranks.spread_bh_adjust(o.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), F.round(((F.col("o_orderkey") * 7919) % 1009 + 1) / 1010, 9).alias("p")), "p", "grp")


@query(with_ctes(f", {RCOV} SELECT contig, list_sort(list(log_depth))[(floor(0.1 * (count(*) - 1)) + 1)::INT] AS low, list_sort(list(log_depth))[(floor(0.9 * (count(*) - 1)) + 1)::INT] AS high FROM cov GROUP BY contig", "calls"))
def win6_order_statistics(spark, sf_dir):
    return ranks.select_order_statistics(_covariates(spark, sf_dir), "log_depth", {"low": 0.1, "high": 0.9}, "contig")


@query(with_ctes(f", {RCOV} SELECT contig, log_depth, round(row_number() OVER (PARTITION BY contig ORDER BY log_depth)::DOUBLE / count(*) OVER (PARTITION BY contig), 9) AS fraction FROM cov", "calls"))
def win7_ecdf(spark, sf_dir):
    return ranks.spread_ecdf(_covariates(spark, sf_dir), "log_depth", "contig")


MARKERS = "markers AS (SELECT contig, sample_id, pos, gt AS g FROM genotypes)"
INPUTS = f"""{MARKERS}, mean AS (SELECT contig, pos, avg(g) AS mean FROM markers GROUP BY ALL), filled AS (SELECT m.contig, m.sample_id, m.pos, coalesce(m.g, mean.mean) AS f, mean.mean FROM markers m JOIN mean USING (contig, pos)),
sd AS (SELECT contig, pos, stddev_pop(f) AS sd FROM filled GROUP BY ALL HAVING stddev_pop(f) > 1e-12), inputs AS (SELECT f.contig, f.pos, f.sample_id, (f - mean) / sd AS z FROM filled f JOIN sd USING (contig, pos))"""


def _markers(spark, sf_dir):
    return fx.genotypes(spark, sf_dir).select("contig", "sample_id", "pos", F.col("gt").alias("g"))


@query(with_ctes(f", {INPUTS} SELECT contig, pos, sample_id, round(z, 9) + 0.0 AS z FROM inputs", "genotypes"))
def agg20_pca_inputs(spark, sf_dir):
    return rs.pca_inputs(_markers(spark, sf_dir))


@query(with_ctes(f", {INPUTS} SELECT a.contig, a.sample_id AS s1, b.sample_id AS s2, round(sum(a.z * b.z), 6) + 0.0 AS dot FROM inputs a JOIN inputs b ON a.contig = b.contig AND a.pos = b.pos AND a.sample_id <= b.sample_id GROUP BY ALL", "genotypes"))
def stat7_gram_matrix(spark, sf_dir):
    return ordination.gram_matrix(rs.pca_inputs(_markers(spark, sf_dir))).withColumn("dot", F.round("dot", 6))


def _pca(markers, components=10):
    return ordination.haploid_pca(rs.pca_inputs(markers), components)


def _complete(markers):
    """Markers that nearly all samples have."""
    full = markers.groupBy("contig", "pos").agg(F.avg(F.col("g").isNotNull().cast("double")).alias("share")).filter("share >= 0.9")
    return markers.join(full, ["contig", "pos"], "left_semi")


@query()
def stat7_haploid_pca(spark, sf_dir):
    return _pca(_markers(spark, sf_dir))


#: What the components of any correct ordination meet: their number, the inputs' sum of squares, and no residual or overlap.
CHECKED = """SELECT contig, count(DISTINCT sample_id) AS samples, count(DISTINCT pos) AS markers, least(10, count(DISTINCT sample_id) - 1, count(DISTINCT pos)) AS components,
  round(sum(z * z), 4) AS total, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS overlap FROM inputs GROUP BY contig"""


def checked_pca(inputs):
    found = ordination.pca_checks(inputs, ordination.haploid_pca(inputs))
    return found.withColumns({"total": F.round("total", 4), "residual": F.round("residual", 8), "overlap": F.round("overlap", 8)})


@query(with_ctes(f", {INPUTS} {CHECKED}", "genotypes"))
def stat7_pca_checks(spark, sf_dir):
    return checked_pca(rs.pca_inputs(_markers(spark, sf_dir)))


FULL = "markers AS (SELECT * FROM all_markers WHERE (contig, pos) IN (SELECT (contig, pos) FROM all_markers GROUP BY contig, pos HAVING avg((g IS NOT NULL)::INT) >= 0.9))"


@query(with_ctes(f", {INPUTS.replace(MARKERS, MARKERS.replace('markers AS', 'all_markers AS') + ', ' + FULL)} {CHECKED}", "genotypes"))
def stat9_pca_checks(spark, sf_dir):
    """The same on the markers that nearly all samples have."""
    return checked_pca(rs.pca_inputs(_complete(_markers(spark, sf_dir))))


@query()
def stat8_procrustes_test(spark, sf_dir):
    g = _markers(spark, sf_dir)
    return rs.procrustes_test(_pca(g), _pca(g.filter("pos % 10 = 0")))


@query()
def stat9_complete_site_pca(spark, sf_dir):
    """Markers that nearly all samples have against all markers; classified by the agreement of the ordinations."""
    from ..operators.sensitivity import classify_pca

    g = _markers(spark, sf_dir)
    return rs.procrustes_test(_pca(g), _pca(_complete(g))).withColumn("class", classify_pca(F.col("r"), F.col("p")))


def _confounders(spark, sf_dir, markers):
    coordinates = _pca(markers, 3).select("contig", "sample_id", "component", "value")
    cov = _covariates(spark, sf_dir)
    long = cov.select("contig", "sample_id", F.explode(F.create_map(*[x for c in ("missing", "log_depth", "concordance") for x in (F.lit(c), F.col(c))])).alias("covariate", "value"))
    return rs.technical_confounders(coordinates, long)


@query()
def stat3_technical_confounders(spark, sf_dir):
    """Components of the ordination against the samples' missingness, depth and concordance."""
    return _confounders(spark, sf_dir, _markers(spark, sf_dir))


@query()
def stat3_complete_site_confounders(spark, sf_dir):
    """The same with the ordination of the markers that nearly all samples have."""
    return _confounders(spark, sf_dir, _complete(_markers(spark, sf_dir)))


@query(with_ctes(f"""{STANDARDISED}, q AS (SELECT contig, popcode, median(round(differences::DOUBLE / nullif(sites, 0), 9)) AS median FROM t GROUP BY ALL), r AS (SELECT *, popcode IN ('NATION_1', 'NATION_2') AS named, row_number() OVER (PARTITION BY contig ORDER BY median DESC NULLS LAST, popcode) AS rk FROM q),
  l AS (SELECT contig, count(*) FILTER (WHERE named) = 2 AND count(*) FILTER (WHERE named AND rk <= 2) = 2 AS exactly_on_top, min(median) FILTER (WHERE named) AS lim FROM r GROUP BY contig)
  SELECT l.contig, l.exactly_on_top, round(avg((round(t.differences::DOUBLE / nullif(t.sites, 0), 9) < l.lim)::INT) FILTER (WHERE t.popcode NOT IN ('NATION_1', 'NATION_2')), 9) AS below FROM l JOIN t USING (contig) GROUP BY ALL""", "calls"))  # fmt: skip
def top6_named_outliers(spark, sf_dir):
    draws = popgen.standardised_diversity(fx.calls(spark, sf_dir), draws=25).withColumn("pi", F.round("pi", 9))
    return rs.named_outliers_on_top(draws, ["NATION_1", "NATION_2"])
