"""Queries over intervals, hits, depth and genotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..catalog import query
from ..fixtures import with_ctes
from ..operators import calls as call_ops
from ..operators import evidence as ops
from ..operators import intervals as iv


def merged_sql(source: str, key: str, name: str = "merged") -> str:
    """CTEs that merge the intervals (key, start, end) of source."""
    return f"""{name}_a AS (SELECT {key} AS k, start, "end", max("end") OVER (PARTITION BY {key} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT k, min(start) AS start, max("end") AS "end" FROM {name}_b GROUP BY k, island)"""


@query(with_ctes(f", {merged_sql('intervals', 'name')} SELECT k AS name, start, \"end\" FROM merged", "intervals"))
def win1_merge_intervals(spark, sf_dir):
    return iv.merge_intervals(fx.intervals(spark, sf_dir), "name")


@query(with_ctes(f", {merged_sql('intervals', 'name')} SELECT k AS name, sum(\"end\" - start)::BIGINT AS bases FROM merged GROUP BY k", "intervals"))
def win1_covered_bases(spark, sf_dir):
    return iv.covered_bases(fx.intervals(spark, sf_dir), "name")


@query(with_ctes(f""", {merged_sql('intervals', 'name')}, gaps AS (SELECT k AS name, coalesce(lag("end") OVER (PARTITION BY k ORDER BY start), 0) AS start, start AS "end" FROM merged
  UNION ALL SELECT k, max("end"), 200 FROM merged GROUP BY k) SELECT name, start::INT AS start, "end"::INT AS "end" FROM gaps WHERE start < "end" """, "intervals"))  # fmt: skip
def prj9_complement_intervals(spark, sf_dir):
    return iv.complement_intervals(fx.intervals(spark, sf_dir), fx.LENGTH, "name")


@query(with_ctes(f""", one AS (SELECT 1 AS one, start, "end" FROM mask), {merged_sql('one', 'one')},
  o AS (SELECT i.interval_id, i.start, i."end", coalesce(sum(least(i."end", m."end") - greatest(i.start, m.start)) FILTER (WHERE i.start < m."end" AND m.start < i."end"), 0)::BIGINT AS overlap FROM intervals i CROSS JOIN merged m GROUP BY ALL)
  SELECT interval_id, start, "end", overlap, round(overlap::DOUBLE / ("end" - start), 9) AS fraction, CASE WHEN overlap = 0 THEN 'none' WHEN overlap = "end" - start THEN 'full' ELSE 'partial' END AS "class" FROM o""", "intervals", "mask"))  # fmt: skip
def jn4_interval_overlap(spark, sf_dir):
    i = fx.intervals(spark, sf_dir)
    return iv.interval_overlap(i, fx.mask(spark, sf_dir), "interval_id", bin_size=50)


@query(with_ctes(" SELECT contig, sample_id, pos, depth FROM depth d WHERE EXISTS (SELECT 1 FROM mask m WHERE d.pos >= m.start AND d.pos < m.\"end\")", "mask"))
def jn5_positions_in_intervals(spark, sf_dir):
    return iv.positions_in_intervals(fx.depth(spark, sf_dir).select("contig", "sample_id", "pos", "depth"), fx.mask(spark, sf_dir), 50)


@query(with_ctes(", bad AS (SELECT interval_id, start - (interval_id % 7)::INT * 20 AS start, \"end\" + (interval_id % 3)::INT * 10 AS \"end\" FROM intervals), e AS (SELECT *, CASE WHEN start < 0 THEN 'starts before 0' WHEN \"end\" > 200 THEN 'ends after the sequence' WHEN start >= \"end\" THEN 'empty' END AS error FROM bad) SELECT * FROM e WHERE error IS NOT NULL", "intervals"))
def dq4_interval_errors(spark, sf_dir):
    i = fx.intervals(spark, sf_dir)
    bad = i.select("interval_id", (F.col("start") - (F.col("interval_id") % 7).cast("int") * 20).alias("start"), (F.col("end") + (F.col("interval_id") % 3).cast("int") * 10).alias("end"))
    return iv.interval_errors(bad, fx.LENGTH)


HALF = """q AS (SELECT query, least(qstart, qend) - 1 AS start, greatest(qstart, qend) AS "end" FROM hits), s AS (SELECT query, least(sstart, send) - 1 AS start, greatest(sstart, send) AS "end" FROM hits)"""


@query(with_ctes(f""", {HALF}, {merged_sql('q', 'query', 'mq')}, {merged_sql('s', 'query', 'ms')}, n AS (SELECT query, count(*) AS hits FROM hits GROUP BY query),
  a AS (SELECT k, sum("end" - start)::BIGINT AS b FROM mq GROUP BY k), b AS (SELECT k, sum("end" - start)::BIGINT AS b FROM ms GROUP BY k)
  SELECT query, hits, a.b AS query_bases, round(a.b / 1000.0::DOUBLE, 9) AS query_fraction, b.b AS subject_bases, round(b.b / 1000.0::DOUBLE, 9) AS subject_fraction FROM n JOIN a ON a.k = query JOIN b ON b.k = query""", "hits"))  # fmt: skip
def agg18_hit_coverage(spark, sf_dir):
    return iv.hit_coverage(fx.hits(spark, sf_dir))


BASES = """bases AS (SELECT query, hit_no, bitscore, identity, CASE WHEN (qstart <= qend) = (sstart <= send) THEN '+' ELSE '-' END AS strand, unnest(range(least(qstart, qend), greatest(qstart, qend) + 1)) AS pos FROM hits),
best AS (SELECT * FROM bases QUALIFY row_number() OVER (PARTITION BY query, pos ORDER BY bitscore DESC, hit_no) = 1)"""


@query(with_ctes(f""", {BASES} SELECT query, count(*) AS bases, round(avg(identity), 9) AS identity, count(*) FILTER (WHERE strand = '+') AS same_strand, count(*) FILTER (WHERE strand = '-') AS reverse_strand,
  round(count(*) FILTER (WHERE strand = '+')::DOUBLE / count(*), 9) AS same_fraction, round(count(*) FILTER (WHERE strand = '-')::DOUBLE / count(*), 9) AS reverse_fraction FROM best GROUP BY query""", "hits"))  # fmt: skip
def agg19_weighted_identity(spark, sf_dir):
    return iv.weighted_identity(fx.hits(spark, sf_dir))


BEST = "b AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, subject ORDER BY bitscore DESC, length DESC, hit_no) = 1)"


@query(with_ctes(", b AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY bitscore DESC, length DESC, hit_no) = 1) SELECT query, hit_no, bitscore, length FROM b", "hits"))
def win3_best_hit_per_feature(spark, sf_dir):
    return iv.best_hit_per_feature(fx.hits(spark, sf_dir)).select("query", "hit_no", "bitscore", F.col("length").cast("int").alias("length"))


@query(with_ctes(f""", p AS (SELECT *, qend - qstart + 1 AS len, (qend - qstart + 1)::DOUBLE / 100 AS coverage FROM hits)
  SELECT hit_no, least(sstart, send) - 1 AS start, greatest(sstart, send) AS "end", CASE WHEN sstart <= send THEN '+' ELSE '-' END AS strand, round(coverage, 9) AS coverage,
  CASE WHEN coverage < 0.8 AND identity < 90 THEN 'coverage and identity' WHEN coverage < 0.8 THEN 'coverage' WHEN identity < 90 THEN 'identity' END AS reason,
  CASE WHEN coverage < 0.8 OR identity < 90 THEN 'rejected' ELSE 'accepted' END AS status FROM p""", "hits"))  # fmt: skip
def prj13_accept_projection(spark, sf_dir):
    h = fx.hits(spark, sf_dir).withColumn("qlen", F.lit(100))
    return iv.accept_projection(h).select("hit_no", "start", "end", "strand", "coverage", "reason", "status")


@query("SELECT o_orderkey AS feature_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CDS' ELSE 'tRNA' END AS feature_type, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' ELSE (1 + o_orderkey % 3)::VARCHAR END AS codon_start, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '0' ELSE (o_orderkey % 3)::VARCHAR END ELSE '.' END AS phase FROM orders")
def prj14_gff_phase(spark, sf_dir):
    k = F.col("o_orderkey")
    features = fx.table(spark, sf_dir, "orders").select(k.alias("feature_id"), F.when(k % 2 == 0, "CDS").otherwise("tRNA").alias("feature_type"), F.when(k % 5 == 0, None).when(k % 7 == 0, "x").otherwise((1 + k % 3).cast("string")).alias("codon_start"))
    return iv.gff_phase(features)


@query(with_ctes(""", r AS (SELECT * FROM hits WHERE (qstart <= qend) <> (sstart <= send) AND length >= 60 AND identity >= 95), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY length DESC, bitscore DESC, hit_no) = 1)
  SELECT query, least(qstart, qend) - 1 AS start_1, greatest(qstart, qend) AS end_1, least(sstart, send) - 1 AS start_2, greatest(sstart, send) AS end_2 FROM b""", "hits"))  # fmt: skip
def top2_inverted_repeat_pair(spark, sf_dir):
    return iv.inverted_repeat_pair(fx.hits(spark, sf_dir), 60, 95.0, "query")


def _shifted(hits):
    return hits.withColumn("sstart", F.col("sstart") + F.col("hit_no") % 7 * 100).withColumn("send", F.col("send") + F.col("hit_no") % 7 * 100)


SHIFTED = "h AS (SELECT * REPLACE (sstart + hit_no % 7 * 100 AS sstart, send + hit_no % 7 * 100 AS send) FROM hits)"


@query(with_ctes(f""", {SHIFTED}, f AS (SELECT *, least(qstart, sstart) - 1 AS s1, CASE WHEN qstart <= sstart THEN qend ELSE send END AS e1, greatest(qstart, sstart) - 1 AS s2, CASE WHEN qstart <= sstart THEN send ELSE qend END AS e2
  FROM h WHERE qstart <= qend AND sstart <= send AND identity >= 82 AND (qstart <> sstart OR qend <> send)),
  g AS (SELECT * FROM f WHERE s1 <= 300 AND abs(s2 - 400) <= 300 AND abs(e2 - 460) <= 300 QUALIFY row_number() OVER (PARTITION BY query ORDER BY length DESC, bitscore DESC, hit_no) = 1)
  SELECT query, s1 AS start_1, e1 AS end_1, s2 AS start_2, e2 AS end_2 FROM g""", "hits"))  # fmt: skip
def top3_terminal_repeat(spark, sf_dir):
    return iv.terminal_repeat(_shifted(fx.hits(spark, sf_dir)), 400, 460, 82.0, 300, "query").select("query", *[F.col(c).cast("long").alias(c) for c in ("start_1", "end_1", "start_2", "end_2")])


@query(with_ctes(f""", {SHIFTED}, f AS (SELECT * FROM h WHERE (qstart <> sstart OR qend <> send) AND length >= 40 AND identity >= 95), c AS (SELECT query, least(qstart, qend)::BIGINT - 1 AS start, greatest(qstart, qend)::BIGINT AS "end" FROM f
  UNION ALL SELECT query, least(sstart, send) - 1, greatest(sstart, send) FROM f), {merged_sql('c', 'query')} SELECT k AS query, start, "end" FROM merged""", "hits"))  # fmt: skip
def top4_self_repeats(spark, sf_dir):
    return iv.self_repeats(_shifted(fx.hits(spark, sf_dir)), "query", min_length=40, min_identity=95.0).select("query", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(with_ctes("SELECT sample_id, pos, depth FROM depth", "depth"))
def src6_densify_depth(spark, sf_dir):
    sparse = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % fx.LENGTH).cast("int").alias("pos")).agg(F.count(F.lit(1)).alias("depth"))
    return ops.densify(sparse, fx.samples(spark, sf_dir), fx.LENGTH)


SUMMARY = "summary AS (SELECT contig, sample_id, count(*) AS sites, avg(depth) AS mean_depth, " + ", ".join(f"avg((depth >= {t})::INT) AS breadth_dp{t}" for t in (1, 3, 5, 10)) + " FROM depth GROUP BY ALL)"


@query(with_ctes(f", {SUMMARY} SELECT contig, sample_id, sites, round(mean_depth, 9) AS mean_depth, " + ", ".join(f"round(breadth_dp{t}, 9) AS breadth_dp{t}" for t in (1, 3, 5, 10)) + " FROM summary", "depth"))
def agg10_depth_summary(spark, sf_dir):
    return ops.depth_summary(fx.depth(spark, sf_dir))


ELIGIBLE = f"{SUMMARY}, eligible AS (SELECT contig, sample_id, breadth_dp3 >= 0.58 AS eligible FROM summary)"


@query(with_ctes(f", {ELIGIBLE} SELECT * FROM eligible", "depth"))
def agg11_eligibility(spark, sf_dir):
    return ops.eligibility(ops.depth_summary(fx.depth(spark, sf_dir)), 3, 0.58)


@query(with_ctes(f", {ELIGIBLE} SELECT sample_id FROM eligible WHERE eligible GROUP BY sample_id HAVING count(*) = 2", "depth"))
def jn7_shared_samples(spark, sf_dir):
    return ops.shared_samples(ops.eligibility(ops.depth_summary(fx.depth(spark, sf_dir)), 3, 0.58))


SUPPORT = f"{ELIGIBLE}, support AS (SELECT contig, pos, count(*) FILTER (WHERE depth >= 3) AS support, count(*) AS samples FROM depth JOIN eligible USING (contig, sample_id) WHERE eligible GROUP BY ALL)"


def _support(spark, sf_dir):
    d = fx.depth(spark, sf_dir)
    return ops.position_support(d, ops.eligibility(ops.depth_summary(d), 3, 0.58), 3)


@query(with_ctes(f", {SUPPORT} SELECT * FROM support", "depth"))
def agg12_position_support(spark, sf_dir):
    return _support(spark, sf_dir)


ISLANDS = """SELECT contig, min(pos) AS start, max(pos) + 1 AS "end" FROM (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS run FROM support WHERE support >= {}) GROUP BY contig, run HAVING max(pos) + 1 - min(pos) >= 2"""


@query(with_ctes(f", {SUPPORT} " + ISLANDS.format("samples * 0.6"), "depth"))
def win2_support_islands(spark, sf_dir):
    return iv.support_islands(_support(spark, sf_dir), "samples", 0.6, 2, "contig")


@query(with_ctes(f", {SUPPORT} " + ISLANDS.format("ceil(samples * 0.6::DOUBLE)"), "depth"))
def win2_support_islands_ceiling(spark, sf_dir):
    return iv.support_islands(_support(spark, sf_dir), "samples", 0.6, 2, "contig", ceiling=True)


MASKED = "masked AS (SELECT * REPLACE (CASE WHEN dp >= 2 AND gq >= 20 THEN gt END AS gt) FROM genotypes)"


@query(with_ctes(f", {MASKED} SELECT contig, sample_id, pos, gt FROM masked", "genotypes"))
def prj1_mask_genotypes(spark, sf_dir):
    return ops.mask_genotypes(fx.genotypes(spark, sf_dir), 2, 20).select("contig", "sample_id", "pos", "gt")


@query(with_ctes("SELECT contig, sample_id, pos, dp >= 5 AND length(ref) = 1 AND pl[3] - pl[1] >= 20 AND pl[3] > pl[1] AS is_reference FROM genotypes", "genotypes"))
def prj2_call_invariant_reference(spark, sf_dir):
    g = fx.genotypes(spark, sf_dir)
    # alternate letters as a list; likelihoods are those of 0/0, 0/1, 1/1
    return g.select("contig", "sample_id", "pos", ops.reference_call(F.col("pl"), F.col("ref"), F.array("alt"), F.col("dp")).alias("is_reference"))


LAYERS = f"""{MASKED}, sites AS (SELECT contig, pos, ref, alt, count(*) AS samples, count(gt) AS called, coalesce(sum(gt), 0)::BIGINT AS alternate, max(qual) AS qual, (count(*) - count(gt))::DOUBLE / count(*) AS missing FROM masked GROUP BY ALL),
layers AS (SELECT *, qual >= 25 AND missing <= 0.6 AND alternate >= 1 AS high_confidence, qual >= 25 AND missing <= 0.6 AND alternate BETWEEN 1 AND called - 1 AS "primary", qual >= 25 AND missing <= 0.6 AND alternate BETWEEN 2 AND called - 2 AS ordination FROM sites)"""


@query(with_ctes(f", {LAYERS} SELECT contig, pos, ref, alt, samples, called, alternate, qual, round(missing, 9) AS missing, high_confidence, \"primary\", ordination FROM layers", "genotypes"))
def prj5_variant_layers(spark, sf_dir):
    return ops.site_layers(ops.mask_genotypes(fx.genotypes(spark, sf_dir), 2, 20), 25.0, 0.6)


@query(with_ctes(f", {LAYERS} SELECT contig, pos, ref, alt, called, alternate, round(missing, 9) AS missing FROM layers WHERE ordination", "genotypes"))
def prj4_site_filter(spark, sf_dir):
    return ops.site_filter(ops.mask_genotypes(fx.genotypes(spark, sf_dir), 2, 20), 2, 25.0, 0.6)


@query(with_ctes(f""", {LAYERS}, inv AS (SELECT contig, sample_id, pos, ref AS base FROM genotypes WHERE dp >= 2 AND pl[3] - pl[1] >= 20), var AS (SELECT contig, sample_id, pos, CASE gt WHEN 0 THEN ref ELSE alt END AS base FROM masked WHERE gt IS NOT NULL AND (contig, pos) IN (SELECT contig, pos FROM layers WHERE high_confidence)),
  s AS (SELECT DISTINCT sample_id FROM (SELECT sample_id FROM inv UNION ALL SELECT sample_id FROM var))
  SELECT r.contig, s.sample_id, r.pos, r.ref, coalesce(var.base, inv.base, 'N') AS base FROM reference r CROSS JOIN s LEFT JOIN inv ON inv.contig = r.contig AND inv.pos = r.pos AND inv.sample_id = s.sample_id LEFT JOIN var ON var.contig = r.contig AND var.pos = r.pos AND var.sample_id = s.sample_id""", "genotypes", "reference"))  # fmt: skip
def prj3_callable_sequence(spark, sf_dir):
    g = fx.genotypes(spark, sf_dir)
    masked = ops.mask_genotypes(g, 2, 20)
    accepted = ops.site_layers(masked, 25.0, 0.6).filter("high_confidence")
    invariant = g.filter(ops.reference_call(F.col("pl"), F.col("ref"), F.array("alt"), F.col("dp"), 2, 20)).select("contig", "sample_id", "pos", F.col("ref").alias("base"))
    variants = masked.filter("gt is not null").select("contig", "sample_id", "pos", F.when(F.col("gt") == 0, F.col("ref")).otherwise(F.col("alt")).alias("base"))
    return ops.callable_sequence(fx.reference(spark), invariant, variants, accepted)


@query(with_ctes("SELECT popcode || '/' || contig AS contig, sample_id, pos, gt FROM genotypes WHERE (popcode, contig, pos) IN (SELECT popcode, contig, pos FROM genotypes GROUP BY ALL HAVING count(gt) = count(*))", "genotypes"))
def prj20_complete_markers(spark, sf_dir):
    """Markers that all samples of a population have."""
    return ops.complete_markers(fx.genotypes(spark, sf_dir).select(F.concat_ws("/", "popcode", "contig").alias("contig"), "sample_id", "pos", "gt"))


@query(with_ctes("SELECT contig, sample_id, pos, coalesce(CASE gt WHEN 0 THEN ref WHEN 1 THEN alt END, '0') AS allele_1, coalesce(CASE gt WHEN 0 THEN ref WHEN 1 THEN alt END, '0') AS allele_2 FROM genotypes", "genotypes"))
def prj19_haploid_to_diploid(spark, sf_dir):
    return ops.haploid_to_diploid(fx.genotypes(spark, sf_dir))


@query("""WITH r AS (SELECT l_suppkey AS sample_id, l_orderkey % 4096 AS flag, l_partkey % 61 AS mapq FROM lineitem) SELECT sample_id, count(*) AS records, count(*) FILTER (WHERE flag & 3844 = 0 AND mapq >= 20) AS kept,
  count(*) FILTER (WHERE flag & 3844 <> 0) AS flagged, count(*) FILTER (WHERE flag & 3844 = 0 AND mapq < 20) AS low_quality FROM r GROUP BY sample_id""")  # fmt: skip
def prj10_flag_filter(spark, sf_dir):
    l = fx.table(spark, sf_dir, "lineitem")  # noqa: E741
    return ops.flag_filter(l.select(F.col("l_suppkey").alias("sample_id"), (F.col("l_orderkey") % 4096).alias("flag"), (F.col("l_partkey") % 61).alias("mapq")))


BOUNDARY = "boundary AS (SELECT contig, sample_id, avg(depth) FILTER (WHERE pos < 50) AS start_depth, avg(depth) FILTER (WHERE pos >= 150) AS end_depth, avg(depth) FILTER (WHERE pos >= 50 AND pos < 150) AS interior_depth FROM (SELECT 'all' AS contig, * EXCLUDE (contig) FROM depth) GROUP BY ALL)"


def _boundary(spark, sf_dir):
    return ops.boundary_depth(fx.depth(spark, sf_dir).withColumn("contig", F.lit("all")), fx.LENGTH)


@query(with_ctes(f", {BOUNDARY} SELECT contig, sample_id, round(start_depth, 9) AS start_depth, round(end_depth, 9) AS end_depth, round(interior_depth, 9) AS interior_depth FROM boundary", "depth"))
def agg14_boundary_depth(spark, sf_dir):
    return _boundary(spark, sf_dir)


@query(with_ctes(f", {BOUNDARY} SELECT contig, round(avg(start_depth), 9) AS start_depth, round(avg(end_depth), 9) AS end_depth, round(avg(interior_depth), 9) AS interior_depth, round(median(least(start_depth, end_depth) / nullif(interior_depth, 0)), 9) AS median_ratio FROM boundary GROUP BY contig", "depth"))
def agg14_boundary_summary(spark, sf_dir):
    return ops.boundary_summary(_boundary(spark, sf_dir))


REPEATS = "rep AS (SELECT DISTINCT unnest(range(start, \"end\")) AS pos FROM mask)"


@query(with_ctes(f""", {REPEATS}, r AS (SELECT sample_id, avg(depth) FILTER (WHERE pos IN (SELECT pos FROM rep)) AS a, avg(depth) FILTER (WHERE pos NOT IN (SELECT pos FROM rep)) AS b FROM depth GROUP BY ALL)
  SELECT sample_id, round(a, 9) AS repeat_depth, round(b, 9) AS unique_depth, round(a / nullif(b, 0), 9) AS ratio FROM r""", "mask"))  # fmt: skip
def agg15_repeat_ratio(spark, sf_dir):
    return ops.repeat_ratio(fx.depth(spark, sf_dir), fx.mask(spark, sf_dir))


@query(with_ctes(f""", {REPEATS}, v AS (SELECT contig, pos FROM calls WHERE base <> 'N' GROUP BY ALL HAVING count(DISTINCT base) > 1), s AS (SELECT contig, pos, max((base <> 'N')::INT) AS c, sum(depth) AS d, count(*) AS n FROM calls GROUP BY ALL)
  SELECT contig, (pos // 25)::INT AS "window", min(pos) AS start, max(pos) + 1 AS "end", sum(c)::BIGINT AS callable, count(*) FILTER (WHERE pos IN (SELECT pos FROM rep)) AS repeat_bases, count(*) FILTER (WHERE (contig, pos) IN (SELECT contig, pos FROM v)) AS variants,
  round(sum(d)::DOUBLE / sum(n)::DOUBLE, 9) AS mean_depth, round(count(*) FILTER (WHERE (contig, pos) IN (SELECT contig, pos FROM v)) * 1000::DOUBLE / nullif(sum(c), 0)::DOUBLE, 9) AS variants_per_kb FROM s GROUP BY contig, pos // 25""", "calls", "mask"))  # fmt: skip
def agg16_coordinate_windows(spark, sf_dir):
    c = fx.calls(spark, sf_dir)
    return ops.coordinate_windows(c, fx.mask(spark, sf_dir), call_ops.variable_sites(c), 25)


DEEP = "deep AS (SELECT sample_id, dp * 8 AS dp, [dp * 8 - sample_id % 5 * dp, sample_id % 5 * dp] AS ad FROM genotypes)"


@query(with_ctes(f""", {DEEP}, r AS (SELECT sample_id, count(*) AS sites, count(*) FILTER (WHERE dp >= 20 AND ad[1] >= 3 AND ad[2] >= 3 AND ad[2]::DOUBLE / nullif(ad[1] + ad[2], 0) BETWEEN 0.2 AND 0.8) AS mixed FROM deep GROUP BY ALL),
  q AS (SELECT *, mixed::DOUBLE / sites AS rate, median(mixed::DOUBLE / sites) OVER () AS median FROM r), m AS (SELECT *, median(abs(rate - median)) OVER () AS mad FROM q)
  SELECT sample_id, sites, mixed, round(rate, 9) AS rate, round(median, 9) AS median, round(mad, 9) AS mad, mixed >= 10 AND rate > median + 5 * mad AS suspected FROM m""", "genotypes"))  # fmt: skip
def agg24_mixed_allele_screen(spark, sf_dir):
    g = fx.genotypes(spark, sf_dir)
    minor = F.col("sample_id") % 5 * F.col("dp")
    return ops.mixed_allele_screen(g.select("sample_id", (F.col("dp") * 8).alias("dp"), F.array(F.col("dp") * 8 - minor, minor).alias("ad")))


@query("""SELECT count(*) AS reports, sum(o_orderkey)::BIGINT AS input_reads, sum(o_orderkey - o_custkey % 50)::BIGINT AS passing_reads, sum(o_custkey + 1)::BIGINT AS bases, round(sum((o_orderkey % 100) / 100.0::DOUBLE * (o_custkey + 1)) / sum(o_custkey + 1), 9) AS q30_rate,
  round(sum(o_orderkey - o_custkey % 50)::DOUBLE / sum(o_orderkey)::DOUBLE, 9) AS retention, round(median((o_orderkey % 37) / 37.0::DOUBLE), 9) AS median_duplication FROM orders""")  # fmt: skip
def agg17_preprocessing_rollup(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return ops.preprocessing_rollup(o.select(k.alias("input_reads"), (k - F.col("o_custkey") % 50).alias("passing_reads"), (F.col("o_custkey") + 1).alias("bases"), (k % 100 / 100).alias("q30_rate"), (k % 37 / 37).alias("duplication")))
