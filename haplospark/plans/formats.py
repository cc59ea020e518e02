"""Queries over file formats and trees: lines and trees are made from the tables, parsed back, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..catalog import query
from ..fixtures import with_ctes
from ..operators import calls as call_ops
from ..operators import evidence, splits
from ..sources import readers, writers

ALIGNMENT = "SELECT contig, sample_id::VARCHAR AS sample_id, string_agg(base, '' ORDER BY pos) AS seq FROM calls GROUP BY ALL"


def _alignment(spark, sf_dir):
    return call_ops.collapse_calls(fx.calls(spark, sf_dir))


@query(with_ctes(f", a AS ({ALIGNMENT}) SELECT sample_id AS header, seq FROM a WHERE contig = 'c1'", "calls"))
def src1_read_alignment(spark, sf_dir):
    lines = writers.fasta_lines(_alignment(spark, sf_dir).filter("contig = 'c1'"))
    return readers.parse_fasta(lines.select(F.substring("value", 2, 1 << 30).alias("value")))


@query(with_ctes(f", a AS ({ALIGNMENT}) SELECT '>' || sample_id || chr(10) || regexp_replace(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM a WHERE contig = 'c1'", "calls"))
def snk3_write_sequences(spark, sf_dir):
    return writers.fasta_lines(_alignment(spark, sf_dir).filter("contig = 'c1'"))


@query(with_ctes("SELECT 'c1' || chr(9) || start || chr(9) || \"end\" || chr(9) || name AS value FROM intervals", "intervals"))
def snk3_write_intervals(spark, sf_dir):
    return writers.bed_lines(fx.intervals(spark, sf_dir).withColumn("contig", F.lit("c1")))


@query(with_ctes("SELECT CASE WHEN interval_id % 100 = 0 THEN 'c2' ELSE 'c1' END AS contig, start, \"end\", name FROM intervals WHERE interval_id % 100 <> 0", "intervals"))
def src4_read_intervals(spark, sf_dir):
    i = fx.intervals(spark, sf_dir).withColumn("contig", F.when(F.col("interval_id") % 100 == 0, "c2").otherwise("c1"))
    lines = writers.bed_lines(i).unionByName(i.select(F.concat(F.lit("# "), F.col("name")).alias("value"))).unionByName(i.select(F.lit("").alias("value")))
    return readers.parse_intervals(lines, "c1")


@query(with_ctes("SELECT 'c1' AS contig, start, \"end\", interval_id AS feature_id, 'c1' || chr(9) || 'haplospark' || chr(9) || 'gene' || chr(9) || (start + 1) || chr(9) || \"end\" || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'ID=' || interval_id || ';product=' || replace(name, '-', '%2C') AS value FROM intervals", "intervals"))
def snk3_write_annotations(spark, sf_dir):
    i = fx.intervals(spark, sf_dir)
    return writers.gff_lines(i.select(F.lit("c1").alias("contig"), "start", "end", F.col("interval_id").alias("feature_id"), F.lit("gene").alias("feature_type"), F.lit("+").alias("strand"), F.lit(".").alias("phase"), F.replace("name", F.lit("-"), F.lit(",")).alias("product")))


@query(with_ctes("SELECT contig, pos + 1 AS pos, ref, [alt] AS alts, qual, 's' || sample_id AS sample_id, gt, CASE WHEN dp > 0 THEN dp END::INT AS dp, gq::INT AS gq FROM genotypes", "genotypes"))
def src5_read_genotypes(spark, sf_dir):
    g = fx.genotypes(spark, sf_dir)
    value = F.concat_ws(":", F.coalesce(F.col("gt").cast("string"), F.lit(".")), F.when(F.col("dp") > 0, F.col("dp").cast("string")).otherwise("."), F.col("gq").cast("string"))
    sites = g.groupBy("contig", "pos", "ref", "alt", "qual").agg(F.array_sort(F.collect_list(F.struct("sample_id", value.alias("v")))).alias("s"))
    line = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("."), F.lit("."), F.lit("GT:DP:GQ"), F.array_join(F.transform("s", lambda x: x["v"]), "\t"))
    names = [f"s{r[0]}" for r in fx.samples(spark, sf_dir).orderBy("sample_id").select("sample_id").collect()]
    return readers.parse_vcf(sites.select(line.alias("value")), names)


@query(with_ctes("SELECT query, subject, identity, length, qstart, qend, sstart, send, bitscore, qlen, slen FROM hits", "hits"))
def src7_read_hits(spark, sf_dir):
    h = fx.hits(spark, sf_dir)
    names = ("query", "subject", "identity", "length", "qstart", "qend", "sstart", "send", "bitscore", "qlen", "slen")
    lines = h.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("value"))
    return readers.parse_hits(lines.unionByName(h.limit(1).select(F.lit("# hits").alias("value"))))


@query("""SELECT o_orderkey::VARCHAR AS sample_id, o_orderkey AS input_reads, o_orderkey * 150 AS input_bases, round((o_custkey % 90) / 100.0::DOUBLE, 9) AS input_q20_rate, round((o_custkey % 80) / 100.0::DOUBLE, 9) AS input_q30_rate,
  o_orderkey - o_custkey % 50 AS passing_reads, (o_orderkey - o_custkey % 50) * 150 AS bases, round((o_custkey % 103) / 100.0::DOUBLE, 9) AS q20_rate, round((o_custkey % 100) / 100.0::DOUBLE, 9) AS q30_rate, o_custkey % 50 AS low_quality_reads, o_custkey % 4 AS too_many_n_reads, o_custkey % 3 AS adapter_dimer_reads, 0::BIGINT AS too_short_reads,
  o_custkey % 700 AS adapter_trimmed_reads, o_custkey % 700 * 9 AS adapter_trimmed_bases, round((o_custkey % 7) / 10.0::DOUBLE, 9) AS duplication, o_orderkey >= o_custkey % 50 AS counts_possible, o_custkey % 9 <> 0 AS counts_agree, o_custkey % 103 <= 100 AS rates_possible, o_custkey % 700 <= o_orderkey AS adapters_possible,
  round((o_orderkey - o_custkey % 50)::DOUBLE / nullif(o_orderkey, 0), 9) AS retention FROM orders""")  # fmt: skip
def src8_read_qc_reports(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    passed = k - c % 50
    part = lambda reads, q20, q30: F.struct(reads.alias("total_reads"), (reads * 150).alias("total_bases"), (c % q20 / 100).alias("q20_rate"), (c % q30 / 100).alias("q30_rate"))
    filtering = {"passed_filter_reads": passed + (c % 9 == 0).cast("int"), "low_quality_reads": c % 50, "too_many_N_reads": c % 4, "adapter_dimer_reads": c % 3, "too_short_reads": F.lit(0)}
    report = F.struct(
        F.struct(part(k, 90, 80).alias("before_filtering"), part(passed, 103, 100).alias("after_filtering")).alias("summary"),
        F.struct(*[x.alias(name) for name, x in filtering.items()]).alias("filtering_result"),
        F.struct((c % 700).alias("adapter_trimmed_reads"), (c % 700 * 9).alias("adapter_trimmed_bases")).alias("adapter_cutting"),
        F.struct((c % 7 / 10).alias("rate")).alias("duplication"),
    )
    return readers.parse_qc_reports(fx.table(spark, sf_dir, "orders").select(k.cast("string").alias("sample_id"), F.to_json(report).alias("value")))


@query("""SELECT 'P' || (c_nationkey % 9) AS code, min('sp' || (c_custkey % (1 + c_nationkey % 9))) AS species, string_agg(DISTINCT 'pop ' || c_nationkey, '; ' ORDER BY 'pop ' || c_nationkey) AS names, count(DISTINCT 'sp' || (c_custkey % (1 + c_nationkey % 9))) > 1 AS conflict FROM customer GROUP BY 1""")
def src9_read_population_codes(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    m = F.col("c_nationkey") % 9
    s = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return readers.population_codes(c.select(s("P", m).alias("﻿Code (field)"), s("sp", F.col("c_custkey") % (1 + m)).alias("Species"), s("pop ", F.col("c_nationkey")).alias("Population Name")))


@query("""WITH f AS (SELECT o_custkey % 300 AS s, 'raw/x' || (o_custkey % 300) || '_L00' || (o_orderkey % 3) || '_R' || (1 + o_orderkey // 8 % 2) || '.fastq.gz' AS path, 1 + o_orderkey // 8 % 2 AS mate FROM orders), d AS (SELECT DISTINCT * FROM f),
  g AS (SELECT 'x' || s AS sample_id, coalesce(list_sort(list(path) FILTER (WHERE mate = 1)), []) AS a, coalesce(list_sort(list(path) FILTER (WHERE mate = 2)), []) AS b FROM d GROUP BY s)
  SELECT sample_id, array_to_string(a, ';') AS r1_paths, array_to_string(b, ';') AS r2_paths, CASE WHEN len(a) = 0 THEN 'missing_R1' WHEN len(b) = 0 THEN 'missing_R2' WHEN len(a) <> len(b) THEN 'unbalanced_lanes' ELSE 'complete' END AS pair_status FROM g""")  # fmt: skip
def src10_discover_samples(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    mate = 1 + F.floor(F.col("o_orderkey") / 8) % 2
    path = F.concat(F.lit("raw/x"), (F.col("o_custkey") % 300).cast("string"), F.lit("_L00"), (F.col("o_orderkey") % 3).cast("string"), F.lit("_R"), mate.cast("string"), F.lit(".fastq.gz"))
    out = readers.pair_status(o.select(path.alias("path")).distinct())
    return out.withColumns({c: F.array_join(c, ";") for c in ("r1_paths", "r2_paths")})


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def src3_read_table(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    lines = rows.select(F.to_csv(F.struct(*rows.columns), {"sep": "\t"}).alias("value"))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return lines.select(F.from_csv("value", schema, {"sep": "\t", "mode": "FAILFAST"}).alias("r")).select("r.*")


@query(with_ctes("SELECT sample_id, sample_id || ' ' || sample_id || ' 0 0 0 -9 ' || string_agg(a || ' ' || a, ' ' ORDER BY pos) AS value FROM (SELECT sample_id, pos, coalesce(CASE gt WHEN 0 THEN ref WHEN 1 THEN alt END, '0') AS a FROM genotypes WHERE contig = 'c2') GROUP BY sample_id", "genotypes"))
def snk4_write_ped(spark, sf_dir):
    return writers.ped_lines(evidence.haploid_to_diploid(fx.genotypes(spark, sf_dir).filter("contig = 'c2'")))


@query(with_ctes("SELECT DISTINCT contig, pos, contig || chr(9) || contig || '_' || (pos + 1) || chr(9) || '0' || chr(9) || (pos + 1) AS value FROM genotypes", "genotypes"))
def snk4_write_map(spark, sf_dir):
    return writers.map_lines(evidence.haploid_to_diploid(fx.genotypes(spark, sf_dir)))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(CASE WHEN o_custkey % 5 > 0 THEN ((o_custkey % 8) / 8.0::DOUBLE)::VARCHAR END, 'nan') AS share FROM orders")
def snk1_export_columns(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return writers.export_columns(o.select("o_orderkey", F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 8 / 8).alias("share")))


TAXA = [f"t{i:02d}" for i in range(25)]
#: A split per four customers: the nations they are from.
SPLITS = """raw AS (SELECT ((c_custkey // 4) % 2)::VARCHAR AS tree_id, c_custkey // 4 AS sid, list_sort(list(DISTINCT 't' || lpad(c_nationkey::VARCHAR, 2, '0'))) AS members FROM customer GROUP BY ALL),
splits AS (SELECT tree_id, members, max((least(60 + sid % 41, 80 + sid % 21), 60 + sid % 41, 80 + sid % 21)) AS s, sum(sid % 13)::DOUBLE / 100 AS length FROM raw WHERE len(members) >= 2 GROUP BY ALL),
sp AS (SELECT tree_id, members, length, s[2]::DOUBLE AS sh_alrt, s[3]::DOUBLE AS ufboot, s[2] >= 80 AND s[3] >= 95 AS strong FROM (SELECT tree_id, members, length, [s[1], s[2], s[3]] AS s FROM splits))"""


def _raw_splits(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    sid = F.floor(F.col("c_custkey") / 4)
    rows = c.groupBy((sid % 2).cast("string").alias("tree_id"), sid.alias("sid")).agg(F.array_sort(F.collect_set(F.concat(F.lit("t"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))).alias("members"))
    return rows.select("tree_id", "members", (F.col("sid") % 13 / 100).alias("length"), (60 + F.col("sid") % 41).cast("double").alias("sh_alrt"), (80 + F.col("sid") % 21).cast("double").alias("ufboot"))


def _splits(spark, sf_dir):
    return splits.restrict_splits(_raw_splits(spark, sf_dir), TAXA)


@query(f"WITH {SPLITS} SELECT tree_id, array_to_string(members, ',') AS members, round(length, 9) AS length, sh_alrt, ufboot FROM sp")
def gr2_restrict_splits(spark, sf_dir):
    return _splits(spark, sf_dir).withColumn("members", F.array_join("members", ","))


@query(f"WITH {SPLITS} SELECT tree_id, array_to_string(members, ',') AS members, round(length, 9) AS length FROM sp WHERE strong")
def gr2_supported_contraction(spark, sf_dir):
    return splits.supported_contraction(_raw_splits(spark, sf_dir), TAXA).select("tree_id", F.array_join("members", ",").alias("members"), "length")


@query(f"""WITH {SPLITS}, st AS (SELECT tree_id, members, array_to_string(members, ',') AS k FROM sp WHERE strong) SELECT a.tree_id, a.k AS split_1, b.k AS split_2 FROM st a JOIN st b ON a.tree_id = b.tree_id AND a.k < b.k
  WHERE len(list_intersect(a.members, b.members)) > 0 AND len(list_intersect(a.members, b.members)) < len(a.members) AND len(list_intersect(a.members, b.members)) < len(b.members) AND len(a.members) + len(b.members) - len(list_intersect(a.members, b.members)) < 25""")  # fmt: skip
def jn12_incompatible_splits(spark, sf_dir):
    return splits.incompatible_splits(_splits(spark, sf_dir), TAXA)


@query(f"""WITH {SPLITS} SELECT array_to_string(members, ',') AS members, CASE WHEN bool_or(tree_id = '0') THEN 'first' ELSE 'second' END AS only_in FROM sp GROUP BY members HAVING count(DISTINCT tree_id) = 1""")
def set2_symmetric_difference(spark, sf_dir):
    s = _splits(spark, sf_dir)
    out = splits.split_difference(s.filter("tree_id = '0'"), s.filter("tree_id = '1'"))
    return out.withColumn("members", F.array_join("members", ","))


@query(f"""WITH {SPLITS}, j AS (SELECT a.length AS la, b.length AS lb, coalesce(a.strong, false) AS sa, coalesce(b.strong, false) AS sb FROM (SELECT * FROM sp WHERE tree_id = '0') a FULL JOIN (SELECT * FROM sp WHERE tree_id = '1') b USING (members))
  SELECT count(la) AS splits_1, count(lb) AS splits_2, count(*) FILTER (WHERE (la IS NULL) <> (lb IS NULL)) AS rf, count(*) FILTER (WHERE sa <> sb) AS strong_difference, round(max(abs(la - lb)) FILTER (WHERE sa AND sb), 9) AS max_length_difference,
  round(count(*) FILTER (WHERE (la IS NULL) <> (lb IS NULL))::DOUBLE / (count(la) + count(lb)), 9) AS normalised_rf FROM j""")  # fmt: skip
def gr3_compare_trees(spark, sf_dir):
    return splits.compare_trees(_splits(spark, sf_dir), "0", "1")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (60 + o_orderkey % 41)::DOUBLE END AS sh_alrt, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (80 + o_custkey % 21)::DOUBLE END AS ufboot, o_orderkey % 5 <> 0 AS valid, coalesce(o_orderkey % 5 <> 0 AND 60 + o_orderkey % 41 >= 80 AND 80 + o_custkey % 21 >= 95, false) AS strong FROM orders")
def prj12_strong_support(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.when(k % 10 == 0, "x").when(k % 5 == 0, "90").otherwise(F.concat_ws("/", (60 + k % 41).cast("string"), (80 + F.col("o_custkey") % 21).cast("string")))
    out = fx.table(spark, sf_dir, "orders").select(k.alias("id"), splits.support_of(label).alias("s")).select("id", "s.*")
    return out.withColumn("strong", splits.is_strong(F.col("sh_alrt"), F.col("ufboot")))


@query(with_ctes(", a AS (SELECT sample_id, row_number() OVER (ORDER BY popcode, sample_id)::INT AS p FROM samples), b AS (SELECT sample_id, row_number() OVER (ORDER BY taxon, sample_id)::INT AS p FROM samples WHERE sample_id % 6 > 0) SELECT a.sample_id AS tip, a.p AS place_1, b.p AS place_2, CASE WHEN a.sample_id % 8 = 0 THEN a.sample_id - 1 ELSE a.sample_id END AS representative FROM a JOIN b USING (sample_id)", "samples"))
def jn13_tip_alignment(spark, sf_dir):
    from ..operators.presentation import tip_order

    s = fx.samples(spark, sf_dir)
    tips = lambda df, by: tip_order(df, "sample_id", by).select(F.col("sample_id").alias("tip"), "place")
    return splits.tip_alignment(tips(s, "popcode"), tips(s.filter("sample_id % 6 > 0"), "taxon"), s.filter("sample_id % 8 = 0").select(F.col("sample_id").alias("tip"), (F.col("sample_id") - 1).alias("representative")))


#: A tree per taxon: its nations as inner nodes over their samples.
@query(with_ctes(""", t AS (SELECT taxon, popcode, list_sort(list('s' || sample_id)) AS m, count(*) AS n, min(nk) AS nk FROM samples GROUP BY ALL), u AS (SELECT taxon, sum(n) AS total, list_sort(flatten(list(m))) AS taxa FROM t GROUP BY taxon), w AS (SELECT t.*, u.total, list_sort(list_filter(u.taxa, lambda x: NOT list_contains(t.m, x))) AS other FROM t JOIN u USING (taxon) WHERE n >= 2 AND total - n >= 2)
  SELECT taxon AS tree_id, array_to_string(CASE WHEN n < total - n OR (n = total - n AND array_to_string(m, chr(9)) <= array_to_string(other, chr(9))) THEN m ELSE other END, ',') AS members, (nk / 100.0)::DOUBLE AS length, (70 + nk)::DOUBLE AS sh_alrt, (75 + nk)::DOUBLE AS ufboot FROM w""", "samples"))  # fmt: skip
def src12_trees_to_splits(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    inner = s.groupBy("taxon", "popcode", "nk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("sample_id")), lambda x: F.concat(F.lit("s"), x.cast("string"), F.lit(":0.5"))), ",").alias("tips"))
    label = F.concat((70 + F.col("nk")).cast("string"), F.lit("/"), (75 + F.col("nk")).cast("string"), F.lit(":"), (F.col("nk") / 100).cast("string"))
    trees = inner.groupBy(F.col("taxon").alias("tree_id")).agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("("), F.col("tips"), F.lit(")"), label))), ","), F.lit(");")).alias("newick"))
    out = splits.edge_splits(splits.newick_edges(trees))
    return out.withColumn("members", F.array_join("members", ","))


@query(f"WITH {SPLITS} SELECT tree_id, array_to_string(members, ',') AS members, round(length, 9) AS length, 25::INT AS n_taxa FROM sp")
def src11_read_splits(spark, sf_dir):
    s = _splits(spark, sf_dir)
    names = F.array(*map(F.lit, TAXA))
    number = F.array_join(F.transform("members", lambda m: F.array_position(names, m).cast("string")), " ")
    rows = s.groupBy("tree_id").agg(F.array_join(F.collect_list(F.concat(F.lit("[1, size=2]\t"), (F.round(F.col("length") * 100, 6)).cast("string"), F.lit("\t"), number, F.lit(","))), "\n").alias("m"))
    taxlabels = "\n".join(f"[{i + 1}] '{t}'" for i, t in enumerate(TAXA))
    text = F.concat(F.lit(f"#nexus\nBEGIN taxa;\nTAXLABELS\n{taxlabels}\n;\nEND;\nBEGIN splits;\nMATRIX\n"), F.col("m"), F.lit("\n;\nEND;\n"))
    return readers.parse_split_nexus(rows.select("tree_id", text.alias("value"))).withColumn("members", F.array_join("members", ","))


@query("""WITH a AS (SELECT n_name AS contig, count(*) FILTER (WHERE c_custkey % 7 = 0) AS area_1, count(*) FILTER (WHERE c_custkey % 7 = 1) AS area_2, count(*) FILTER (WHERE c_custkey % 7 = 2) AS area_3, count(*) FILTER (WHERE c_custkey % 7 = 3) AS area_4, count(*) FILTER (WHERE c_custkey % 7 = 4) AS area_5, count(*) FILTER (WHERE c_custkey % 7 = 5) AS area_6, count(*) FILTER (WHERE c_custkey % 7 = 6) AS area_7, count(*)::DOUBLE AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT contig, 'primary' AS run, area_1, area_2, area_3, area_4, area_5, area_6, area_7, round((area_1 + area_2 + area_3) / n, 9) AS resolved, round((area_4 + area_5 + area_6) / n, 9) AS side, round(area_7 / n, 9) AS centre FROM a""")  # fmt: skip
def src14_parse_report_regions(spark, sf_dir):
    c, n = fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "nation")
    counts = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("contig")).agg(*[F.count_if(F.col("c_custkey") % 7 == i).alias(f"a{i}") for i in range(7)])
    text = F.concat_ws("\n", F.lit("LIKELIHOOD MAPPING\n region | count"), *[F.concat(F.lit(f"  {i + 1}  | "), F.col(f"a{i}").cast("string"), F.lit(" ( 10.0 %)")) for i in range(7)])
    return readers.parse_report_regions(counts.select("contig", F.lit("primary").alias("run"), text.alias("value")))
