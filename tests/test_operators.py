"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from haplospark.functions import columns as fn
from haplospark.operators import calls as co
from haplospark.operators import distance, evidence, haplotypes, identity, intervals, popgen, quality, resampling, sensitivity, splits
from haplospark.sources import readers, writers


def calls_of(spark, samples, ref=None, contig="c1"):
    """samples: (sample_id, popcode, sequence)."""
    rows = [(contig, i, p, pos, (ref or "N" * len(s))[pos], b) for i, p, s in samples for pos, b in enumerate(s)]
    return spark.createDataFrame(rows, "contig string, sample_id long, popcode string, pos int, ref string, base string")


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_nucleotide_diversity(spark):
    one = popgen.nucleotide_diversity(calls_of(spark, [(1, "P", "AAAA"), (2, "P", "AAAT")])).first()
    assert (one.differences, one.joint_sites, one.pi) == (1, 4, 0.25)
    two = popgen.nucleotide_diversity(calls_of(spark, [(1, "P", "AN"), (2, "P", "AT"), (3, "P", "AT")])).first()
    assert (two.joint_sites, two.compared) == (1, 3)
    alone = popgen.nucleotide_diversity(calls_of(spark, [(1, "P", "AC")])).first()
    assert alone.pi is None


@pytest.mark.parametrize(
    ("p", "q", "sites", "fst"),
    [(("ACA", "ACT"), ("AGT", "AGT"), 3, 2 / 3), (("G", "C", "C"), ("C", "G"), 1, -2 / 3), (("AN", "AN"), ("TT", "TA"), 1, 1.0), (("GN", "NN"), ("GG", "GG"), 0, None)],
)
def test_hudson_fst(spark, p, q, sites, fst):
    rows = [(i, "P", s) for i, s in enumerate(p)] + [(10 + i, "Q", s) for i, s in enumerate(q)]
    r = popgen.hudson_fst(calls_of(spark, rows)).first()
    assert r.callable_sites == sites
    assert r.fst == (pytest.approx(fst) if fst is not None else None)


def test_hudson_blocks_keep_invariant_ones(spark):
    rows = [(i, "P" if i < 2 else "Q", "AAAA") for i in range(4)]
    assert table(popgen.hudson_blocks(calls_of(spark, rows), 2), "block", "numerator", "denominator") == [(0, 0.0, 0.0), (1, 0.0, 0.0)]


def test_haplotype_diversity(spark):
    rows = [("c", "P", h) for h in ("H1", "H1", "H1", "H2", "H3", "AMBIGUOUS")] + [("c", "Q", "AMBIGUOUS"), ("c", "Q", "AMBIGUOUS"), ("c", "R", "H9")]
    got = {r.popcode: r.diversity for r in popgen.haplotype_diversity(spark.createDataFrame(rows, "contig string, popcode string, haplotype string")).collect()}
    assert got["P"] == pytest.approx(0.7) and got["Q"] is None and got["R"] == 0.0


def test_private_variants(spark):
    rows = [(1, "P", "TAT"), (2, "P", "TAN"), (3, "Q", "AAT"), (4, "Q", "ACT"), (5, None, "GGG")]
    c = calls_of(spark, rows, ref="AAA")
    assert table(popgen.private_variants(c), "popcode", "private_sites") == [("P", 1), ("Q", 1)]
    assert table(popgen.private_variants(c, strict=True), "popcode", "private_sites") == [("P", 1), ("Q", 1)]


def test_pairwise_distance(spark):
    c = calls_of(spark, [(1, "P", "AaNC?T"), (2, "P", "ATGCGN"), (3, "P", "NNNNNN")])
    got = {(r.sample_1, r.sample_2): (r.differences, r.sites_compared, r.p_distance) for r in distance.pairwise_distance(c).collect()}
    assert got[1, 2] == (1, 3, pytest.approx(1 / 3)) and got[1, 3] == (0, 0, None)
    long = calls_of(spark, [(1, "P", "ACGT" * 40), (2, "P", "ACGA" * 40)])
    r = distance.pairwise_distance(long).first()
    assert (r.differences, r.sites_compared) == (40, 160)
    assert distance.distance_errors(distance.pairwise_distance(c)).isEmpty()


def test_distance_matrix(spark):
    c = calls_of(spark, [(1, "P", "AAA"), (2, "P", "AAT"), (3, "P", "ATT")])
    m = {r["row"]: (r["2"], r["1"], r["3"]) for r in distance.distance_matrix(distance.pairwise_distance(c), "differences", [2, 1, 3]).collect()}
    assert m == {1: (1, 0, 2), 2: (0, 1, 1), 3: (1, 2, 0)}


def test_reference_call(spark):
    rows = [("A", ["T"], [0, 30, 60], 5), ("A", ["T"], [0, 30, 19], 5), ("A", ["T"], [0, 30], 5), ("AC", ["T"], [0, 30, 60], 5), ("A", ["T", "G"], [0, 9, 40, 9, 9, 25], 5), ("A", ["T"], [0, 30, 60], 4)]
    df = spark.createDataFrame(rows, "ref string, alts array<string>, pl array<int>, dp int")
    got = [r[0] for r in df.select(evidence.reference_call(F.col("pl"), F.col("ref"), F.col("alts"), F.col("dp"))).collect()]
    assert got == [True, False, False, False, True, False]


def test_callable_sequence(spark):
    s = "contig string, sample_id int, pos int, base string"
    ref = spark.createDataFrame([("c", p, b) for p, b in enumerate("ACGT")], "contig string, pos int, ref string")
    inv = spark.createDataFrame([("c", 1, 0, "A"), ("c", 1, 1, "C")], s)
    var = spark.createDataFrame([("c", 1, 1, "T"), ("c", 1, 2, "GG"), ("c", 1, 3, "A")], s)
    accepted = spark.createDataFrame([("c", 1), ("c", 2)], "contig string, pos int")
    out = evidence.callable_sequence(ref, inv, var, accepted)
    assert "".join(r.base for r in out.orderBy("pos").collect()) == "ATNN"


def test_genotype_filters(spark):
    g = spark.createDataFrame([(5, 20, 1), (4, 20, 1), (5, 19, 1), (None, 30, 0)], "dp int, gq int, gt int")
    assert [r.gt for r in evidence.mask_genotypes(g).collect()] == [1, None, None, None]
    rows = [("c", 0, "A", "T", i, x, 40.0) for i, x in enumerate((0, 0, 0, 1))]
    sites = spark.createDataFrame(rows, "contig string, pos int, ref string, alt string, sample_id int, gt int, qual double")
    assert evidence.site_filter(sites, 1).count() == 1 and evidence.site_filter(sites, 2).count() == 0


def test_intervals(spark):
    i = spark.createDataFrame([(9, 11), (2, 9), (14, 15), (22, 24), (20, 26)], "start int, end int")
    assert table(intervals.merge_intervals(i), "start", "end") == [(2, 11), (14, 15), (20, 26)]
    assert intervals.covered_bases(i).first().bases == 16
    assert table(intervals.complement_intervals(i, 30), "start", "end") == [(0, 2), (11, 14), (15, 20), (26, 30)]
    support = spark.createDataFrame([(p, s, 5) for p, s in enumerate((3, 4, 4, 1, 4, 5, 4, 2, 4))], "pos int, support int, n int")
    for ceiling in (False, True):
        assert table(intervals.support_islands(support, "n", 0.8, 2, ceiling=ceiling), "start", "end") == [(1, 3), (4, 7)]
    f = spark.createDataFrame([("a", 3, 7), ("b", 10, 16), ("c", 11, 14)], "k string, start int, end int")
    got = table(intervals.interval_overlap(f, i, "k", bin_size=4), "k", "overlap", "class")
    assert got == [("a", 4, "full"), ("b", 2, "partial"), ("c", 0, "none")]


def test_hits(spark):
    rows = [(1, "q", "s", 96.0, 50, 1, 50, 11, 60, 80.0, 90, 90), (2, "q", "s", 70.0, 50, 31, 80, 75, 26, 40.0, 90, 90)]
    h = spark.createDataFrame(rows, "hit_no int, query string, subject string, identity double, length int, qstart int, qend int, sstart int, send int, bitscore double, qlen int, slen int")
    r = intervals.weighted_identity(h).first()
    assert (r.identity, r.same_strand, r.reverse_strand) == (pytest.approx(86.25), 50, 30)
    assert intervals.best_hit_per_feature(h).first().hit_no == 1


def test_site_counts_and_depth(spark):
    c = calls_of(spark, [(1, "P", "AAT"), (2, "P", "AAT"), (3, "P", "ATG"), (4, "P", "CTN")])
    r = co.site_counts(c).first()
    assert (r.variable, r.informative) == (3, 1)
    d = spark.createDataFrame([("c", 1, p, x) for p, x in enumerate((0, 1, 3, 5, 10))], "contig string, sample_id int, pos int, depth int")
    r = evidence.depth_summary(d).first()
    assert (r.mean_depth, r.breadth_dp1, r.breadth_dp3, r.breadth_dp5, r.breadth_dp10) == (3.8, 0.8, 0.6, 0.4, 0.2)


def test_restrict_to_mask(spark):
    m = spark.createDataFrame([(1, 3), (4, 6)], "start int, end int")
    out = co.collapse_calls(co.restrict_to_mask(calls_of(spark, [(1, "P", "AACCGG")]), m))
    assert out.first().seq == "ACGG"
    assert co.restricted_length_errors(out, 4).isEmpty() and not co.restricted_length_errors(out, 5).isEmpty()


def test_haplotype_labels(spark):
    c = calls_of(spark, [(1, "P", "AN"), (2, "P", "AA"), (3, "P", "AT")])
    assert table(haplotypes.haplotype_labels(c), "sample_id", "haplotype") == [(1, "AMBIGUOUS"), (2, "H1"), (3, "H2")]
    same = calls_of(spark, [(1, "P", "AN"), (2, "P", "AA")])
    assert {r.haplotype for r in haplotypes.haplotype_labels(same).collect()} == {"H1"}


def test_spanning_network_is_unique(spark):
    rows = [("c", a, b, w) for a, b, w in (("H1", "H2", 1), ("H1", "H3", 1), ("H2", "H3", 1), ("H3", "H4", 2), ("H1", "H4", 2), ("H4", "H5", 1), ("H1", "H5", 3))]
    out = haplotypes.spanning_network(spark.createDataFrame(rows, "contig string, h1 string, h2 string, weight int"))
    assert table(out, "h1", "h2", "weight") == [("H1", "H2", 1), ("H1", "H3", 1), ("H1", "H4", 2), ("H4", "H5", 1)]


def test_pca_inputs(spark):
    rows = [("c", 0, s, g) for s, g in ((1, 0), (2, 1), (3, None))] + [("c", 1, s, 1) for s in (1, 2, 3)]
    z = resampling.pca_inputs(spark.createDataFrame(rows, "contig string, pos int, sample_id long, g int"))
    values = [r.z for r in z.collect()]
    assert len(values) == 3 and sum(values) == pytest.approx(0) and sum(v * v for v in values) / 3 == pytest.approx(1)


def test_procrustes_of_a_rotated_copy(spark):
    points = [(i, (i * 7 % 11) / 3, (i * 5 % 13) / 4) for i in range(12)]
    one = [("c", i, k, v) for i, x, y in points for k, v in ((1, x), (2, y))]
    two = [("c", i, k, v) for i, x, y in points for k, v in ((1, -y), (2, x))]
    s = "contig string, sample_id long, component int, value double"
    r = resampling.procrustes_test(spark.createDataFrame(one, s), spark.createDataFrame(two, s), 49).first()
    assert r.r > 0.999 and r.n == 12 and r.p == pytest.approx(0.02)


def test_spearman(spark):
    df = spark.createDataFrame([(0.1, 0.2), (float("nan"), 0.4), (0.9, 0.8)], "x double, y double")
    r = fn.spearman(df, "x", "y").first()
    assert (r.rho, r.n_pairs, r.n_dropped) == (pytest.approx(1.0), 2, 1)
    flat = spark.createDataFrame([(1.0, 0.2), (1.0, 0.4)], "x double, y double")
    assert fn.spearman(flat, "x", "y").first().rho is None


def test_bh_and_order_statistics(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double")
    assert [round(r.q, 9) for r in fn.bh_adjust(df, "p").orderBy("i").collect()] == [0.03, 0.04, 0.04]
    x = spark.createDataFrame([(float(v),) for v in range(10)], "v double")
    assert tuple(x.agg(fn.order_statistic(F.col("v"), 0.025), fn.order_statistic(F.col("v"), 0.975)).first()) == (0.0, 8.0)


def test_joint_ratio(spark):
    df = spark.createDataFrame([(float("nan"), 9.2), (2.0, 4.0), (0.0, 0.0)], "a double, b double")
    r = popgen.joint_ratio(df, "a", "b").first()
    assert (r.sites, r.ratio) == (2, 0.5)


def test_rank_extremes_puts_transitions_first(spark):
    rows = [("z", 0.0, 1e-6)] + [(f"k{i:02d}", 1.0, 1.0 + i) for i in range(1, 13)] + [("same", 1.0, 1.0)]
    out = sensitivity.rank_extremes(spark.createDataFrame(rows, "k string, baseline double, scenario double"), "pi", 10, "k").orderBy("rank").collect()
    assert len(out) == 10 and out[0].k == "z" and out[1].k == "k12"


def test_ladders(spark):
    df = spark.createDataFrame([(0.96, 0.05), (0.92, 0.2), (0.5, 0.0)], "r double, c double")
    assert [x[0] for x in df.select(sensitivity.classify_pi(F.col("r"), F.col("c"))).collect()] == ["PASS", "CAVEAT", "FAIL"]
    d = spark.createDataFrame([(0.2, 0.1, True), (0.1, 0.3, True), (0.1, 0.3, False)], "c double, s double, x boolean")
    assert [x[0] for x in d.select(sensitivity.likelihood_decision(F.col("c"), F.col("s"), F.col("x"))).collect()] == ["insufficient", "network", "tree_like"]


def test_trees(spark):
    trees = [("a", "((A:1,B:1)90/99:2,(C:1,D:1)85/96:1,E:3);"), ("b", "(E:3,(D:1,C:1)85/96:1,(B:1,A:1)90/99:2);"), ("c", "((A:1,C:1)90/99:2,(B:1,D:1)10/20:1,E:3);")]
    s = splits.edge_splits(splits.newick_edges(spark.createDataFrame(trees, "tree_id string, newick string")))
    same, other = (splits.compare_trees(s, "a", t).first() for t in "bc")
    assert (same.splits_1, same.rf, same.normalised_rf, same.strong_difference, same.max_length_difference) == (2, 0, 0.0, 0, 0.0)
    assert (other.rf, other.normalised_rf, other.strong_difference) == (4, 1.0, 3)
    both = s.filter("tree_id in ('a', 'c')").withColumn("tree_id", F.lit("x"))
    assert table(splits.incompatible_splits(both, list("ABCDE")), "split_1", "split_2") == [("A,B", "A,C"), ("A,C", "C,D")]


def test_splits_of_a_deep_tree(spark):
    n = 300
    text = "t0"
    for i in range(1, n):
        text = f"({text},t{i})90/99:1"
    s = splits.edge_splits(splits.newick_edges(spark.createDataFrame([("deep", text + ";"), ("one", "(a,b,c);")], "tree_id string, newick string")))
    names = [f"t{i}" for i in range(n)]
    sides = lambda k: min((sorted(names[:k]), sorted(names[k:])), key=lambda x: (len(x), "\t".join(x)))
    assert table(s, "members") == sorted((sides(k),) for k in range(2, n - 1)) and not s.filter("tree_id = 'one'").count()


def test_network_equals_kruskal(spark):
    import random

    r = random.Random(4)
    haps = {f"H{i}": "".join(r.choice("AC") for _ in range(12)) for i in range(1, 41)}
    rows = [("c", h, s) for h, s in haps.items()]
    distances = haplotypes.haplotype_distances(spark.createDataFrame(rows, "contig string, haplotype string, haplotype_seq string"))
    root = {h: h for h in haps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for w, a, b in sorted((sum(x != y for x, y in zip(haps[a], haps[b], strict=True)), a, b) for a in haps for b in haps if a < b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert table(haplotypes.spanning_network(distances), "h1", "h2", "weight") == sorted(want)


def test_reports_have_all_metrics_and_checks(spark):
    import json

    def report(sample, reads=100, passed=90, told=90, q=0.9, cut=5, **without):
        totals = lambda n: {"total_reads": n, "total_bases": n * 10, "q20_rate": q, "q30_rate": 0.5}
        out = {"summary": {"before_filtering": totals(reads), "after_filtering": totals(passed)}, "duplication": {"rate": 0.25}, "adapter_cutting": {"adapter_trimmed_reads": cut, "adapter_trimmed_bases": 33}}
        out["filtering_result"] = {"passed_filter_reads": told, "low_quality_reads": 4, "too_many_N_reads": 3, "adapter_dimer_reads": 2, "too_short_reads": 1}
        return sample, json.dumps({k: v for k, v in out.items() if k not in without})

    rows = [report("fine"), report("told", told=91), report("more", passed=101, told=101), report("rate", q=1.2), report("cut", cut=101), report("none", adapter_cutting=1)]
    out = {r.sample_id: r for r in readers.parse_qc_reports(spark.createDataFrame(rows, "sample_id string, value string")).collect()}
    checks = ("counts_possible", "counts_agree", "rates_possible", "adapters_possible")
    assert {s: [c for c in checks if not r[c]] for s, r in out.items()} == {"fine": [], "told": ["counts_agree"], "more": ["counts_possible"], "rate": ["rates_possible"], "cut": ["adapters_possible"], "none": ["adapters_possible"]}
    fine = out["fine"]
    assert (fine.input_q20_rate, fine.too_many_n_reads, fine.adapter_dimer_reads, fine.adapter_trimmed_bases, fine.retention) == (0.9, 3, 2, 33, 0.9)


def test_mixed_allele_screen(spark):
    rows = [(1, 30, [15, 15])] * 12 + [(1, 30, [30, 0])] * 8 + [(s, 30, [30, 0]) for s in (2, 3, 4) for _ in range(20)]
    out = evidence.mixed_allele_screen(spark.createDataFrame(rows, "sample_id int, dp int, ad array<int>"))
    assert table(out, "sample_id", "mixed", "suspected") == [(1, 12, True), (2, 0, False), (3, 0, False), (4, 0, False)]


def test_identity(spark):
    s = spark.createDataFrame([("CY_SIE_12",), ("CY_1",), ("XX7",)], "sample_id string")
    codes = spark.createDataFrame([("CY",), ("CY_SIE",)], "code string")
    assert table(identity.longest_prefix_match(s, codes), "sample_id", "popcode") == [("CY_1", "CY"), ("CY_SIE_12", "CY_SIE"), ("XX7", "XX")]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a int, b int")
    assert table(identity.dedupe_pairs(pairs, "a", "b"), "a", "b") == [(1, 2)]


def test_quality_checks(spark):
    a = spark.createDataFrame([("x", 1, "d1"), ("y", 1, "d2"), ("z", 1, "d3")], "path string, size_bytes int, digest string")
    b = spark.createDataFrame([("x", 1, "d1"), ("y", 1, "dd"), ("w", 1, "d4")], "path string, size_bytes int, digest string")
    assert table(quality.reconcile_manifests(a, b), "path", "status") == [("w", "unlisted"), ("x", "match"), ("y", "mismatch"), ("z", "missing")]
    gate = quality.acceptance_gate(ok=a.limit(0), bad=a)
    assert table(gate, "check", "violations", "status") == [("bad", 3, "FAIL"), ("ok", 0, "PASS")]


def test_formats_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("s1", "ACGTN" * 33), ("s2", "A" * 160)], "sample_id string, seq string")
    writers.write_sequences(seqs, str(tmp_path / "a.fa"))
    assert table(readers.read_alignment(spark, str(tmp_path / "a.fa")), "sample_id", "seq") == [("s1", "ACGTN" * 33), ("s2", "A" * 160)]
    vcf = tmp_path / "g.vcf"
    vcf.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tgood\tbad\nc\t7\t.\tA\tT\t50\t.\t.\tGT:DP:GQ\t1:9:30\t.:3:.\n")
    assert table(readers.read_genotypes(spark, str(vcf)), "sample_id", "pos", "gt", "dp", "gq") == [("bad", 7, None, 3, None), ("good", 7, 1, 9, 30)]
    writers.write_table(spark.createDataFrame([(1, 0.1 + 0.2), (2, None)], "k int, v double"), str(tmp_path / "t.tsv"), "k")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t.tsv").glob("part-*")))
    assert text == "k\tv\n1\t0.3\n2\tnan\n"
    depth = tmp_path / "d.tsv"
    depth.write_text("c\t1\t4\nc\t2\t0\n")
    assert table(readers.read_depth(spark, str(depth)), "pos", "depth") == [(0, 4), (1, 0)]
    bed = tmp_path / "m.bed"
    bed.write_text("# mask\n\nc\t1\t3\tx\nd\t4\t6\n")
    assert table(readers.read_intervals(spark, str(bed), "c"), "start", "end") == [(1, 3)]
    for name in ("x_L001_R1.fastq.gz", "x_L001_R2.fastq.gz", "y_R1.fastq.gz"):
        (tmp_path / name).write_bytes(b"x")
    assert table(readers.discover_samples(spark, str(tmp_path)), "sample_id", "pair_status") == [("x", "complete"), ("y", "missing_R2")]
    assert {r.md5 for r in readers.file_inventory(spark, str(tmp_path)).filter("path like '%fastq.gz'").collect()} == {"9dd4e461268c8034f5c8564e155c67a6"}
