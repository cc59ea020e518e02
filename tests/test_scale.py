"""Operators whose work is dealt to blocks, bins and rounds, beside dense or brute-force versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospark.functions import columns as fn
from haplospark.functions import ranks
from haplospark.operators import haplotypes, intervals, ordination, resampling, scenarios, sketches


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ordination


def standardised(n, m, seed):
    r = np.random.default_rng(seed)
    z = r.normal(size=(m, n)) + 3 * r.normal(size=(m, 4)) @ (r.random((4, n)) > 0.6)
    z -= z.mean(1, keepdims=True)
    return z / z.std(1, keepdims=True)


def long_form(spark, *matrices):
    rows = [(f"c{k}", p * 3, s * 7, float(z[p, s])) for k, z in enumerate(matrices) for p in range(z.shape[0]) for s in range(z.shape[1])]
    return spark.createDataFrame(rows, "contig string, pos int, sample_id long, z double")


def dense_pca(z, components=10):
    values, vectors = np.linalg.eigh(z.T @ z)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = min(components, z.shape[1] - 1, z.shape[0])
    c = vectors[:, :k] * np.sqrt(values[:k])
    return c * np.where(c[np.abs(c).argmax(0), np.arange(k)] < 0, -1, 1), values[:k] / values.sum()


@pytest.mark.parametrize("full", [128, 20])
def test_pca_equals_the_dense_solution(spark, monkeypatch, full):
    """Two contigs of other sizes in blocks of 16; above ``full`` the subspace grows by products and restarts."""
    monkeypatch.setattr(ordination, "FULL", full)
    one, two = standardised(48, 60, 1), standardised(30, 7, 2)
    inputs = long_form(spark, one, two)
    got = ordination.haploid_pca(inputs, block=16)
    found = collections.defaultdict(dict)
    for r in got.collect():
        found[r.contig, r.component][r.sample_id // 7] = (r.value, r.explained)
    for name, z in (("c0", one), ("c1", two)):
        want, share = dense_pca(z)
        assert {k for c, k in found if c == name} == set(range(1, want.shape[1] + 1))
        for k in range(want.shape[1]):
            values = np.array([found[name, k + 1][s][0] for s in range(z.shape[1])])
            assert np.abs(values - want[:, k]).max() < 1e-7 and found[name, k + 1][0][1] == pytest.approx(share[k], abs=1e-9)
    checks = {r.contig: r for r in ordination.pca_checks(inputs, got).collect()}
    assert (checks["c0"].components, checks["c1"].components) == (10, 7) and all(r.residual < 1e-8 and r.overlap < 1e-8 for r in checks.values())


def test_pca_of_low_rank_and_of_too_few_markers(spark):
    z = standardised(12, 1, 3)
    with pytest.raises(ValueError, match="two components"):
        ordination.haploid_pca(long_form(spark, z))
    got = ordination.haploid_pca(long_form(spark, np.vstack([z, -z, z])), block=8)  # three markers of rank one
    size = {r.component: r.s for r in got.groupBy("component").agg(F.sum(F.abs("value")).alias("s")).collect()}
    assert size[1] > 1 and size[2] < 1e-6 and size[3] < 1e-6


def test_gram_matrix_in_blocks(spark):
    z = standardised(23, 31, 4)
    got = {(r.s1, r.s2): r.dot for r in ordination.gram_matrix(long_form(spark, z), block=8).collect()}
    g = z.T @ z
    assert len(got) == 23 * 24 // 2 and all(got[a * 7, b * 7] == pytest.approx(g[a, b], abs=1e-9) for a in range(23) for b in range(a, 23))


def test_a_stage_of_the_pca_has_one_python_step(spark, monkeypatch):
    """Orthonormal directions come from the rows that were written: no Python step reads from another one in its stage."""
    plans = []
    cut, totals = ordination.cut, ordination._totals
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    monkeypatch.setattr(ordination, "cut", lambda df: cut(seen(df)))
    monkeypatch.setattr(ordination, "_totals", lambda state, *a: totals(seen(state), *a))
    monkeypatch.setattr(ordination, "FULL", 20)
    monkeypatch.setattr(ordination, "STEPS", 2)
    ordination.haploid_pca(long_form(spark, standardised(40, 50, 8)), block=16)
    state = [p for p in plans if ("gk#" in p or "y#" in p) and "cells#" not in p and "parquet" in p]
    assert len(state) > 6 and all(p.count("MapInArrow") <= 1 for p in state)


def test_products_of_sample_blocks_are_never_shuffled(spark, monkeypatch):
    """Two contigs, blocks that lack samples in some marker blocks, and slices smaller than a block."""
    monkeypatch.setattr(ordination, "SENT", 20)
    one, two = standardised(30, 40, 5), standardised(9, 6, 6)
    inputs = long_form(spark, one, two).filter("not (sample_id = 14 and pos > 30)")
    one[11:, 2] = 0
    got = ordination.gram_matrix(inputs, block=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan and "Exchange" not in plan.split("MapInArrow")[0]
    rows = got.collect()
    found = {(r.contig, r.s1, r.s2): r.dot for r in rows}
    assert len(rows) == len(found) == 30 * 31 // 2 + 9 * 10 // 2
    for name, z in (("c0", one), ("c1", two)):
        g = z.T @ z
        assert all(found[name, a * 7, b * 7] == pytest.approx(g[a, b], abs=1e-9) for a in range(len(g)) for b in range(a, len(g)))


# permutations


def test_permutations_within_rows(spark):
    """The count of replicates as far from 0 as the observed one, ties included, in whole numbers."""
    r = random.Random(3)
    rows = [("g", i, float(r.randint(0, 5)), float(r.randint(0, 4))) for i in range(17)] + [("h", i, float(i), float(i * i)) for i in range(4)] + [("k", 1, 1.0, None)]
    out = {x.grp: x for x in resampling.permutation_spearman(spark.createDataFrame(rows, "grp string, id long, x double, y double"), "x", "y", "id", "grp", permutations=150).collect()}

    def ranks(v):
        return [2 * sum(b < a for b in v) + sum(b == a for b in v) + 1 for a in v]

    for name in ("g", "h"):
        own = sorted((i, x, y) for g, i, x, y in rows if g == name)
        rx, ry, n = ranks([x for _, x, _ in own]), ranks([y for *_, y in own]), len(own)
        far = lambda y, rx=rx, n=n: abs(n * sum(a * b for a, b in zip(rx, y, strict=True)) - sum(rx) * sum(y))
        k = 0
        for rep in range(150):
            order = sorted(range(n), key=lambda j, rep=rep, own=own: (hashlib.md5(f"1729:{name}:{rep}:{own[j][0]}".encode()).hexdigest()[:8], own[j][0]))
            k += far([ry[j] for j in order]) >= far(ry)
        assert out[name].p == pytest.approx((k + 1) / 151) and out[name].n == n
    assert out["h"].rho == pytest.approx(1.0)


# sketches


def brute_sketch(texts, k, size):
    """Plain Python: the least hashes of the canonical k-mers of some texts."""
    found = set()
    for t in texts:
        for i in range(len(t or "") - k + 1):
            s = t[i : i + k].upper()
            if set(s) <= set("ACGT"):
                own = [int("".join(str("ACGT".index(b)) for b in x), 4) for x in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))]
                x = min(own)
                x = (x ^ x >> 31) * sketches.FACTOR % (1 << 64)
                found.add(x ^ x >> 29)
    return sorted(found)[:size]


def test_sketches_merge_to_the_sketch_of_all_records(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.choice("xyz"), "".join(r.choice("ACGTacgtN") for _ in range(r.randint(0, 120)))) for _ in range(120)] + [("x", None), ("empty", "ACG"), (None, "ACGTTGCATGGA" * 4)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(13)
    monkeypatch.setattr(sketches, "FAN", 3)
    for size in (20, 5000):
        got = {x.key: np.frombuffer(bytes(x.hashes), np.uint64).tolist() for x in sketches.bottom_sketches(df, "name", "text", 9, size).collect()}
        want = {n: brute_sketch([t for m, t in rows if m == n], 9, size) for n in {n for n, _ in rows}}
        assert got == {n: s for n, s in want.items() if s}


def test_near_sketches_equal_all_pairs(spark, monkeypatch):
    """Families of near and equal texts, more of them than a block of a hot hash holds, beside all pairs by brute force."""
    monkeypatch.setattr(sketches, "HOT", 4)
    r = random.Random(6)
    bases = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(44):
        t = list(bases[i % 4])
        for _ in range(i // 12):
            t[r.randrange(300)] = r.choice("ACGT")
        rows.append((i, "".join(t)))
    rows += [(100, "ACGT"), (101, None), (102, bases[0][:150])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for size, cutoff in ((60, 0.02), (400, 0.01), (60, 0.0)):
        own = {i: brute_sketch([t], 11, size) for i, t in rows}
        own = {i: s for i, s in own.items() if s}
        want = []
        for a in own:
            for b in own:
                if a < b:
                    union = sorted(set(own[a]) | set(own[b]))[:size]
                    shared = len(set(own[a]) & set(own[b]) & set(union))
                    j = shared / len(union)
                    if shared and -np.log(2 * j / (1 + j)) / 11 <= cutoff:
                        want.append((a, b, shared))
        got = sketches.near_sketches(sketches.bottom_sketches(df, "id", "text", 11, size), cutoff, 11, size)
        assert table(got, "key_1", "key_2", "shared") == sorted(want) and want


def test_only_hashes_that_meet_become_rows(spark, monkeypatch):
    """Of two near sketches and one apart, rows are the shared hashes of prefixes alone; which hashes count as common changes no pair."""
    r = random.Random(15)
    one, other = ("".join(r.choice("ACGT") for _ in range(400)) for _ in range(2))
    rows = [(1, one), (2, one[:200] + "A" + one[200:]), (3, other), (4, one[:390])]
    sketched = sketches.bottom_sketches(spark.createDataFrame(rows, "id long, text string"), "id", "text", 11, 300)
    own = {i: brute_sketch([t], 11, 300) for i, t in rows}
    jaccard = sketches.least_jaccard(0.01, 11)
    first = {i: s[: len(s) - int(np.ceil(jaccard * len(s) - 1e-9)) + 1] for i, s in own.items()}
    met = collections.Counter(h for s in first.values() for h in s)
    got = sketches.prefix_entries(sketched, jaccard).collect()
    assert sorted((x.key, x.hash % (1 << 64), x.i) for x in got) == sorted((i, h, s.index(h)) for i, s in first.items() for h in s if met[h] > 1)
    want = table(sketches.near_sketches(sketched, 0.01, 11, 300), "key_1", "key_2", "shared")
    assert {(a, b) for a, b, _ in want} >= {(1, 2)} and all(3 not in x[:2] for x in want)
    monkeypatch.setattr(sketches, "COMMON", 2)
    assert table(sketches.near_sketches(sketched, 0.01, 11, 300), "key_1", "key_2", "shared") == want


# networks


def kruskal(haps):
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
    return sorted(want)


def test_network_by_growing_radius_equals_kruskal(spark):
    """Clusters of near haplotypes, far from one another; a second contig of one haplotype has no edges."""
    r = random.Random(8)
    centres = ["".join(r.choice("ACGT") for _ in range(70)) for _ in range(3)]
    seqs = set()
    while len(seqs) < 36:
        s = list(r.choice(centres))
        for _ in range(r.randint(0, 4)):
            s[r.randrange(70)] = r.choice("ACGT")
        seqs.add("".join(s))
    haps = {f"H{i}": s for i, s in enumerate(sorted(seqs))}
    rows = [("c", h, s) for h, s in haps.items()] + [("d", "H1", "")]
    out = haplotypes.haplotype_network(spark.createDataFrame(rows, "contig string, haplotype string, haplotype_seq string"))
    assert table(out, "h1", "h2", "weight") == kruskal(haps)


# seams


def test_islands_over_seams(spark):
    """Bins of 4, 16 and 64 positions: islands that cross none, one or many seams of each level."""
    r = random.Random(9)
    rows = [(g, s, s + r.choice([0, 1, 1, 2, 3, 9, 40])) for g in ("a", "b") for s in (r.randrange(600) for _ in range(90))]
    df = spark.createDataFrame(rows, "name string, start int, end int")
    want = []
    for g in ("a", "b"):
        merged = []
        for s, e in sorted((s, e) for n, s, e in rows if n == g):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(g, s, e) for s, e in merged]
    assert table(intervals.merge_intervals(df, "name", levels=(2, 4, 6)), "name", "start", "end") == sorted(want)
    support = spark.createDataFrame([(p, int(p % 37 > 3 or p > 300), 1) for p in range(700)], "pos int, support int, n int")
    runs, start = [], None
    for p in range(701):
        good = p < 700 and (p % 37 > 3 or p > 300)
        if good and start is None:
            start = p
        if not good and start is not None:
            runs.append((start, p))
            start = None
    assert table(intervals.support_islands(support, "n", 1.0, 2, levels=(2, 4, 6)), "start", "end") == [x for x in runs if x[1] - x[0] >= 2]


# scenarios


def test_scenarios_as_bits_equal_one_at_a_time(spark):
    """Each scenario of a joint run has the counts that it has alone."""
    r = random.Random(10)
    rows = [("c", s, "P" if s < 5 else "Q", p, "A", "T", *(("T", 1) if (p + s) % 4 == 0 else ("A", 0)), r.randint(0, 6), r.randint(5, 40), 35.0) for s in range(10) for p in range(30)]
    g = spark.createDataFrame(rows, "contig string, sample_id long, popcode string, pos int, ref string, alt string, base string, gt int, dp int, gq int, qual double")
    both = [scenarios.Scenario("low", 1, 6, 0.5, 0.6, 0.4), scenarios.Scenario("high", 2, 15, 0.6, 0.5, 0.6), scenarios.Scenario("mask", 2, 15, 0.0, 0.7, 0.6, "low")]
    cols = ["contig", "popcode", "pos", "n", "called", "cA", "cT"]
    joint = table(scenarios.scenario_counts(scenarios.scenario_evidence(g, both, 3), both), *cols)
    alone = []
    for own in ([both[0]], [both[1]], [both[0], both[2]]):
        found = table(scenarios.scenario_counts(scenarios.scenario_evidence(g, own, 3), own), *cols)
        alone += [x for x in found if x[0] == f"{own[-1].name}|c"]
    assert joint == sorted(alone) and {x[0] for x in joint} == {"low|c", "high|c", "mask|c"}


def test_spearman_of_ties(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 2.0), (2.0, 1.0), (None, 9.0)], "x double, y double")
    r = fn.spearman(df, "x", "y").first()
    assert (r.rho, r.n_pairs, r.n_dropped) == (pytest.approx(-0.8660254), 3, 1)


# ranks


def test_ranks_of_large_groups(spark):
    """One group of most rows with many ties, and small ones, beside the windows over whole groups."""
    r = random.Random(12)
    rows = [("big", i, r.choice([0.5, 0.25, round(r.random(), 2)])) for i in range(900)] + [("two", 1, 0.3), ("two", 2, 0.1), (None, 3, 0.7)]
    df = spark.createDataFrame(rows, "grp string, id long, p double").repartition(5)
    got = table(ranks.spread_average_rank(df, "p", "rank", "grp").filter("grp is not null"), "grp", "id", "rank")
    assert got == table(df.filter("grp is not null").withColumn("rank", fn.average_rank("p", "grp")), "grp", "id", "rank")
    named = df.filter("grp is not null")
    near = lambda rows: [(g, i, round(q, 12)) for g, i, q in rows]
    assert near(table(ranks.spread_bh_adjust(named, "p", "grp"), "grp", "id", "q")) == near(table(fn.bh_adjust(named, "p", "grp"), "grp", "id", "q"))
    assert table(ranks.spread_ecdf(named, "p", "grp"), "grp", "p", "fraction") == table(fn.ecdf(named, "p", "grp"), "grp", "p", "fraction")


def test_selection_by_nested_histograms(spark):
    r = random.Random(13)
    rows = [("a", r.gauss(0, 1) ** 7) for _ in range(700)] + [("a", float("nan")), ("a", None), ("b", 2.0), ("b", 2.0), ("c", None)] + [("d", 1.0 + i * 2**-52) for i in range(9)] + [("e", -1e300), ("e", 1e300)]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(3)
    fractions = {"low": 0.025, "half": 0.5, "high": 0.975}
    got = {x.grp: (x.low, x.half, x.high) for x in ranks.select_order_statistics(df, "v", fractions, "grp").collect()}
    for g in "abde":
        own = sorted(v for n, v in rows if n == g and v is not None and v == v)
        assert got[g] == tuple(own[int(q * (len(own) - 1))] for q in fractions.values())
    assert "c" not in got


def test_pairs_of_samples_are_found_in_blocks(spark, monkeypatch):
    """Distances of several blocks equal those from a join of sites, and no pair is shuffled after it was found."""
    from haplospark.operators import distance

    rows = [(c, i, p, "ACGTN"[(i * 7 + p * p * 3 + i * p) % 5]) for c, n in (("x", 11), ("y", 3)) for i in range(n) for p in range(0, 150, 3)]
    calls = spark.createDataFrame([*rows, ("x", 99, 700, "A")], "contig string, sample_id long, pos int, base string")
    monkeypatch.setattr(distance, "BLOCK", 4)
    got = distance.pairwise_distance(calls)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in plan.split("FlatMapGroupsInArrow")[0]
    key = lambda df: {(r.contig, r.sample_1, r.sample_2): (r.differences, r.sites_compared) for r in df.filter("sites_compared > 0").collect()}
    assert key(got) == key(distance.distances_by_sites(calls))
    assert len(key(got)) == 55 + 3


def test_distances_are_counted_where_they_are_found(spark, monkeypatch):
    """A summary of calls equals that of their pairs, also where a site has several bases, and no pair is a row in it."""
    from haplospark.operators import distance

    rows = [(c, f"s{i}", p, "ACGTN"[(i * 7 + p * p * 3 + i * p) % 5]) for c, n in (("x", 23), ("y", 3)) for i in range(n) for p in range(0, 300, 3)]
    rows += [("x", "s9", p, b) for p in range(0, 90, 3) for b in "AC"]
    calls = spark.createDataFrame([*rows, ("x", "z", 700, "A")], "contig string, sample_id string, pos int, base string")
    monkeypatch.setattr(distance, "BLOCK", 4)
    monkeypatch.setattr(distance, "TILE", 9)
    counts = distance.difference_counts(distance.pack_calls(calls))
    assert "sample_1" not in counts._jdf.queryExecution().optimizedPlan().toString()
    pairs = distance.pairwise_distance(calls)
    assert pairs.filter("sample_1 >= sample_2").isEmpty() and pairs.count() == 23 * 11 + 3
    assert set(distance.calls_summary(calls).collect()) == set(distance.distance_summary(pairs).collect())


def test_repeated_pairs_are_told_without_a_row_per_pair(spark):
    from haplospark.operators import distance

    rows = [("x", a, b, 0, 5, 0.0) for a in range(40) for b in range(a + 1, 40)]
    table = spark.createDataFrame([*rows, ("x", 3, 9, 1, 5, 0.2), ("x", 3, 9, 1, 5, 0.2), ("y", 5, 5, 7, 5, 1.4), (None, 1, 2, -1, 5, -0.2), (None, 1, 2, 0, 0, None)], "contig string, sample_1 long, sample_2 long, differences long, sites_compared long, p_distance double")
    errors = distance.distance_errors(table)
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2  # one pass for the rows, one for what repeats
    assert sorted((r.check, str(r.contig), r.sample_1, r.sample_2) for r in errors.collect()) == sorted(
        [("order", "y", 5, 5), ("more_differences_than_sites", "y", 5, 5), ("negative", "None", 1, 2), ("repeated", "None", 1, 2), ("repeated", "x", 3, 9)]
    )
    long = spark.createDataFrame([(c, 1, i, i % 7) for c in "xy" for i in range(30)], "contig string, sample_1 long, sample_2 long, differences long")
    assert {(r.contig, r.pairs, r.least, r.median, r.largest) for r in distance.distance_summary(long).collect()} == {(c, 30, 0, 3.0, 6) for c in "xy"}


def test_integer_partners_are_counted_by_words(spark):
    """Integer partners never go to Python; names, nulls and negative ones give the same."""
    from haplospark.operators import distance

    r = random.Random(8)
    rows = [("x", a, b) for a in range(30) for b in range(a + 1, 30)] + [("x", 3, 9), ("x", 28, 29), ("y", 3, 9), (None, 1, 2), (None, 1, 2), ("x", 5, -70), ("x", 5, -70), ("x", 5, -70)]
    r.shuffle(rows)
    for kind in ("long", "int", "string"):
        df = spark.createDataFrame(rows, "contig string, sample_1 long, sample_2 long").select("contig", *[F.col(c).cast(kind).alias(c) for c in ("sample_1", "sample_2")]).repartition(3)
        assert {(p.contig, int(p.sample_1), int(p.sample_2)) for p in distance.repeated_pairs(df, "contig").collect()} == {("x", 3, 9), ("x", 28, 29), (None, 1, 2), ("x", 5, -70)}
        assert ("Arrow" in distance.repeated_pairs(df, "contig")._jdf.queryExecution().executedPlan().toString()) == (kind == "string")
    few = spark.createDataFrame([("x", 1, None), ("x", 1, None), ("x", 2, None)], "contig string, sample_1 long, sample_2 long")
    assert [tuple(p) for p in distance.repeated_pairs(few, "contig").collect()] == [("x", 1, None)]


def test_rounding_equals_that_of_decimals(spark):
    from haplospark import catalog

    r = random.Random(9)
    values = [r.uniform(-2, 2) for _ in range(2000)] + [r.uniform(-1e6, 1e6) for _ in range(200)] + [a / 2.0**k for a in (-7, 3, 5) for k in range(1, 40)] + [0.0, -0.0, 5e-10, -5e-10, 1e300, float("nan"), float("inf"), None]
    values += [a / b for a in range(1, 60) for b in range(1, 60)] + [k * 1e-9 + 5e-10 for k in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    both = catalog.rounded(df).withColumnRenamed("v", "w").join(df, "i").filter(~F.col("w").eqNullSafe(F.round("v", 9) + F.lit(0.0)))
    assert both.isEmpty()


def test_sketch_distances_from_places(spark):
    """Shared hashes among the least of a union, from places alone: no sketch is joined to a pair."""
    from haplospark.operators import identity

    r = random.Random(3)
    own = {i: sorted(r.sample([f"{x:03d}" for x in range(60)], r.randint(1, 12))) for i in range(25)}
    df = spark.createDataFrame([(i, h) for i, hs in own.items() for h in hs], "doc long, hash string")
    got = identity.sketch_distances(df, "doc", 12, 8)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    want = set()
    for a in own:
        for b in own:
            if a < b and set(own[a]) & set(own[b]):
                u = sorted(set(own[a]) | set(own[b]))[:12]
                n = len(set(own[a]) & set(own[b]) & set(u))
                want.add((a, b, n, round(n / len(u), 9)))
    assert {(x.key_1, x.key_2, x.shared, round(x.jaccard, 9)) for x in got.collect()} == want


def test_sketches_meet_in_blocks(spark, monkeypatch):
    """Pairs of sketches from several blocks, a few at a time, and none of them is shuffled."""
    from haplospark.operators import identity

    r = random.Random(6)
    own = {i: sorted(r.sample([f"{x:03d}" for x in range(60)], r.randint(1, 12))) for i in range(40)}
    df = spark.createDataFrame([(str(i), h) for i, hs in own.items() for h in hs] + [("7", None), (None, "000")], "doc string, hash string")
    monkeypatch.setattr(identity, "BLOCK", 6)
    monkeypatch.setattr(identity, "MET", 5)
    got = identity.sketch_distances(df, "doc", 12, 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0]
    want = set()
    for a in own:
        for b in own:
            if str(a) < str(b) and set(own[a]) & set(own[b]):
                u = sorted(set(own[a]) | set(own[b]))[:12]
                n = len(set(own[a]) & set(own[b]) & set(u))
                want.add((str(a), str(b), n, round(n / len(u), 9)))
    rows = got.collect()
    assert {(x.key_1, x.key_2, x.shared, round(x.jaccard, 9)) for x in rows} == want and len(rows) == len(want)


def test_controls_told_by_a_column_need_no_join(spark):
    from haplospark.operators import identity

    d = spark.createDataFrame([(1, 2, 0.3), (1, 3, 0.2), (2, 3, None), (3, 4, 0.1), (4, 5, 0.25)], "key_1 long, key_2 long, distance double")
    kind = F.when(F.col("key_1") == 1, "within").when(F.col("key_1") == 4, "different")
    one = identity.calibrated_suspects(d, kind)
    two = identity.calibrated_suspects(d, d.select("key_1", "key_2", kind.alias("kind")).filter("kind is not null"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the limit
    assert set(one.collect()) == set(two.collect()) and {(r.key_1, r.key_2) for r in one.filter("suspected").collect()} == {(1, 3), (3, 4)}


def test_partial_sketches_of_many_short_records(spark):
    """A sketch is sorted anew only when as much has come as it holds; packing in between makes no difference."""
    r = random.Random(4)
    rows = [(i % 3, "".join(r.choice("ACGT") for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, text string")
    whole = {x.key: x.hashes for x in sketches.bottom_sketches(df, "key", "text", 5, 50).collect()}
    for k in range(3):
        h = np.concatenate([sketches.kmer_hashes(sketches._CODE[np.frombuffer(t.encode(), np.uint8)], 5)[1] for i, t in rows if i == k])
        assert bytes(whole[k]) == np.unique(h)[:50].tobytes()


def test_ranks_whose_products_pass_64_bits(spark):
    """Of 60,000 items the product of both sums of doubled ranks passes 64 bits."""
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("grp"), F.col("id"), F.col("id").cast("double").alias("x"), ((F.col("id") * 7919) % n).cast("double").alias("y"))
    got = resampling.permutation_spearman(df, "x", "y", "id", "grp", permutations=2).first()
    assert got.n == n and -1 <= got.rho <= 1 and got.p in (1 / 3, 2 / 3, 1.0)


def test_orders_by_hash_equal_those_of_hashlib():
    import hashlib

    r = random.Random(12)
    items = [b"", b":x", *(f":{r.randrange(10 ** r.randint(1, 40))}".encode() for _ in range(500)), b":x", b":" + "\u00e9".encode() * 9]
    orders = resampling._Orders(items)
    for prefix in ("", "1729:c1:1:missing:0", "1729:c1:1:missing:77", "1729:c1:1:missing:9998", "x" * 53, "y" * 200):
        heads = [hashlib.md5(prefix.encode() + i).digest()[:4] for i in items]
        assert orders.by(prefix).tolist() == sorted(range(len(items)), key=lambda k: (heads[k], k))


def test_only_drawn_pairs_are_compared(spark):
    from haplospark.operators import popgen

    rows = [("x", f"p{i % 2}", i, p, "ACGTN"[(i * 7 + p * p * 3 + i * p) % 5]) for i in range(60) for p in range(20)]
    calls = spark.createDataFrame(rows, "contig string, popcode string, sample_id long, pos int, base string")
    got = popgen.standardised_diversity(calls, draws=3, size=4)
    assert "b1" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 6 and got.filter("sites > 0").count() == 6


def test_a_nexus_text_goes_with_none_of_its_rows(spark):
    from haplospark.sources import readers

    text = "TAXLABELS\n" + "\n".join(f"[{i}] 't{i}'" for i in range(1, 7)) + "\n;\nMATRIX\n" + "\n".join(f"[1, size=2]\t50\t{i} {i + 1}," for i in range(1, 6)) + "\n;\n"
    got = readers.parse_split_nexus(spark.createDataFrame([("a", text)], "tree_id string, value string"))
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "value#" not in above
    assert [x.members for x in got.orderBy("members").collect()] == [[f"t{i}", f"t{i + 1}"] for i in range(1, 6)]


def test_conflicting_splits_meet_once(spark):
    from haplospark.operators import splits

    rows = [("1", m, 0.1, 90.0, 99.0) for m in (["a", "b", "c"], ["b", "c", "d"], ["a", "b"], ["d", "e"])]
    got = splits.incompatible_splits(spark.createDataFrame(rows, "tree_id string, members array<string>, length double, sh_alrt double, ufboot double"), list("abcdefgh"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2  # of each side's splits, not of pairs
    assert sorted((x.split_1, x.split_2) for x in got.collect()) == [("a,b", "b,c,d"), ("a,b,c", "b,c,d"), ("b,c,d", "d,e")]


def test_a_vcf_line_goes_with_none_of_its_samples(spark):
    from haplospark.sources import readers

    got = readers.parse_vcf(spark.createDataFrame([("c\t5\t.\tA\tT\t9.5\t.\t.\tGT:DP:GQ\t0:3:7\t1:.:8",)], "value string"), ["a", "b"])
    assert "value#" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert [tuple(x) for x in got.orderBy("sample_id").collect()] == [("c", 5, "A", ["T"], 9.5, "a", 0, 3, 7), ("c", 5, "A", ["T"], 9.5, "b", 1, None, 8)]
    assert [x.sample_id for x in readers.parse_vcf(spark.createDataFrame([("c\t5\t.\tA\tT\t9.5\t.\t.\tGT\t0",)], "value string"), []).collect()] == [None]


def test_equal_intervals_open_no_gap(spark):
    """The union of tied intervals, as of customer 2515 of sf0.1: an island that equal intervals open stays apart from the one before."""
    own = [(4, 17), (156, 165), (165, 171), (172, 189), (172, 189)]
    df = spark.createDataFrame([("a", s, e) for s, e in own], "name string, start int, end int")
    assert table(intervals.merge_intervals(df, "name"), "start", "end") == [(4, 17), (156, 171), (172, 189)]
