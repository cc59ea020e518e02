"""Haplotypes over the variable sites, their sharing, and their minimum spanning network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hash_int, is_callable
from ..functions.lineage import cut
from .calls import variable_sites
from .distance import all_pairs

AMBIGUOUS = "AMBIGUOUS"
#: Steps of finding components' roots between two checks whether all are found.
STEPS = 2
#: The first radius of the search for edges, and the factor by which it grows.
RADIUS, GROWTH = 2, 4


def haplotype_sequences(calls: DataFrame) -> DataFrame:
    """Per contig and sample its bases at the variable sites, NULL if any is uncallable; without such sites all are empty."""
    sites = variable_sites(calls).select("contig", "pos")
    own = calls.join(sites, ["contig", "pos"], "left_semi").groupBy("contig", "sample_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.upper("base").alias("base")))), lambda x: x["base"]), "").alias("s"), F.count_if(~is_callable(F.col("base"))).alias("missing")
    )
    everyone = calls.select(*[c for c in ("contig", "sample_id", "popcode", "taxon") if c in calls.columns]).distinct()
    return everyone.join(own, ["contig", "sample_id"], "left").withColumn("haplotype_seq", F.when(F.coalesce("missing", F.lit(0)) == 0, F.coalesce("s", F.lit("")))).drop("s", "missing")


def haplotype_labels(calls: DataFrame) -> DataFrame:
    """Samples with haplotype (H1.. in lexical order of sequences, or AMBIGUOUS) and label_no."""
    own = haplotype_sequences(calls)
    distinct = own.filter("haplotype_seq is not null").select("contig", "haplotype_seq").distinct()
    labels = distinct.withColumn("label_no", F.dense_rank().over(W.partitionBy("contig").orderBy("haplotype_seq")))
    out = own.join(labels, ["contig", "haplotype_seq"], "left")
    return out.withColumn("haplotype", F.when(F.col("label_no").isNull(), AMBIGUOUS).otherwise(F.concat(F.lit("H"), F.col("label_no").cast("string"))))


def haplotypes(labels: DataFrame) -> DataFrame:
    """A row per haplotype: sequence, samples, populations as ``code:count`` in order; missing codes count as unresolved."""
    named = labels.filter(F.col("haplotype") != AMBIGUOUS)
    code = F.coalesce(F.nullif(F.col("popcode"), F.lit("")), F.lit("unresolved"))
    counts = named.groupBy("contig", "haplotype", "haplotype_seq", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("contig", "haplotype", "haplotype_seq").agg(
        F.sum("n").alias("samples"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", F.col("n").cast("string")))), ";").alias("populations")
    )


def composition_counts(labels: DataFrame, taxa: list[str]) -> DataFrame:
    """Samples per haplotype in the fixed order of taxa, one column each."""
    return labels.groupBy("contig", "haplotype").pivot("taxon", taxa).agg(F.count(F.lit(1))).na.fill(0)


def unknown_taxa(labels: DataFrame, taxa: list[str]) -> DataFrame:
    return labels.filter(F.col("taxon").isNull() | ~F.col("taxon").isin(taxa)).select("contig", "sample_id", "taxon")


def haplotype_sharing(calls: DataFrame, *by: str) -> DataFrame:
    """Over the given sites: samples without N, distinct haplotypes, and those found in more than one population."""
    whole = calls.groupBy(*by, "contig", "sample_id", "popcode").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("s"), F.count_if(~is_callable(F.col("base"))).alias("missing")
    )
    seen = whole.filter("missing = 0").groupBy(*by, "contig", "s").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("popcode").alias("pops"))
    found = seen.groupBy(*by, "contig").agg(F.sum("n").alias("assigned"), F.count(F.lit(1)).alias("haplotypes"), F.count_if(F.col("pops") > 1).alias("shared"))
    return whole.select(*by, "contig").distinct().join(found, [*by, "contig"], "left").na.fill(0, ["assigned", "haplotypes", "shared"])


def site_downsampling(calls: DataFrame, sites: int, draws: int = 1000, seed: int = 1729) -> DataFrame:
    """Per draw of ``sites`` positions without replacement (the least hashes of seed, draw and position): haplotype sharing."""
    positions = calls.groupBy("contig").agg(F.array_sort(F.collect_set("pos")).alias("all"))
    drawn = positions.select("contig", "all", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    ranked = F.array_sort(F.transform("all", lambda p: F.struct(hash_int(seed, F.col("contig"), F.col("draw"), p).alias("h"), p.alias("p"))))
    picked = drawn.select("contig", "draw", F.explode(F.transform(F.slice(ranked, 1, sites), lambda x: x["p"])).alias("pos"))
    return haplotype_sharing(calls.join(picked, ["contig", "pos"]), "draw")


def downsampling_summary(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """Per contig: observed shared haplotypes and interpolated limits of the draws, and the share of draws at most that."""
    q = F.percentile("shared", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    both = draws.join(observed.select("contig", F.col("shared").alias("observed")), "contig")
    out = both.groupBy("contig", "observed").agg(q.alias("q"), F.avg((F.col("shared") <= F.col("observed")).cast("double")).alias("at_most"))
    return out.select("contig", "observed", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("high"), "at_most")


def major_labels(haplotype_table: DataFrame, least: int = 5) -> DataFrame:
    return haplotype_table.filter(F.col("samples") >= least).select("contig", "haplotype", "samples")


def haplotype_distances(haplotype_table: DataFrame) -> DataFrame:
    """contig, h1, h2, weight for h1 < h2 as strings: positions at which the sequences differ."""
    pairs = all_pairs(haplotype_table.select("contig", "haplotype", "haplotype_seq"), "haplotype", "contig")
    differ = F.size(F.filter(F.zip_with(F.split("a_haplotype_seq", ""), F.split("b_haplotype_seq", ""), lambda x, y: x != y), lambda d: d))
    return pairs.select("contig", F.col("a_haplotype").alias("h1"), F.col("b_haplotype").alias("h2"), differ.alias("weight"))


def _joined_parts(edges: DataFrame, part: DataFrame, max_rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Boruvka rounds over edges from the parts (contig, node, part): the edges chosen in each round, and the parts after them."""
    chosen = []
    for _ in range(max_rounds):
        ends = edges.join(part.withColumnsRenamed({"node": "h1", "part": "p1"}), ["contig", "h1"]).join(part.withColumnsRenamed({"node": "h2", "part": "p2"}), ["contig", "h2"]).filter("p1 <> p2")
        out = ends.select("contig", F.explode(F.array(F.struct(F.col("p1").alias("own"), F.col("p2").alias("other")), F.struct(F.col("p2").alias("own"), F.col("p1").alias("other")))).alias("e"), "weight", "h1", "h2")
        least = out.groupBy("contig", F.col("e.own").alias("own")).agg(F.min(F.struct("weight", "h1", "h2", F.col("e.other").alias("other"))).alias("m"))
        least = cut(least.select("contig", "own", "m.*"))
        if least.isEmpty():
            break
        chosen.append(least.select("contig", "h1", "h2", "weight").distinct())
        # a component points to the one over its edge; of two that point at each other the lesser is the root
        jump = least.select("contig", "own", "other")
        back = jump.select("contig", F.col("own").alias("other"), F.col("other").alias("of"))
        jump = jump.join(back, ["contig", "other"], "left").select("contig", "own", F.when((F.col("of") == F.col("own")) & (F.col("own") < F.col("other")), F.col("own")).otherwise(F.col("other")).alias("root"))
        while True:
            # each step doubles how far a component sees; one without an edge of its own is the root of those that point at it
            after = jump.withColumn("first", F.col("root"))
            for _ in range(STEPS):
                on = jump.select("contig", F.col("own").alias("root"), F.col("root").alias("next"))
                jump = after.join(on, ["contig", "root"], "left").select("contig", "own", F.coalesce("next", "root").alias("root"), "first")
                after = jump
            after = cut(after.select("contig", "own", "root", (F.col("root") != F.col("first")).alias("moved")))
            done = after.filter("moved").isEmpty()
            jump = after.drop("moved")
            if done:
                break
        part = cut(part.join(jump.select("contig", F.col("own").alias("part"), "root"), ["contig", "part"], "left").select("contig", "node", F.coalesce("root", "part").alias("part")))
    return chosen, part


def spanning_network(distances: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The minimum spanning tree of each contig's haplotypes; ties go by (weight, h1, h2), which makes it unique.

    Boruvka: each round every component takes its least edge out, and components that are so joined become one, so rounds
    are at most the logarithm of the haplotypes. Each round's components are a checkpoint; the edges stay distributed.
    """
    edges = cut(distances.select("contig", "h1", "h2", "weight"))
    nodes = edges.select("contig", F.col("h1").alias("node")).unionByName(edges.select("contig", F.col("h2").alias("node"))).distinct()
    chosen, _ = _joined_parts(edges, nodes.withColumn("part", F.col("node")), max_rounds)
    return reduce(DataFrame.unionByName, chosen, edges.limit(0)).distinct()


#: Bases of a sequence that one long holds, two bits each.
PACKED = 31


def _packed_sequences(haplotype_table: DataFrame) -> DataFrame:
    """contig, node, digits, longs: sequences of ACGT as digits 0 to 3, and as numbers of PACKED of them."""
    digits = F.translate(F.upper("haplotype_seq"), "ACGT", "0123")
    starts = F.sequence(F.lit(0), F.ceil(F.length("digits") / PACKED).cast("int") - 1)
    longs = F.when(F.length("digits") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.conv(F.substring(F.col("digits"), i * PACKED + 1, F.lit(PACKED)), 4, 10).cast("long")))
    return haplotype_table.select("contig", F.col("haplotype").alias("node"), digits.alias("digits")).withColumn("longs", longs)


def _hamming(x: str, y: str):
    """Differing pairs of bits, by long: a pair differs if either of its bits does."""
    odd = F.lit(0x5555555555555555)
    differ = F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b).bitwiseOR(F.shiftrightunsigned(a.bitwiseXOR(b), 1)).bitwiseAND(odd)))
    return F.aggregate(differ, F.lit(0), lambda total, n: total + n)


def near_haplotypes(queries: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """contig, h1 < h2, weight of pairs of different parts, one of them a query, whose sequences differ at 1 to radius places.

    Places are dealt to radius + 1 segments in turn; sequences that differ at no more than radius places are equal in one of
    them. A pair is taken at the first segment in which it is equal, so that it is met once.
    """
    n = radius + 1
    deal = lambda df: df.withColumn("segments", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_join(F.filter(F.split("digits", ""), lambda x, i: i % n == k), "")))
    met = lambda df: deal(df).select("contig", "node", "part", "asked", "longs", "segments", F.posexplode("segments").alias("k", "segment"))
    one = met(queries).select("contig", "k", "segment", F.col("node").alias("q"), F.col("part").alias("part_q"), F.col("longs").alias("longs_q"), F.col("segments").alias("segments_q"))
    pairs = one.join(met(nodes), ["contig", "k", "segment"])
    pairs = pairs.filter((F.col("part_q") != F.col("part")) & (~F.col("asked") | (F.col("q") < F.col("node"))))
    earlier = F.exists(F.sequence(F.lit(0), F.col("k")), lambda j: (j < F.col("k")) & (F.get("segments_q", j) == F.get("segments", j)))
    near = pairs.filter(~earlier).withColumn("weight", _hamming("longs_q", "longs")).filter(F.col("weight") <= radius)
    return near.select("contig", F.least("q", "node").alias("h1"), F.greatest("q", "node").alias("h2"), "weight")


def haplotype_network(haplotype_table: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The minimum spanning tree of each contig's haplotypes (contig, haplotype, haplotype_seq of ACGT), without all their pairs.

    Edges of up to a radius are found by segments, joined by Boruvka rounds, and the radius grows until each contig is one
    part. Parts that differ by more than a radius keep no edge up to it: each edge of the tree was the least between its
    parts, as no lighter one was left out. Pairs within a part aren't looked at again, and those within a contig's largest
    part never after it has formed. Ties go by (weight, h1, h2). Columns: contig, h1, h2, weight.
    """
    nodes = cut(_packed_sequences(haplotype_table))
    part = nodes.select("contig", "node", F.col("node").alias("part"))
    longest = nodes.agg(F.max(F.length("digits"))).first()[0] or 0
    found: list[DataFrame] = []
    radius = RADIUS
    while True:
        sizes = part.groupBy("contig", "part").agg(F.count(F.lit(1)).alias("n"))
        giants = cut(sizes.groupBy("contig").agg(F.max(F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("contig", F.col("most.part").alias("giant")))
        if giants.isEmpty():
            break
        own = nodes.join(part, ["contig", "node"]).join(giants, "contig").withColumn("asked", F.col("part") != F.col("giant")).drop("giant")
        edges = cut(near_haplotypes(own.filter("asked"), own, radius))
        chosen, part = _joined_parts(edges, part, max_rounds)
        found += chosen
        if radius >= longest:
            break
        radius *= GROWTH
    empty = nodes.select("contig", F.col("node").alias("h1"), F.col("node").alias("h2"), F.lit(0).alias("weight")).limit(0)
    return reduce(DataFrame.unionByName, found, empty).distinct()


def haplotype_diversity_input(labels: DataFrame) -> DataFrame:
    return labels.select("contig", "popcode", "haplotype")
