"""Unrooted trees as tables of splits: (tree_id, members, length, sh_alrt, ufboot)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio

STRONG_ALRT, STRONG_UFBOOT = 80.0, 95.0


def support_of(label: Column) -> Column:
    """struct(sh_alrt, ufboot, valid) of a label ``a/b``; NULLs and false where it isn't two numbers."""
    parts = F.split(label, "/")
    a, b = (F.when(F.size(parts) == 2, parts[i].try_cast("double")) for i in (0, 1))
    return F.struct(a.alias("sh_alrt"), b.alias("ufboot"), F.coalesce(a.isNotNull() & b.isNotNull(), F.lit(False)).alias("valid"))


def is_strong(alrt: Column, ufboot: Column) -> Column:
    return F.coalesce((alrt >= STRONG_ALRT) & (ufboot >= STRONG_UFBOOT), F.lit(False))


def canonical_side(members: Column, taxa: Column) -> Column:
    """The smaller side of a split, in order; of equal sides the one that sorts first."""
    one, two = F.array_sort(members), F.array_sort(F.array_except(taxa, members))
    return F.when(F.size(one) < F.size(two), one).when(F.size(two) < F.size(one), two).otherwise(F.when(F.array_join(one, "\t") <= F.array_join(two, "\t"), one).otherwise(two))


def restrict_splits(splits: DataFrame, taxa: list[str]) -> DataFrame:
    """Splits of the tree that is left with these taxa: trivial ones go, and of edges that make one split that with the best
    support (the lesser of both values, then SH-aLRT, then UFBoot) stays; its length is the sum."""
    names = F.array(*map(F.lit, sorted(taxa)))
    cut = splits.withColumn("members", canonical_side(F.array_intersect("members", names), names)).filter(F.size("members") >= 2)
    order = F.struct(F.least("sh_alrt", "ufboot"), "sh_alrt", "ufboot")
    best = cut.groupBy("tree_id", "members").agg(F.max_by(F.struct("sh_alrt", "ufboot"), order).alias("s"), F.sum("length").alias("length"))
    return best.select("tree_id", "members", "length", "s.sh_alrt", "s.ufboot")


def supported_contraction(splits: DataFrame, taxa: list[str]) -> DataFrame:
    """The restricted tree with its weakly supported edges contracted: the strong splits."""
    return restrict_splits(splits, taxa).filter(is_strong(F.col("sh_alrt"), F.col("ufboot")))


def incompatible_splits(splits: DataFrame, taxa: list[str]) -> DataFrame:
    """Pairs of strong splits of which all four intersections of sides have a member.

    As sides are the smaller ones, two splits conflict only if they share a member, so candidates come from a join on it; a pair
    counts where its first shared member meets, so that pairs needn't be told apart afterwards.
    """
    n = len(taxa)
    strong = splits.filter(is_strong(F.col("sh_alrt"), F.col("ufboot"))).withColumn("split_key", F.array_join("members", ",")).select("tree_id", "split_key", "members").distinct()
    one = strong.select("tree_id", F.col("split_key").alias("split_1"), F.col("members").alias("m1"), F.explode(F.array_distinct("members")).alias("member"))
    two = strong.select("tree_id", F.col("split_key").alias("split_2"), F.col("members").alias("m2"), F.explode(F.array_distinct("members")).alias("member"))
    pairs = one.join(two, ["tree_id", "member"]).filter("split_1 < split_2").filter(F.array_min(F.array_intersect("m1", "m2")) == F.col("member"))
    conflict = (F.size(F.array_except("m1", "m2")) > 0) & (F.size(F.array_except("m2", "m1")) > 0) & (F.size(F.array_union("m1", "m2")) < n)
    return pairs.filter(conflict).select("tree_id", "split_1", "split_2")


def split_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Splits that only one of two trees has, and which."""
    a, b = one.select("members").distinct(), two.select("members").distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def compare_trees(splits: DataFrame, first: str, second: str) -> DataFrame:
    """One row: splits of both, RF, RF over the number of splits (0 without any), strong splits that differ, and the largest
    difference in length over strong splits that both have."""
    side = lambda t, p: splits.filter(F.col("tree_id") == t).select("members", F.col("length").alias(f"{p}length"), is_strong(F.col("sh_alrt"), F.col("ufboot")).alias(f"{p}strong"))
    both = side(first, "a_").join(side(second, "b_"), "members", "full_outer")
    a, b = F.col("a_length").isNotNull(), F.col("b_length").isNotNull()
    sa, sb = F.coalesce("a_strong", F.lit(False)), F.coalesce("b_strong", F.lit(False))
    out = both.agg(F.count_if(a).alias("splits_1"), F.count_if(b).alias("splits_2"), F.count_if(a != b).alias("rf"), F.count_if(sa != sb).alias("strong_difference"), F.max(F.when(sa & sb, F.abs(F.col("a_length") - F.col("b_length")))).alias("max_length_difference"))
    return out.withColumn("normalised_rf", F.coalesce(ratio(F.col("rf"), F.col("splits_1") + F.col("splits_2")), F.lit(0.0)))


def tip_alignment(one: DataFrame, two: DataFrame, identical: DataFrame) -> DataFrame:
    """Tip orders (tip, place) of two trees side by side, with the tip that stands for an identical one."""
    a, b = one.select("tip", F.col("place").alias("place_1")), two.select("tip", F.col("place").alias("place_2"))
    out = a.join(b, "tip").join(identical.select("tip", "representative"), "tip", "left")
    return out.withColumn("representative", F.coalesce("representative", "tip"))


EDGES = "tree_id string, node int, parent int, length double, label string, is_tip boolean, first_tip int, last_tip int"


def newick_edges(trees: DataFrame) -> DataFrame:
    """(tree_id, newick) -> an edge per node: its parent (NULL at the root), branch length, label, whether it is a tip, and the
    numbers of the first and the last tip below it, from left to right.

    Trees are parsed in batches, one left-to-right pass each; quotes and comments aren't part of the format here.
    """

    def tokens(text: str) -> Iterator[str]:
        word = ""
        for c in text.strip().rstrip(";"):
            if c in "(),":
                if word.strip():
                    yield word.strip()
                word = ""
                yield c
            else:
                word += c
        if word.strip():
            yield word.strip()

    def nodes(text: str) -> list[list]:
        out: list[list] = [[0, None, None, None, False]]
        at = 0
        for t in tokens(text):
            if t in "(,":
                parent = at if t == "(" else out[at][1]
                out.append([len(out), parent, None, None, True])
                out[parent][4] = False
                at = len(out) - 1
            elif t == ")":
                at = out[at][1]
            else:
                label, _, length = t.partition(":")
                out[at][3] = label or None
                out[at][2] = float(length) if length else None
        number = 0
        for node in out:
            node += [number, number] if node[4] else [len(out), -1]
            number += node[4]
        for _, parent, *_, first, last in reversed(out):  # a parent comes before what is below it
            if parent is not None:
                out[parent][5:] = [min(out[parent][5], first), max(out[parent][6], last)]
        return out

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[tree, *n] for tree, text in zip(batch["tree_id"], batch["newick"], strict=True) if text for n in nodes(text)]
            out = pd.DataFrame(rows, columns=["tree_id", "node", "parent", "length", "label", "is_tip", "first_tip", "last_tip"])
            yield out.astype({"node": "int32", "parent": "Int32", "length": "float64", "is_tip": "bool", "first_tip": "int32", "last_tip": "int32"})

    return trees.select(F.col("tree_id").cast("string").alias("tree_id"), "newick").mapInPandas(parse, EDGES)


def edge_splits(edges: DataFrame) -> DataFrame:
    """Edges -> splits: an inner edge's tips, on the canonical side, with the label as support; trivial ones are left out.

    A node's tips are those numbered from its first to its last one, so they come from one join, whatever the tree's depth.
    """
    tips = edges.filter("is_tip").select("tree_id", F.col("first_tip").alias("number"), F.col("label").alias("tip"))
    own = edges.filter("not is_tip and parent is not null").select("tree_id", "node", F.explode(F.sequence("first_tip", "last_tip")).alias("number"))
    below = own.join(tips, ["tree_id", "number"]).groupBy("tree_id", "node").agg(F.array_sort(F.collect_set("tip")).alias("members"))
    taxa = tips.groupBy("tree_id").agg(F.array_sort(F.collect_set("tip")).alias("taxa"))
    inner = edges.filter("not is_tip and parent is not null").select("tree_id", "node", "length", support_of(F.col("label")).alias("s"))
    out = inner.join(below, ["tree_id", "node"]).join(taxa, "tree_id")
    out = out.select("tree_id", canonical_side(F.col("members"), F.col("taxa")).alias("members"), "length", "s.sh_alrt", "s.ufboot").filter(F.size("members") >= 2)
    best = F.struct(F.least("sh_alrt", "ufboot"), "sh_alrt", "ufboot")
    out = out.groupBy("tree_id", "members").agg(F.max_by(F.struct("sh_alrt", "ufboot"), best).alias("s"), F.sum("length").alias("length"))
    return out.select("tree_id", "members", "length", "s.sh_alrt", "s.ufboot")
