"""Half-open intervals and 1-based alignment hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio

BIN = 1000


def half_open(hits: DataFrame, start: str, end: str) -> DataFrame:
    """hits with start, end and strand of a 1-based inclusive pair of columns in either order."""
    low, high = F.least(start, end), F.greatest(start, end)
    return hits.withColumns({"start": low - 1, "end": high, "strand": F.when(F.col(start) <= F.col(end), "+").otherwise("-")})


#: Bins of positions in which islands are joined, as powers of two: what touches a bin's edge meets in the next, wider bin.
LEVELS = (14, 28, 48)


def _islands(intervals: DataFrame, *by: str) -> DataFrame:
    """Islands begin where a start exceeds all earlier ends."""
    order = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _joined_over_seams(pieces: DataFrame, levels: tuple[int, ...], *by: str) -> DataFrame:
    """Islands of pieces that lie within bins of the first level each.

    Islands are found bin by bin. One that touches no edge of its bin is whole; the others, two at most per bin, go on to the
    next level, whose bins hold whole bins of the one before. No window has more than a bin's pieces.
    """
    whole = []
    for bits in levels:
        own = _islands(pieces.withColumn("_bin", F.shiftright(F.col("start").cast("long"), bits)), *by, "_bin")
        first = F.shiftleft(F.col("_bin"), bits)
        edge = (F.col("start") == first) | (F.col("end") == first + (1 << bits))
        whole.append(own.filter(~edge).drop("_bin"))
        pieces = own.filter(edge).drop("_bin")
    return reduce(DataFrame.unionByName, whole, _islands(pieces, *by))


def merge_intervals(intervals: DataFrame, *by: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """by..., start, end: the union; touching intervals merge, and empty ones stay unless they touch another.

    Intervals are cut at the edges of bins, so that a group's intervals are sorted bin by bin and not in one task.
    """
    bits = levels[0]
    first, last = F.shiftright(F.col("start").cast("long"), bits), F.shiftright(F.greatest(F.col("start"), F.col("end") - 1).cast("long"), bits)
    kinds = {c: intervals.schema[c].dataType for c in ("start", "end")}
    cut = intervals.select(*by, "start", "end", F.explode(F.sequence(first, last)).alias("_b"))
    begin = F.shiftleft(F.col("_b"), bits)
    pieces = cut.select(*by, F.greatest(F.col("start"), begin).alias("start"), F.least(F.col("end"), begin + (1 << bits)).alias("end"))
    return _joined_over_seams(pieces, levels, *by).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def in_bins(intervals: DataFrame, bin_size: int, *keep: str) -> DataFrame:
    """keep..., bin, start, end: the piece of each interval in each bin of positions; a union by bin needs no task for all."""
    cut = intervals.filter("start < end").select(*keep, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("bin"))
    return cut.withColumns({"start": F.greatest(F.col("start"), F.col("bin") * bin_size), "end": F.least(F.col("end"), (F.col("bin") + 1) * bin_size)})


def covered_bases(intervals: DataFrame, *by: str) -> DataFrame:
    return merge_intervals(intervals, *by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))


def support_islands(support: DataFrame, total: str, fraction: float, length: int, *by: str, ceiling: bool = False, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(by..., pos, support, total) -> start, end of the longest runs of positions with enough support, of at least length.

    Enough is support / total >= fraction, or with ``ceiling`` support >= ceil(total * fraction). Runs are found in bins of
    positions and joined over the bins' seams.
    """
    least = F.ceil(F.col(total) * fraction) if ceiling else F.col(total) * fraction
    good = support.filter(F.col("support") >= least).withColumn("_bin", F.shiftright(F.col("pos").cast("long"), levels[0]))
    good = good.withColumn("_run", F.col("pos") - F.row_number().over(W.partitionBy(*by, "_bin").orderBy("pos")))
    runs = good.groupBy(*by, "_bin", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_bin", "_run")
    return _joined_over_seams(runs, levels, *by).filter(F.col("end") - F.col("start") >= length)


def complement_intervals(intervals: DataFrame, length: int, *by: str) -> DataFrame:
    """The gaps around the intervals within [0, length), in order; a group without intervals isn't there."""
    merged = merge_intervals(intervals, *by)
    order = W.partitionBy(*by).orderBy("start")
    gaps = merged.select(*by, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("start"), F.col("start").alias("end"))
    tail = merged.groupBy(*by).agg(F.max("end").alias("start")).select(*by, "start", F.lit(length).alias("end"))
    return gaps.unionByName(tail).filter("start < end")


def interval_overlap(features: DataFrame, intervals: DataFrame, feature_key: str, bin_size: int = BIN) -> DataFrame:
    """Per feature (key, start, end): bases in the union of the intervals, their fraction, and full, partial or none.

    Both sides are cut at the edges of bins of positions, so the range join is an equi-join on the bin.
    """
    f = in_bins(features, bin_size, feature_key).withColumnsRenamed({"start": "fs", "end": "fe"})
    m = _islands(in_bins(intervals, bin_size), "bin").withColumnsRenamed({"start": "ms", "end": "me"})
    both = f.join(m, "bin").filter("fs < me and ms < fe")
    sums = both.groupBy(feature_key).agg(F.sum(F.least("fe", "me") - F.greatest("fs", "ms")).alias("overlap"))
    out = features.select(feature_key, "start", "end").join(sums, feature_key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("long"))
    out = out.withColumn("fraction", ratio(F.col("overlap"), F.col("end") - F.col("start")))
    return out.withColumn("class", F.when(F.col("overlap") == 0, "none").when(F.col("overlap") == F.col("end") - F.col("start"), "full").otherwise("partial"))


def positions_in_intervals(table: DataFrame, intervals: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Rows of table (pos, ...) inside any interval, once each: a semi join on bins of positions."""
    m = _islands(in_bins(intervals, bin_size), "bin").withColumnsRenamed({"start": "_s", "end": "_e", "bin": "_bin"})
    binned = table.withColumn("_b", F.floor(F.col("pos") / bin_size))
    return binned.join(m, (F.col("_b") == F.col("_bin")) & (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e")), "left_semi").drop("_b")


def hit_coverage(hits: DataFrame, key: str = "query") -> DataFrame:
    """Per query: hits, and the bases and fraction of query and subject that the union of the hits covers."""
    q = covered_bases(half_open(hits, "qstart", "qend"), key).withColumnRenamed("bases", "query_bases")
    s = covered_bases(half_open(hits, "sstart", "send"), key).withColumnRenamed("bases", "subject_bases")
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.max("qlen").alias("qlen"), F.max("slen").alias("slen"))
    out = n.join(q, key).join(s, key)
    return out.select(key, "hits", "query_bases", ratio("query_bases", "qlen").alias("query_fraction"), "subject_bases", ratio("subject_bases", "slen").alias("subject_fraction"))


def best_hit_per_base(hits: DataFrame, key: str = "query") -> DataFrame:
    """Per query base, identity and strand of its hit with the highest bit score, then the first."""
    h = hits.withColumn("strand", F.when((F.col("qstart") <= F.col("qend")) == (F.col("sstart") <= F.col("send")), "+").otherwise("-"))
    bases = h.select(key, "hit_no", "bitscore", "identity", "strand", F.explode(F.sequence(F.least("qstart", "qend"), F.greatest("qstart", "qend"))).alias("pos"))
    best = F.min_by(F.struct("identity", "strand"), F.struct(-F.col("bitscore"), F.col("hit_no")))
    return bases.groupBy(key, "pos").agg(best.alias("best")).select(key, "pos", "best.identity", "best.strand")


def weighted_identity(hits: DataFrame, key: str = "query") -> DataFrame:
    """Per query: covered bases, their mean identity, and bases on either strand and their shares."""
    out = best_hit_per_base(hits, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("bases"), F.avg("identity").alias("identity"), F.count_if(F.col("strand") == "+").alias("same_strand"), F.count_if(F.col("strand") == "-").alias("reverse_strand")
    )
    return out.withColumn("same_fraction", ratio("same_strand", "bases")).withColumn("reverse_fraction", ratio("reverse_strand", "bases"))


def best_hit_per_feature(hits: DataFrame, key: str = "query") -> DataFrame:
    """One hit per feature: the highest bit score, then the longest, then the first."""
    order = W.partitionBy(key).orderBy(F.desc("bitscore"), F.desc("length"), "hit_no")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def accept_projection(best: DataFrame, min_coverage: float = 0.80, min_identity: float = 90.0) -> DataFrame:
    """Best hits with coverage, half-open subject interval, strand, status and the reason where not accepted."""
    out = half_open(best, "sstart", "send").withColumn("coverage", ratio(F.abs(F.col("qend") - F.col("qstart")) + 1, F.col("qlen")))
    low, poor = F.col("coverage") < min_coverage, F.col("identity") < min_identity
    reason = F.when(low & poor, "coverage and identity").when(low, "coverage").when(poor, "identity")
    return out.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "accepted").otherwise("rejected"))


def gff_phase(features: DataFrame) -> DataFrame:
    """features (feature_type, codon_start) with phase: codon_start - 1 for CDS, ``.`` for others; codon_start defaults to 1."""
    start = F.coalesce(F.expr("try_cast(codon_start as int)"), F.lit(1))
    return features.withColumn("phase", F.when(F.col("feature_type") == "CDS", (start - 1).cast("string")).otherwise("."))


def inverted_repeat_pair(hits: DataFrame, min_length: int = 10_000, min_identity: float = 99.0, *by: str) -> DataFrame:
    """Of self hits on the reverse strand that are long and alike enough, the longest (then the best score) as two intervals."""
    reverse = hits.filter(((F.col("qstart") <= F.col("qend")) != (F.col("sstart") <= F.col("send"))) & (F.col("length") >= min_length) & (F.col("identity") >= min_identity))
    one = F.struct((F.least("qstart", "qend") - 1).alias("start"), F.greatest("qstart", "qend").alias("end"))
    two = F.struct((F.least("sstart", "send") - 1).alias("start"), F.greatest("sstart", "send").alias("end"))
    pair = reverse.groupBy(*by).agg(F.max_by(F.array_sort(F.array(one, two)), F.struct("length", "bitscore", -F.col("hit_no"))).alias("p"))
    return pair.filter("p is not null").select(*by, *[F.get("p", i)[c].alias(f"{c}_{i + 1}") for i in (0, 1) for c in ("start", "end")])


def terminal_repeat(hits: DataFrame, retained: int, total: int, min_identity: float = 99.0, tolerance: int = 25, *by: str) -> DataFrame:
    """Of self hits on one strand, the longest that runs from the start to behind the retained length, where the sequence
    repeats its beginning: first copy at the start, second from the retained length to the end, within the tolerance."""
    h = hits.filter((F.col("qstart") <= F.col("qend")) & (F.col("sstart") <= F.col("send")) & (F.col("identity") >= min_identity))
    h = h.filter((F.col("qstart") != F.col("sstart")) | (F.col("qend") != F.col("send")))
    first_q = F.col("qstart") <= F.col("sstart")
    pick = lambda a, b: F.when(first_q, F.col(a)).otherwise(F.col(b))
    h = h.withColumns({"s1": pick("qstart", "sstart") - 1, "e1": pick("qend", "send"), "s2": pick("sstart", "qstart") - 1, "e2": pick("send", "qend")})
    near = lambda x, y: F.abs(x - y) <= tolerance
    h = h.filter(near(F.col("s1"), F.lit(0)) & near(F.col("s2"), F.lit(retained)) & near(F.col("e2"), F.lit(total)))
    best = h.groupBy(*by).agg(F.max_by(F.struct("s1", "e1", "s2", "e2"), F.struct("length", "bitscore", -F.col("hit_no"))).alias("b")).filter("b is not null")
    return best.select(*by, F.col("b.s1").alias("start_1"), F.col("b.e1").alias("end_1"), F.col("b.s2").alias("start_2"), F.col("b.e2").alias("end_2"))


def self_repeats(hits: DataFrame, *by: str, min_length: int = 100, min_identity: float = 95.0) -> DataFrame:
    """Both copies of all self hits off the diagonal that are long and alike enough, merged."""
    off = (F.col("qstart") != F.col("sstart")) | (F.col("qend") != F.col("send"))
    h = hits.filter(off & (F.col("length") >= min_length) & (F.col("identity") >= min_identity))
    copies = F.array(*[F.struct((F.least(a, b) - 1).alias("start"), F.greatest(a, b).alias("end")) for a, b in (("qstart", "qend"), ("sstart", "send"))])
    return merge_intervals(h.select(*by, F.explode(copies).alias("c")).select(*by, "c.start", "c.end"), *by)


def interval_errors(intervals: DataFrame, length: int) -> DataFrame:
    """Intervals out of bounds or without length."""
    why = F.when(F.col("start") < 0, "starts before 0").when(F.col("end") > length, "ends after the sequence").when(F.col("start") >= F.col("end"), "empty")
    return intervals.withColumn("error", why).filter("error is not null")
