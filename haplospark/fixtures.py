"""Population-genomic tables derived from the given star-schema tables, with integer arithmetic that SQL engines share.

Each table has a Spark form (a function of the session and the directory) and a SQL form (``CTES``), so that a query and its
oracle read the same rows. Alignments have LENGTH positions; contig c1 is positions 0-139, c2 the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, SPLIT = 200, 140


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(shift: int) -> F.Column:
    return F.substring(F.lit("ACGT"), (F.lit(1) + (F.col("pos") * 7 + shift) % 4).cast("int"), F.lit(1))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("s_suppkey").cast("long").alias("sample_id"), F.col("n_name").alias("popcode"), F.col("r_name").alias("taxon"), F.col("n_nationkey").cast("int").alias("nk"), F.col("r_regionkey").cast("int").alias("rk"))


def positions(spark: SparkSession) -> DataFrame:
    p = spark.range(LENGTH).select(F.col("id").cast("int").alias("pos"))
    return p.select(F.when(F.col("pos") < SPLIT, "c1").otherwise("c2").alias("contig"), "pos")


def reference(spark: SparkSession) -> DataFrame:
    return positions(spark).withColumn("ref", _base(3))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: a row per sample and position, zeros included. Zero filling explodes positions per sample, no cross join."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("sample_id"), (F.col("l_partkey") % LENGTH).cast("int").alias("pos")).agg(F.count(F.lit(1)).alias("depth"))
    dense = samples(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))))
    dense = dense.withColumn("contig", F.when(F.col("pos") < SPLIT, "c1").otherwise("c2"))
    return dense.join(counts, ["sample_id", "pos"], "left").select("contig", "sample_id", "popcode", "taxon", "nk", "rk", "pos", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth(spark, sf_dir)
    third = (F.col("pos") % 35 == 0) & (F.col("sample_id") % 7 == 0)
    draw = (F.col("sample_id") * 31 + F.col("pos") * 17 + F.col("nk") * 13) % 10
    alternate = (F.col("pos") % 5 == 0) & (draw < (F.col("rk") * 3 + F.floor(F.col("pos") / 5)) % 11)
    uncalled = (F.col("depth") < 1) | ((F.col("sample_id") * 13 + F.col("pos") * 29) % 97 == 0)
    base = F.when(uncalled, "N").when(third, _base(6)).when(alternate, _base(4)).otherwise(_base(3))
    return d.select("contig", "sample_id", "popcode", "taxon", "pos", "depth", _base(3).alias("ref"), base.alias("base"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sample and position with the evidence of a haploid call; pos is 0-based."""
    c = calls(spark, sf_dir).withColumn("alt", _base(4))
    gt = F.when(F.col("base") == F.col("ref"), 0).when(F.col("base") == F.col("alt"), 1)
    c = c.withColumn("gt", gt).withColumn("alt_reads", F.coalesce("gt", F.lit(0)) * F.floor(F.col("depth") / 2))
    return c.select(
        "contig", "sample_id", "popcode", "pos", "ref", "alt", "base", "gt", F.col("depth").alias("dp"), ((F.col("sample_id") * 7 + F.col("pos") * 3) % 60).alias("gq"),
        (20 + F.col("pos") % 30).cast("double").alias("qual"), F.array(F.col("depth") - F.col("alt_reads"), F.col("alt_reads")).alias("ad"), F.array(F.lit(0).cast("long"), F.col("depth") * 3, F.col("depth") * 10).alias("pl"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals: one per order, under the name of its customer."""
    o = table(spark, sf_dir, "orders")
    start = ((F.col("o_orderkey") * 37) % 180).cast("int")
    return o.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("name"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 20).cast("int").alias("end"), F.col("o_orderkey").alias("interval_id"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals of the positions that have less than the mean depth over all samples."""
    total = depth(spark, sf_dir).groupBy("pos").agg(F.sum("depth").alias("total"))
    mean = total.agg(F.avg("total").alias("mean"))
    return total.join(F.broadcast(mean)).filter("total < mean").select(F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment hits, 1-based inclusive; a third of them on the reverse strand (subject end before start)."""
    o = table(spark, sf_dir, "orders")
    q = (1 + (F.col("o_custkey") * 37) % 900).cast("int")
    e = (q + 9 + F.col("o_orderkey") % 90).cast("int")
    swap = F.col("o_orderkey") % 3 == 0
    return o.select(
        F.col("o_orderkey").alias("hit_no"), F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("subject"), (80 + (F.col("o_orderkey") % 200) / 10).alias("identity"), (e - q + 1).alias("length"),
        q.alias("qstart"), e.alias("qend"), F.when(swap, e).otherwise(q).alias("sstart"), F.when(swap, q).otherwise(e).alias("send"), (F.col("o_orderkey") % 1000).cast("double").alias("bitscore"),
        F.lit(1000).alias("qlen"), F.lit(1000).alias("slen"),
    )


def manifest(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """path, size_bytes, digest of the documents; the changed one drops and alters some rows."""
    d = table(spark, sf_dir, "documents")
    digest = F.md5(F.coalesce("text", F.lit("")))
    if changed:
        d = d.filter("doc_id % 17 <> 0")
        digest = F.when(F.col("doc_id") % 23 == 0, F.md5(F.lit("changed"))).otherwise(digest)
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size_bytes"), digest.alias("digest"))


CTES = {
    "samples": "SELECT s_suppkey::BIGINT AS sample_id, n_name AS popcode, r_name AS taxon, n_nationkey::INT AS nk, r_regionkey::INT AS rk FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "positions": "SELECT range::INT AS pos, CASE WHEN range < 140 THEN 'c1' ELSE 'c2' END AS contig FROM range(200)",
    "reference": "SELECT contig, pos, substr('ACGT', 1 + (pos * 7 + 3) % 4, 1) AS ref FROM positions",
    "depth": """SELECT p.contig, s.sample_id, s.popcode, s.taxon, s.nk, s.rk, p.pos, coalesce(c.depth, 0)::BIGINT AS depth FROM samples s CROSS JOIN positions p LEFT JOIN
        (SELECT l_suppkey AS sid, (l_partkey % 200)::INT AS pp, count(*) AS depth FROM lineitem GROUP BY 1, 2) c ON c.sid = s.sample_id AND c.pp = p.pos""",
    "calls": """SELECT contig, sample_id, popcode, taxon, pos, depth, substr('ACGT', 1 + (pos * 7 + 3) % 4, 1) AS ref,
        CASE WHEN depth < 1 OR (sample_id * 13 + pos * 29) % 97 = 0 THEN 'N'
             WHEN pos % 35 = 0 AND sample_id % 7 = 0 THEN substr('ACGT', 1 + (pos * 7 + 6) % 4, 1)
             WHEN pos % 5 = 0 AND (sample_id * 31 + pos * 17 + nk * 13) % 10 < (rk * 3 + pos // 5) % 11 THEN substr('ACGT', 1 + (pos * 7 + 4) % 4, 1)
             ELSE substr('ACGT', 1 + (pos * 7 + 3) % 4, 1) END AS base FROM depth""",
    "genotypes": """SELECT contig, sample_id, popcode, pos, ref, alt, base, gt, depth AS dp, (sample_id * 7 + pos * 3) % 60 AS gq, (20 + pos % 30)::DOUBLE AS qual,
        [depth - coalesce(gt, 0) * (depth // 2), coalesce(gt, 0) * (depth // 2)] AS ad, [0, depth * 3, depth * 10] AS pl
        FROM (SELECT *, substr('ACGT', 1 + (pos * 7 + 4) % 4, 1) AS alt, CASE WHEN base = ref THEN 0 WHEN base = substr('ACGT', 1 + (pos * 7 + 4) % 4, 1) THEN 1 END AS gt FROM calls)""",
    "intervals": "SELECT 'c-' || o_custkey AS name, ((o_orderkey * 37) % 180)::INT AS start, ((o_orderkey * 37) % 180 + 1 + o_orderkey % 20)::INT AS \"end\", o_orderkey AS interval_id FROM orders",
    "mask": "SELECT pos AS start, pos + 1 AS \"end\" FROM (SELECT pos, sum(depth) AS total FROM depth GROUP BY pos) WHERE total < (SELECT sum(depth)::DOUBLE / 200 FROM depth)",
    "hits": """SELECT o_orderkey AS hit_no, o_orderpriority AS query, o_orderstatus AS subject, 80 + (o_orderkey % 200) / 10 AS identity, 10 + (o_orderkey % 90)::INT AS length,
        (1 + (o_custkey * 37) % 900)::INT AS qstart, (10 + (o_custkey * 37) % 900 + o_orderkey % 90)::INT AS qend,
        (CASE WHEN o_orderkey % 3 = 0 THEN 10 + (o_custkey * 37) % 900 + o_orderkey % 90 ELSE 1 + (o_custkey * 37) % 900 END)::INT AS sstart,
        (CASE WHEN o_orderkey % 3 = 0 THEN 1 + (o_custkey * 37) % 900 ELSE 10 + (o_custkey * 37) % 900 + o_orderkey % 90 END)::INT AS send,
        (o_orderkey % 1000)::DOUBLE AS bitscore, 1000 AS qlen, 1000 AS slen FROM orders""",
    "manifest_a": "SELECT source || '/' || doc_id AS path, n_chars AS size_bytes, md5(coalesce(text, '')) AS digest FROM documents",
    "manifest_b": "SELECT source || '/' || doc_id AS path, n_chars AS size_bytes, CASE WHEN doc_id % 23 = 0 THEN md5('changed') ELSE md5(coalesce(text, '')) END AS digest FROM documents WHERE doc_id % 17 <> 0",
}
_NEEDS = {"mask": ["depth"], "reference": ["positions"], "depth": ["samples", "positions"], "calls": ["depth"], "genotypes": ["calls"]}


def with_ctes(sql: str, *names: str) -> str:
    """sql after a WITH clause for the named tables and what they need; sql may go on with CTEs of its own (``, x AS ...``)."""
    have: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in have:
            have.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in have) + ("" if sql.lstrip().startswith(",") else "\n") + sql
