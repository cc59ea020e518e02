"""Readers: files or lines of text -> typed tables. parse_* take a DataFrame of lines (value), read_* a path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS = "query string, subject string, identity double, length int, qstart int, qend int, sstart int, send int, bitscore double, qlen int, slen int"
INTERVALS = "contig string, start int, end int, name string"


def parse_fasta(records: DataFrame) -> DataFrame:
    """Records (value: a header line and sequence lines, without the ``>``) -> header (its first word), seq in capitals."""
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    seq = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, 1 << 30), ""), r"\s", ""))
    return records.filter(F.trim("value") != "").select(F.element_at(F.split(F.get(lines, F.lit(0)), r"\s+"), 1).alias("header"), seq.alias("seq"))


def read_alignment(spark: SparkSession, path: str, contig: str = "c1") -> DataFrame:
    """FASTA -> contig, sample_id, seq. A record is a row from the start: the separator of rows is ``>``."""
    return parse_fasta(spark.read.option("lineSep", ">").text(path)).select(F.lit(contig).alias("contig"), F.col("header").alias("sample_id"), "seq")


def fasta_errors(alignment: DataFrame) -> DataFrame:
    """Records that are empty or have letters outside ACGTN."""
    return alignment.filter((F.length("seq") == 0) | F.col("seq").rlike("[^ACGTN]"))


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A tab-separated table with a header; values that don't fit the schema are errors."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST")


def parse_intervals(lines: DataFrame, contig: str | None = None) -> DataFrame:
    """BED lines -> contig, start, end, name; blank lines and comments are skipped, and with ``contig`` only its rows kept."""
    p = F.split("value", "\t")
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$")).select(*[F.get(p, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(x.split() for x in INTERVALS.split(", "))])
    return rows if contig is None else rows.filter(F.col("contig") == contig)


def read_intervals(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    return parse_intervals(spark.read.text(path), contig)


def parse_vcf(lines: DataFrame, samples: list[str]) -> DataFrame:
    """VCF lines -> contig, pos (1-based), ref, alts, qual, sample_id, gt (0, 1 or NULL), dp, gq, in the samples' header order.

    FORMAT keys are matched by name for each line; anything but 0 and 1 is no genotype.
    """
    f = F.split("value", "\t")
    # a line is split before rows are made of its samples: it goes with none of them
    sites = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        f[0].alias("contig"), f[1].cast("int").alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), f[5].try_cast("double").alias("qual"), F.split(f[8], ":").alias("keys"), F.slice(f, 10, 1 << 30).alias("all")
    )
    rows = sites.select("contig", "pos", "ref", "alts", "qual", "keys", F.posexplode("all").alias("i", "v"))
    values = F.split("v", ":")
    field = lambda k: F.get(values, F.array_position("keys", k).cast("int") - 1)
    names = F.split(F.lit("\t".join(samples)), "\t") if samples else F.array().cast("array<string>")  # one literal, however many
    return rows.select("contig", "pos", "ref", "alts", "qual", F.get(names, F.col("i")).alias("sample_id"), F.when(field("GT").isin("0", "1"), field("GT").cast("int")).alias("gt"), field("DP").try_cast("int").alias("dp"), field("GQ").try_cast("int").alias("gq"))


def vcf_samples(lines: DataFrame) -> list[str]:
    """The sample names of the header line: one line, whatever the file."""
    head = lines.filter(F.col("value").startswith("#CHROM")).limit(1).collect()
    return head[0].value.split("\t")[9:] if head else []


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return parse_vcf(lines, vcf_samples(lines))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """contig, 1-based position, depth -> contig, pos (0-based), depth."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, pos int, depth bigint", mode="FAILFAST")
    return rows.withColumn("pos", F.col("pos") - 1)


def parse_hits(lines: DataFrame) -> DataFrame:
    """Tabular hits of 11 columns; comments are skipped; a line of another width raises an error."""
    p = F.split("value", "\t")
    fields = [x.strip().split(" ") for x in HITS.split(",")]
    width = F.assert_true(F.size(p) == len(fields), F.lit("a hit has 11 columns"))
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    return rows.filter(width.isNull()).select(*[F.get(p, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_hits(spark.read.text(path))


_TOTALS = "struct<total_reads: long, total_bases: long, q20_rate: double, q30_rate: double>"
QC_REPORT = (
    f"summary struct<before_filtering: {_TOTALS}, after_filtering: {_TOTALS}>, "
    "filtering_result struct<passed_filter_reads: long, low_quality_reads: long, too_many_N_reads: long, adapter_dimer_reads: long, too_short_reads: long>, "
    "adapter_cutting struct<adapter_trimmed_reads: long, adapter_trimmed_bases: long>, duplication struct<rate: double>"
)
#: Name of a metric -> where a report has it.
QC_METRICS = {
    "input_reads": "summary.before_filtering.total_reads", "input_bases": "summary.before_filtering.total_bases", "input_q20_rate": "summary.before_filtering.q20_rate", "input_q30_rate": "summary.before_filtering.q30_rate",
    "passing_reads": "summary.after_filtering.total_reads", "bases": "summary.after_filtering.total_bases", "q20_rate": "summary.after_filtering.q20_rate", "q30_rate": "summary.after_filtering.q30_rate",
    "low_quality_reads": "filtering_result.low_quality_reads", "too_many_n_reads": "filtering_result.too_many_N_reads", "adapter_dimer_reads": "filtering_result.adapter_dimer_reads", "too_short_reads": "filtering_result.too_short_reads",
    "adapter_trimmed_reads": "adapter_cutting.adapter_trimmed_reads", "adapter_trimmed_bases": "adapter_cutting.adapter_trimmed_bases", "duplication": "duplication.rate",
}


def parse_qc_reports(reports: DataFrame) -> DataFrame:
    """(sample_id, value: a JSON report) -> its counts and rates, retention, and four checks that are false where a part is missing:
    reads in and out are possible, the counts of passing reads agree, rates are in [0, 1], and adapters were cut from possibly many reads."""
    r = reports.select("sample_id", F.from_json("value", QC_REPORT).alias("r")).select("sample_id", "r.*")
    out = r.select("sample_id", *[F.col(path).alias(name) for name, path in QC_METRICS.items()], F.col("filtering_result.passed_filter_reads").alias("passed"))
    rates = [F.col(c).between(0, 1) for c in ("input_q20_rate", "input_q30_rate", "q20_rate", "q30_rate", "duplication")]
    checks = {
        "counts_possible": (F.col("input_reads") > 0) & F.col("passing_reads").between(0, F.col("input_reads")),
        "counts_agree": F.col("passed") == F.col("passing_reads"),
        "rates_possible": reduce(Column.__and__, rates),
        "adapters_possible": F.col("adapter_trimmed_reads").between(0, F.col("input_reads")),
    }
    out = out.withColumns({name: F.coalesce(x, F.lit(False)) for name, x in checks.items()}).drop("passed")
    return out.withColumn("retention", F.try_divide(F.col("passing_reads").cast("double"), F.col("input_reads").cast("double")))


def read_qc_reports(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("sample_id"), "value")
    return parse_qc_reports(files)


def population_codes(table: DataFrame) -> DataFrame:
    """A table with a column whose header begins with "code" (and Species, Population Name) -> code, species, names, conflict.

    Repeated codes are merged: names in order, joined; several species are a conflict.
    """
    clean = table.toDF(*[c.lstrip("﻿").strip() for c in table.columns])
    code = next(c for c in clean.columns if c.lower().startswith("code"))
    rows = clean.select(F.trim(F.col(f"`{code}`")).alias("code"), F.trim("Species").alias("species"), F.trim("Population Name").alias("name")).filter("code <> ''")
    return rows.groupBy("code").agg(F.min("species").alias("species"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"), (F.count_distinct("species") > 1).alias("conflict"))


def read_population_codes(spark: SparkSession, path: str) -> DataFrame:
    return population_codes(spark.read.csv(path, header=True))


def pair_status(paths: DataFrame, pattern: str = r"([^/]+?)_(?:L\d{3}_)?R([12])(?:_\d{3})?\.fastq\.gz$") -> DataFrame:
    """paths (path) -> sample_id, r1_paths, r2_paths, pair_status; paths that don't fit the pattern are left out."""
    rows = paths.select("path", F.regexp_extract("path", pattern, 1).alias("sample_id"), F.regexp_extract("path", pattern, 2).alias("mate")).filter("sample_id <> ''")
    of = lambda m: F.array_sort(F.collect_list(F.when(F.col("mate") == m, F.col("path"))))
    out = rows.groupBy("sample_id").agg(of("1").alias("r1_paths"), of("2").alias("r2_paths"))
    a, b = F.size("r1_paths"), F.size("r2_paths")
    return out.withColumn("pair_status", F.when(a == 0, "missing_R1").when(b == 0, "missing_R2").when(a != b, "unbalanced_lanes").otherwise("complete"))


def discover_samples(spark: SparkSession, root: str) -> DataFrame:
    """Sample pairs of the files below a folder; only their paths are read."""
    return pair_status(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))


def parse_split_nexus(texts: DataFrame) -> DataFrame:
    """(tree_id, value: a splits NEXUS file) -> tree_id, members, length (weight / 100), n_taxa; trivial splits are left out."""
    taxa = F.regexp_extract_all("value", F.lit(r"(?m)^\[\d+\]\s+'?([^'\s]+)'?\s*$"), F.lit(1))
    rows = F.regexp_extract_all("value", F.lit(r"(?m)^\[[^\]]*\]\s+[\d.eE+-]+\s+[\d ]+,\s*$"), F.lit(0))
    # both are found before rows are made of them: a text goes with none of its rows
    out = texts.select("tree_id", taxa.alias("taxa"), rows.alias("rows")).select("tree_id", "taxa", F.explode("rows").alias("row"))
    weight = F.regexp_extract("row", r"^\[[^\]]*\]\s+([\d.eE+-]+)\s", 1).cast("double")
    numbers = F.split(F.trim(F.regexp_extract("row", r"^\[[^\]]*\]\s+[\d.eE+-]+\s+([\d ]+),", 1)), r"\s+")
    out = out.select("tree_id", "taxa", (weight / 100).alias("length"), F.transform(numbers, lambda i: F.get("taxa", i.cast("int") - 1)).alias("members"))
    size, n = F.size("members"), F.size("taxa")
    return out.filter((size >= 2) & (size <= n - 2)).select("tree_id", F.array_sort("members").alias("members"), "length", n.alias("n_taxa"))


def parse_report_regions(reports: DataFrame) -> DataFrame:
    """(contig, run, value: a likelihood-mapping report) -> the seven areas' counts, and shares at corners, sides and centre."""
    area = lambda i: F.regexp_extract("value", rf"(?m)^\s*{i}\s*\|\s*(\d+)", 1).try_cast("long")
    out = reports.select("contig", "run", *[area(i).alias(f"area_{i}") for i in range(1, 8)])
    total = sum((F.col(f"area_{i}") for i in range(1, 8)), F.lit(0)).cast("double")
    share = lambda *k: F.try_divide(sum((F.col(f"area_{i}") for i in k), F.lit(0)).cast("double"), total)
    return out.withColumns({"resolved": share(1, 2, 3), "side": share(4, 5, 6), "centre": share(7)})


def inventory_columns(content: Column) -> list[Column]:
    """SHA-256 and MD5 of a file's bytes, from one read."""
    return [F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5")]


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, sha256, md5 of all files below a folder. Symlinks can't be told apart here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), *inventory_columns(F.col("content")))
