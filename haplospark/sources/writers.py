"""Writers. Doubles are formatted only here; NULL is written as nan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_columns(table: DataFrame) -> DataFrame:
    """Every column as text: doubles to twelve significant digits, NULL as ``nan``."""
    # twelve significant digits: round at a place that depends on the size, then print the shortest form
    def text(c: str, t: str):
        x = F.col(f"`{c}`")
        if t not in ("double", "float"):
            return x.cast("string")
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 11)
        short = F.when((x == 0) | F.isnan(x), x).otherwise(F.round(x / unit, 0) * unit)
        return F.when(~F.isnan(x), short.cast("string"))

    return table.select(*[F.coalesce(text(c, t), F.lit("nan")).alias(c) for c, t in table.dtypes])


def write_table(table: DataFrame, path: str, *order: str) -> None:
    """A tab-separated table with a header, in order."""
    export_columns(table.orderBy(*order) if order else table).write.mode("overwrite").option("lineSep", "\n").csv(path, sep="\t", header=True, emptyValue="")


def fasta_lines(alignment: DataFrame, width: int = 80) -> DataFrame:
    """sample_id, seq -> value: a FASTA record of lines of the given width."""
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return alignment.select(F.concat(F.lit(">"), F.col("sample_id").cast("string"), F.lit("\n"), wrapped).alias("value"))


def write_sequences(alignment: DataFrame, path: str, width: int = 80) -> None:
    fasta_lines(alignment.orderBy("sample_id"), width).write.mode("overwrite").text(path)


def bed_lines(intervals: DataFrame) -> DataFrame:
    return intervals.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("contig", "start", "end", "name")]).alias("value"))


def write_intervals(intervals: DataFrame, path: str) -> None:
    bed_lines(intervals.orderBy("contig", "start", "end", "name")).write.mode("overwrite").text(path)


def _escaped(value):
    for char, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def gff_lines(features: DataFrame, source: str = "haplospark") -> DataFrame:
    """features (contig, feature_id, feature_type, start, end: half-open, strand, phase, product) -> GFF3 lines, 1-based."""
    attributes = F.concat(F.lit("ID="), _escaped(F.col("feature_id").cast("string")), F.coalesce(F.concat(F.lit(";product="), _escaped(F.col("product"))), F.lit("")))
    return features.select("contig", "start", "end", F.col("feature_id"), F.concat_ws("\t", "contig", F.lit(source), "feature_type", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", "phase", attributes).alias("value"))


def write_annotations(features: DataFrame, path: str) -> None:
    gff_lines(features).orderBy("start", "end", "feature_id").select("value").write.mode("overwrite").text(path)


def ped_lines(diploid: DataFrame) -> DataFrame:
    """(sample_id, pos, allele_1, allele_2) -> a PED line per sample, markers in order of position."""
    alleles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "allele_1", "allele_2"))), lambda x: F.concat_ws(" ", x["allele_1"], x["allele_2"]))
    s = F.col("sample_id").cast("string")
    return diploid.groupBy("sample_id").agg(F.array_join(alleles, " ").alias("a")).select("sample_id", F.concat_ws(" ", s, s, F.lit("0 0 0 -9"), "a").alias("value"))


def map_lines(diploid: DataFrame) -> DataFrame:
    """A MAP line per marker: contig, name, genetic distance 0, 1-based position."""
    m = diploid.select("contig", "pos").distinct()
    return m.select("contig", "pos", F.concat_ws("\t", "contig", F.concat_ws("_", "contig", (F.col("pos") + 1).cast("string")), F.lit("0"), (F.col("pos") + 1).cast("string")).alias("value"))


def write_ped_map(diploid: DataFrame, path: str) -> None:
    ped_lines(diploid).orderBy("sample_id").select("value").write.mode("overwrite").text(f"{path}.ped")
    map_lines(diploid).orderBy("contig", "pos").select("value").write.mode("overwrite").text(f"{path}.map")


def genotype_lines(genotypes: DataFrame) -> DataFrame:
    """genotypes (contig, pos: 0-based, ref, alt, qual, sample_id, gt, dp, gq) -> contig, pos, value: a VCF line per site.

    Samples are in order of their ids; a sample without a row at a site isn't allowed for, as calls are dense. No depth is a dot.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    value = F.concat_ws(":", text("gt"), F.when(F.col("dp") > 0, text("dp")).otherwise("."), text("gq"))
    sites = genotypes.groupBy("contig", "pos", "ref", "alt", "qual").agg(F.array_sort(F.collect_list(F.struct("sample_id", value.alias("v")))).alias("s"))
    start = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", text("qual"), F.lit("."), F.lit("."), F.lit("GT:DP:GQ"))
    return sites.select("contig", "pos", F.concat_ws("\t", start, F.array_join(F.transform("s", lambda x: x["v"]), "\t")).alias("value"))


def genotype_header(genotypes: DataFrame) -> DataFrame:
    """value: the two header lines, as one row."""
    names = genotypes.select("sample_id").distinct().agg(F.array_join(F.array_sort(F.collect_list("sample_id")), "\t").alias("names"))
    head = "##fileformat=VCFv4.3\n" + "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split())
    return names.select(F.concat_ws("\t", F.lit(head), "names").alias("value"))


def write_genotypes(genotypes: DataFrame, path: str) -> None:
    """A VCF folder: the header in a file of its own, sites in order in the others."""
    genotype_header(genotypes).write.mode("overwrite").text(path)
    genotype_lines(genotypes).orderBy("contig", "pos").select("value").write.mode("append").text(path)
