"""Data-quality checks. Each returns the rows that violate it: none is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def reconcile_manifests(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, size_bytes, digest) of both sides -> path, status: missing, unlisted, mismatch, duplicate or match."""
    side = lambda df, p: df.groupBy("path").agg(F.count(F.lit(1)).alias(f"{p}n"), F.min("digest").alias(f"{p}digest"), F.min("size_bytes").alias(f"{p}size"))
    both = side(expected, "e_").join(side(observed, "o_"), "path", "full_outer")
    status = (
        F.when(F.col("o_n").isNull(), "missing").when(F.col("e_n").isNull(), "unlisted").when((F.col("e_n") > 1) | (F.col("o_n") > 1), "duplicate")
        .when((F.col("e_digest") != F.col("o_digest")) | (F.col("e_size") != F.col("o_size")), "mismatch").otherwise("match")
    )
    return both.select("path", status.alias("status"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that changed, came or went between two inventories."""
    names = F.when(F.col("status") == "missing", "removed").when(F.col("status") == "unlisted", "added").when(F.col("status").isin("mismatch", "duplicate"), "changed")
    return reconcile_manifests(before, after).select("path", names.alias("change")).filter("change is not null")


def resolve_by_basename(names: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """names (name) against files (path) below a root, by last path component: none, one (with its path), or too many."""
    own = files.filter(F.col("path").startswith(root)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    counts = own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    out = names.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("name", "n", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") == 0, "DECLARED_MISSING").when(F.col("n") > 1, "FAIL_RESOLUTION").otherwise("RESOLVED").alias("status"))


def set_equality_errors(**tables: DataFrame) -> DataFrame:
    """Ids that one named one-column table has and the first one has not, or the other way round."""
    (first, base), *rest = tables.items()
    key = base.columns[0]
    base = base.select(F.col(key).cast("string").alias("id")).distinct()
    out = []
    for name, df in rest:
        df = df.select(F.col(df.columns[0]).cast("string").alias("id")).distinct()
        out.append(base.join(df, "id", "left_anti").select("id", F.lit(name).alias("missing_in")))
        out.append(df.join(base, "id", "left_anti").select("id", F.lit(first).alias("missing_in")))
    return reduce(DataFrame.unionByName, out)


def attach_metadata(table: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the inner join on sample_id, ids that only one side has)."""
    return table.join(samples, "sample_id"), set_equality_errors(table=table.select("sample_id"), samples=samples.select("sample_id"))


def membership_errors(q: DataFrame, k: int, tolerance: float = 1e-5) -> DataFrame:
    """q (run_id, row, q) rows that don't have k finite shares in [0, 1] that sum to 1."""
    bad = F.exists("q", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    why = F.when(F.size("q") != k, "columns").when(bad, "range").when(F.abs(total - 1) > tolerance, "sum")
    return q.withColumn("error", why).filter("error is not null").select("run_id", "row", "error")


def inventory_errors(rows: DataFrame, types: list[str]) -> DataFrame:
    """Inventory rows (path, artifact_type, size_bytes as text, sha256) that are incomplete, unsafe, repeated or malformed."""
    repeated = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit(True).alias("again"))
    size = F.expr("try_cast(size_bytes as bigint)")
    empty = F.lit(False)
    for c in ("path", "artifact_type", "size_bytes", "sha256"):
        empty = empty | F.col(c).isNull() | (F.col(c) == "")
    why = (
        F.when(empty, "required").when(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "unsafe_path").when(F.coalesce("again", F.lit(False)), "duplicate")
        .when(~F.col("artifact_type").isin(types), "type").when(size.isNull() | (size < 0), "size").when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "digest")
    )
    return rows.join(repeated, "path", "left").select("path", why.alias("error")).filter("error is not null")


def inventory_digest(rows: DataFrame) -> DataFrame:
    """One digest of an inventory: SHA-256 over rows in order of path, each value framed by its length. The rows are
    digested first, so that what is gathered is 64 letters per row."""
    frame = lambda c: F.concat(F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c))
    each = rows.select("path", F.sha2(F.concat(*[frame(c) for c in ("path", "artifact_type", "size_bytes", "sha256")]), 256).alias("d"))
    # two levels: a part by the first hexadecimal digits of the path's digest, then the parts in order
    part = each.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return part.agg(F.count(F.lit(1)).alias("parts"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def inventory_verify(manifest: DataFrame, current: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Manifest rows that the current files don't bear out, without the paths that are allowed to differ."""
    return reconcile_manifests(manifest, current).filter("status <> 'match' and status <> 'unlisted'").join(exceptions, "path", "left_anti")


def source_consistency(one: DataFrame, two: DataFrame) -> DataFrame:
    """(accession, seq) of two copies -> whether lengths and sequences agree."""
    a, b = one.select("accession", F.col("seq").alias("a")), two.select("accession", F.col("seq").alias("b"))
    both = a.join(b, "accession", "full_outer")
    return both.select("accession", F.length("a").alias("length_1"), F.length("b").alias("length_2"), F.coalesce(F.length("a") == F.length("b"), F.lit(False)).alias("same_length"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_sequence"))


def metadata_ambiguities(samples: DataFrame) -> DataFrame:
    """Populations with more than one taxon, and samples without a population."""
    several = samples.groupBy("popcode").agg(F.count_distinct("taxon").alias("n"), F.array_join(F.array_sort(F.collect_set("taxon")), ";").alias("detail")).filter("n > 1 and popcode is not null and popcode <> ''")
    none = samples.filter("popcode is null or popcode = ''").select(F.lit("unresolved").alias("kind"), F.col("sample_id").cast("string").alias("subject"), F.lit("").alias("detail"))
    return several.select(F.lit("conflict").alias("kind"), F.col("popcode").alias("subject"), "detail").unionByName(none)


def manifest_completeness(manifest: DataFrame, families: list[str], variants: list[str]) -> DataFrame:
    """Families that are unknown, missing, or lack or exceed the required variants."""
    have = manifest.groupBy("family").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    want = F.array(*map(F.lit, sorted(variants)))
    known = have.select("family", F.when(~F.col("family").isin(families), "unknown").when(F.col("variants") != want, "variants").alias("error"))
    required = manifest.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, families))).alias("family"))
    missing = required.join(have, "family", "left_anti").select("family", F.lit("missing").alias("error"))
    return known.filter("error is not null").unionByName(missing)


def checksum_gate(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: PASS or FAIL, and the names that fail and aren't declared exceptions."""
    failed = rows.filter(F.col("status").startswith("FAIL")).join(exceptions, "path", "left_anti")
    return failed.agg(F.when(F.count(F.lit(1)) == 0, "PASS").otherwise("FAIL").alias("status"), F.count(F.lit(1)).alias("failures"))


def assessability(screens: DataFrame) -> DataFrame:
    """screens (screen, inputs) -> untestable where a screen has no inputs."""
    return screens.groupBy("screen").agg(F.when(F.sum("inputs") > 0, "testable").otherwise("untestable").alias("status"))


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def acceptance_gate(**violations: DataFrame) -> DataFrame:
    """check, violations, status: a row per named table of violations. Findings about the science aren't violations."""
    rows = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in violations.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def write_gated(spark: SparkSession, outputs: dict[str, DataFrame], checks: dict[str, dict[str, Column]], folder: str) -> DataFrame:
    """Writes each output to a folder of its name as Parquet and counts the rows that break its checks while they are written.

    checks: output -> check -> a condition that is true of rows that violate it (null is no violation). Gives output, check,
    rows, violations, status; an empty output breaks no check. Counts are taken by the tasks that write: a task that is
    repeated, or a stage that is recomputed before it, isn't counted twice. Rules over several rows are checked on what was
    written, by ``acceptance_gate``.
    """
    seen = []
    for name, df in outputs.items():
        broken = checks.get(name, {})
        noted = Observation()
        counts = [F.count_if(c).alias(f"v{i}") for i, c in enumerate(broken.values())]
        df.observe(noted, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(f"{folder.rstrip('/')}/{name}")
        found = noted.get
        seen += [(name, check, found["rows"] or 0, n, "FAIL" if n else "PASS") for i, check in enumerate(broken) for n in [found[f"v{i}"] or 0]]
    return spark.createDataFrame(seen, "output string, check string, rows long, violations long, status string")
