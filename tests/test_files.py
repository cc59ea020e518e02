"""Data sources over files: ranges of any size give the same rows, keys are chosen by the reader, and gates count while they write."""

import gzip

import pytest
from pyspark.sql import functions as F

from haplospark.operators import quality as dq
from haplospark.sources import files, readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ranges_of_any_size_give_each_line_once(spark, tmp_path, size):
    lines = [f"c{i % 3}\t{i}\t{i + 5}\tn{i}" for i in range(40)]
    (tmp_path / "a.bed").write_text("# head\n" + "\n".join(lines[:25]) + "\n\n")
    (tmp_path / "b.bed").write_bytes("\r\n".join(lines[25:]).encode())
    (tmp_path / "_log").write_text("c1\t1\t2\tx\n")
    got = files.open_files(spark, "bed", str(tmp_path), rangeBytes=str(size))
    assert rows(got) == sorted([(f"c{i % 3}", i, i + 5, f"n{i}") for i in range(40)], key=str)
    assert got.filter("contig = 'c1' and start > 10").count() == len([i for i in range(11, 40) if i % 3 == 1])
    some = files.open_files(spark, "bed", str(tmp_path), ["c1", "c9"], rangeBytes=str(size))
    assert rows(some) == rows(got.filter("contig = 'c1'")) and len(rows(some)) == 13
    assert rows(got) == rows(readers.parse_intervals(spark.createDataFrame([(x,) for x in lines], "value string")))


@pytest.mark.parametrize("size", [5, 23, 1 << 20])
def test_sequences_belong_to_the_range_of_their_header(spark, tmp_path, size):
    records = {f"s{i}": "ACGTN"[i % 5] * (i * 7 % 31) for i in range(12)}
    (tmp_path / "x.fa").write_text("".join(f">{k} note\n" + "".join(v[j : j + 10].lower() + "\n" for j in range(0, len(v), 10)) for k, v in records.items()))
    got = files.open_files(spark, "fasta", str(tmp_path / "x.fa"), rangeBytes=str(size))
    assert rows(got) == sorted(records.items(), key=str)
    assert rows(files.open_files(spark, "fasta", str(tmp_path / "x.fa"), ["s3"], rangeBytes=str(size))) == [("s3", records["s3"])]


def test_compressed_files_and_paths_with_a_scheme(spark, tmp_path):
    (tmp_path / "d.txt.gz").write_bytes(gzip.compress(b"c1\t1\t9\nc2\t5\t0\n"))
    got = files.open_files(spark, "depth", f"file://{tmp_path}", rangeBytes="3")
    assert rows(got) == [("c1", 0, 9), ("c2", 4, 0)]
    (tmp_path / "s.fa.gz").write_bytes(gzip.compress(b">a\nAC\n>b\nGT\n"))
    assert rows(files.open_files(spark, "fasta", str(tmp_path / "s.fa.gz"))) == [("a", "AC"), ("b", "GT")]


def test_genotype_columns_come_from_the_header(spark, tmp_path):
    g = spark.createDataFrame(
        [("k", 3, "A", "T", 30.0, s, gt, dp, 7) for s, gt, dp in (("m.1", 0, 4), ("m`2", None, 0))] + [("l", 8, "C", "G", 9.5, s, 1, 2, 50) for s in ("m.1", "m`2")],
        "contig string, pos int, ref string, alt string, qual double, sample_id string, gt int, dp int, gq int",
    )
    path = str(tmp_path / "v")
    writers.write_genotypes(g, path)
    wide = files.open_files(spark, "vcf", path)
    assert wide.columns == ["contig", "pos", "ref", "alts", "qual", "m.1", "m`2"]
    expected = [("k", 4, "A", ["T"], 30.0, "m.1", 0, 4, 7), ("k", 4, "A", ["T"], 30.0, "m`2", None, None, 7)]
    assert rows(files.long_genotypes(wide.filter("contig = 'k'"))) == expected  # and the next line reads all rows again
    assert rows(files.long_genotypes(files.open_files(spark, "vcf", path, ["k"]))) == expected
    assert rows(files.long_genotypes(wide)) == rows(readers.read_genotypes(spark, path))


def test_genotypes_as_rows_have_no_column_per_sample(spark, tmp_path):
    g = spark.range(40).selectExpr("'k' as contig", "cast(id % 2 as int) as pos", "'A' as ref", "'T' as alt", "30.5D as qual", "concat('s', id div 2) as sample_id", "cast(case when id % 3 > 0 then id % 3 - 1 end as int) as gt", "cast(id % 5 as int) as dp", "cast(id as int) as gq")
    path = str(tmp_path / "v")
    writers.write_genotypes(g, path)
    expected = rows(readers.read_genotypes(spark, path))
    for size in (11, 1 << 20):
        got = files.open_files(spark, "vcf", path, long="true", rangeBytes=str(size))
        assert got.columns == ["contig", "pos", "ref", "alts", "qual", "sample_id", "gt", "dp", "gq"]
        assert rows(got) == expected and len(expected) == 40
    assert files.open_files(spark, "vcf", path, ["none"], long="true").count() == 0


def test_lines_that_are_no_hits_fail_and_missing_folders_too(spark, tmp_path):
    (tmp_path / "h").write_text("q\ts\t1.0\n")
    with pytest.raises(Exception, match="11 columns"):
        files.open_files(spark, "hits", str(tmp_path / "h")).collect()
    with pytest.raises(Exception, match="nothing_here"):
        files.open_files(spark, "bed", str(tmp_path / "nothing_here")).collect()


def test_empty_files_have_no_rows(spark, tmp_path):
    (tmp_path / "e").write_text("")
    assert files.open_files(spark, "bed", str(tmp_path)).count() == 0
    assert files.open_files(spark, "fasta", str(tmp_path)).count() == 0


def test_a_gate_counts_while_it_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    a = spark.range(100, numPartitions=5).mapInPandas(counted, "id long")
    none = spark.range(0).withColumn("x", F.lit(None).cast("int"))
    checks = {"a": {"even": F.col("id") % 2 == 0, "large": F.col("id") > 200, "unknown": F.lit(None).cast("boolean")}, "none": {"x": F.col("x") < 0}}
    gate = dq.write_gated(spark, {"a": a, "none": none, "free": spark.range(3)}, checks, str(tmp_path))
    assert rows(gate) == sorted([("a", "even", 100, 50, "FAIL"), ("a", "large", 100, 0, "PASS"), ("a", "unknown", 100, 0, "PASS"), ("none", "x", 0, 0, "PASS")], key=str)
    assert seen.value == 100
    assert spark.read.parquet(str(tmp_path / "a")).count() == 100 and spark.read.parquet(str(tmp_path / "free")).count() == 3
