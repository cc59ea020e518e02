"""Registered queries beside their SQL on the smallest tables, and the entry module without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from haplospark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent
SOME = ["jn3_pairwise_distance", "agg1_nucleotide_diversity", "agg2_hudson_fst", "agg6_population_summary", "win1_merge_intervals", "jn4_interval_overlap", "prj5_variant_layers", "stat13_scenario_calls", "gr3_compare_trees", "src5_read_genotypes"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    shown = lambda v: "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    mine = sorted(tuple(shown(x) for x in r) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{x}"' for x in columns)
    theirs = sorted(tuple(shown(x) for x in r) for r in c.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert mine == theirs and mine


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    for name in ("haplospark", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[-1] == "False", out.stderr
