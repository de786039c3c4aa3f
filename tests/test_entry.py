"""The driver contract."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from sembla.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert all(q.__doc__ or q.__name__ == "<lambda>" for q in registry.queries().values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "ref_id", "distance"] and df.count() > 0


def test_core_works_without_the_subpackage():
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); import importlib.util as u; find = u.find_spec; u.find_spec = lambda n, *a: None if n == 'sembla.llm' else find(n, *a); import __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p4_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
    for path in (ROOT / "sembla").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "sembla").parts:
            assert "sembla.llm" not in path.read_text(), path


def test_workers_get_the_package(tmp_path):
    """Only the driver knows where the package lies."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from sembla.operators.search import knn_join
df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, v array<double>")
assert knn_join(df, df, "id", "v").count() == 4
assert e.queries()["p3_found"](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
