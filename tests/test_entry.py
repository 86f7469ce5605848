import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gramweave.plans import registry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"p_brand", "pairs", "total_distance", "max_distance"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = registry.QUERIES[name](spark, str(DATA))
    want = con.sql(registry.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    order = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=order) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=order)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


@needs_data
def test_workers_get_the_package_from_anywhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["lcs_pairs"](spark, {str(DATA)!r}).count() > 0
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env, capture_output=True)


def test_the_rest_works_without_the_separable_subpackage(tmp_path):
    for name in ("gramweave", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "gramweave").mkdir()
    for part in (ROOT / "gramweave").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "gramweave" / part.name).symlink_to(part)
    code = "import sys; sys.path[:] = ['.'] + [p for p in sys.path if 'repo' not in p]; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
