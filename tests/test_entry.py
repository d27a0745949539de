import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from scorelake.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(found.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in ("__spark_entry__.py", "scorelake"):
        subprocess.run(["cp", "-r", os.path.join(root, p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "scorelake" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a1_task_score' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
