import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from codestrata.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SMALL)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, want.select(*columns).fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_the_optional_operators(tmp_path):
    """The package works where the optional subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parents[1]
    for p in [root / "__spark_entry__.py", *(root / "codestrata").rglob("*.py")]:
        if "llm" not in p.parts:
            (tmp_path / p.relative_to(root)).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p.relative_to(root)).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'owner_longest_prefix' in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
