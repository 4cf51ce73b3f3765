"""Every query with SQL gives the SQL's rows and types on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def names():
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from loomgraph.plans.oracles import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    from loomgraph.plans.oracles import ORACLES
    from loomgraph.plans.queries import QUERIES

    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.sql(ORACLES[name])
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {n: TYPES[t] for n, t in found.dtypes} == types
    quoted = ", ".join(f'"{c}"' for c in columns)
    a = sorted(map(tuple, found.select(*columns).collect()), key=repr)
    b = sorted(map(tuple, duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()), key=repr)
    assert a == b


def test_rest_runs_without_llm(tmp_path):
    """With the llm folders and the pipeline gone, all else imports and has its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    from loomgraph.plans.queries import QUERIES

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import pkgutil, importlib, loomgraph, __spark_entry__ as e; [importlib.import_module(m.name) for m in pkgutil.walk_packages(loomgraph.__path__, 'loomgraph.')]; e.oracle_sql(); print(*sorted(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert made.stdout.split() == sorted(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
