"""Driver contract: entry() and every registered query against its SQL on
DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from preflight.plans.showcase import QUERIES
from conftest import ROOT, SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return float(v) if type(v).__name__ == "Decimal" else v
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"status", "detail", "model", "check"} <= set(df.columns)


NAMES = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s = canon(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry.oracle_sql()[name])
    d = canon([c[0] for c in res.description], res.fetchall())
    assert s == d


def test_without_the_training_data_operators(tmp_path):
    """The entry imports, and the other queries stay, where that subpackage
    and its pipeline are not there."""
    import shutil
    import subprocess
    import sys

    for name in ("__spark_entry__.py", "oracle_sql.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "preflight"), tmp_path / "preflight",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.stdout.split()[-2:] == [str(len(QUERIES)), "False"], got.stderr[-500:]
