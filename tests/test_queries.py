"""Every registered query against its SQL, and what the driver asks of the entry."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registered
from metricloom import queries, queries_over_results  # noqa: F401

from conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got
    if name in queries.ORACLE_SQL:
        result = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == names
        wanted = sorted((tuple(r[columns.index(c)] for c in names) for r in result.fetchall()), key=repr)
        assert got == wanted


def test_entry(spark):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert set(queries.QUERIES) <= set(registered.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("metricloom", "__spark_entry__.py"):
        os.makedirs(tmp_path / "metricloom", exist_ok=True)
    for folder, _, files in os.walk(f"{root}/metricloom"):
        if "llm" in folder.split(os.sep):
            continue
        to = tmp_path / os.path.relpath(folder, root)
        os.makedirs(to, exist_ok=True)
        for f in files:
            if f.endswith(".py"):
                os.symlink(f"{folder}/{f}", to / f)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
