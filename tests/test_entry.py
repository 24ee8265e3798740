import importlib
import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if value is None or isinstance(value, bool | int | str):
        return value
    if hasattr(value, "is_finite"):
        return float(f"{float(value):.9g}")
    return str(value)


def _core_sql():
    from sparkloom import queries

    return sorted(queries.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", _core_sql())
def test_query_equals_its_sql(spark, name):
    from sparkloom import queries

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_core_does_not_import_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "sparkloom")):
        if os.path.basename(folder) != "llm":
            for file in files:
                if file.endswith(".py"):
                    with open(os.path.join(folder, file), encoding="utf-8") as f:
                        assert "sparkloom.llm" not in f.read(), file


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
