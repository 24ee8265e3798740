import os

import duckdb
import pytest

from sparkloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA)
    rows = got.collect()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for file in os.listdir(DATA):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
        cursor = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(tuple(r[n] for n in sorted(names)) for r in rows) == sorted(tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall())
    else:
        assert got.columns


def test_every_problem_is_there():
    known = queries.queries()
    assert {"p2_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_containers", "p9_found"} <= set(known)
