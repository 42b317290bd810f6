"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tallyspark.plans.catalogue import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return tuple(x) if isinstance(x, list) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows(df.columns, df.collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, result.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert got or name in ("score_missing_mappings", "src_parse_uri", "job_by_package")
