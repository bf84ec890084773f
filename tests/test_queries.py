"""Every registered query against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def text(value) -> str:
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text, value)) + "]"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(text(r[i]) for i in order) for r in data)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    found = duck.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got == want


def test_outcomes_of_more_than_a_thousand_rolls(spark, tmp_path):
    """Rolls that have the number of another's double, which has other pixels and may have another calibration."""
    con = duckdb.connect()
    made = " UNION ALL ".join(f"SELECT * REPLACE (l_orderkey + {roll} * 5000 AS l_orderkey) FROM '{SF}/lineitem.parquet'" for roll in (0, 1, 2, 1000, 1001, 2002))
    con.execute(f"COPY ({made}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = entry.queries()["plan_outcomes"](spark, str(tmp_path))
    found = con.execute(entry.oracle_sql()["plan_outcomes"])
    want = rows([c[0] for c in found.description], found.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
