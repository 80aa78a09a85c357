import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from blockframe.plans.catalog import CASES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no example tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def key(row):
    return tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(key(r) for r in got.select(*columns).collect())
    b = sorted(key(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert a == b


def test_entry_and_registers(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer", "block", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clusters(spark):
    rows = entry.queries()["fn_round_cluster"](spark, DATA).groupBy("value").count().collect()
    values = {r.value for r in rows}
    assert -1 in values and 2 <= len(values) <= 4 and all(isinstance(v, int) and not math.isnan(v) for v in values)
