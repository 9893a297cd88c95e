"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenfold.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def key(row):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 4)
        return round(float(x), 4) if type(x).__name__ == "Decimal" else x

    return str(tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in map(plain, row)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    columns = ", ".join(f'"{n}"' for n in names)
    cursor = db.execute(f"SELECT {columns} FROM ({ORACLES[name]})")
    assert sorted(key(r) for r in df.select(*names).collect()) == sorted(map(key, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_grid_layout_blocks_is_whole(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    got = QUERIES["grid_layout_blocks"](spark, data)
    n = spark.read.parquet(f"{data}/part.parquet").count()
    assert n > 256 and got.count() == n == got.select("block", "col", "row").distinct().count()
