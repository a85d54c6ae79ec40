"""Every query of the document engine against its SQL in DuckDB, on the two smallest scales."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessella import catalog

DATA = "/root/testdata/sf0.001"
SCALES = [DATA, "/root/testdata/sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=SCALES)
def scale(request):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{request.param}/{t}.parquet'")
    return request.param, con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equal(name, spark, scale):
    data, duck = scale
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 5 * spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
