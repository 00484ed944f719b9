"""Every query of the engine with SQL against DuckDB, on the two smaller tables; those of gleanery/llm are in tests/llm."""

import math
import os

import duckdb
import pytest

from gleanery import catalog

SF = "/root/testdata/sf0.001"
SIZES = [SF, "/root/testdata/sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module", params=SIZES)
def tables(request):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{request.param}/{t}.parquet'")
    return request.param, duck


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    sf, duck = tables
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in names)) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(str(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
    assert got == want
