"""The training-data queries with SQL against DuckDB, on the two smaller tables."""

import duckdb
import pytest

from gleanery.llm import catalog
from tests.test_oracle import TABLES, plain

SIZES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    try:
        for t in TABLES:
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    except duckdb.IOException:
        pytest.skip("no test tables")
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in names)) for r in df.collect())
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted(str(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
