"""Every query with SQL gives DuckDB's rows on sf0.01; the others give rows."""

import duckdb
import pytest

from sortilege.plans import catalog

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    mine = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
    if name not in catalog.ORACLE_SQL:
        assert mine
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=repr)
