"""Every reference query against its SQL on the smallest tables."""

import duckdb
import pytest

from cairnframe.plans import id_queries, queries  # noqa: F401  (the first registers its queries with the second)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    r = duck.execute(queries.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(repr(tuple(row[cols.index(c)] for c in sorted(cols))) for row in r.fetchall())
