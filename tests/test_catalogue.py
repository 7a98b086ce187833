"""Every catalogued query against its SQL twin."""

import duckdb
import pytest

from loomgraph.plans import catalogue, extractors

ORACLE, QUERIES = catalogue.ORACLE | extractors.ORACLE, catalogue.QUERIES | extractors.QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    cur = duck.execute(ORACLE[name])
    theirs_columns = [c[0] for c in cur.description]
    assert sorted(theirs_columns) == columns
    at = [theirs_columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
    assert ours == theirs
