"""Every registered query of the library against its SQL."""

import os

import duckdb
import pytest

from postmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages events orders lineitem conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    found = con.sql(catalogue.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert ours == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())
