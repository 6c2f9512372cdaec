"""Every registered query of the library's own operators against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from claimscan.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    rel = con.execute(queries.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert {"status", "overall_risk"} <= set(df.columns)


def test_every_query_has_sql_or_a_test():
    assert set(queries.QUERIES) - set(queries.SQL) == {"d1_encode_documents"}  # see test_operators
