"""Every query with SQL against DuckDB on the small tables."""

import math

import duckdb
import pytest

import weftspark.plans.domain_queries  # noqa: F401  registers its queries
import weftspark.plans.field_queries  # noqa: F401
import weftspark.plans.run_queries  # noqa: F401
import weftspark.plans.sheet_queries  # noqa: F401
from weftspark.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    want = sql.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())
