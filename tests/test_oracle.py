"""Every registered query against its SQL twin, on whole small tables."""

import math

import duckdb
import pytest

from quire.plans.oracle import ORACLE
from quire.plans.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def plain(rows):
    def value(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(map(value, row)) for row in rows), key=repr)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"uploads_scanned", "similar_documents_approximate"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    columns = sorted(ours.columns)
    twin = duck.execute(ORACLE[name])
    kinds = {column[0]: str(column[1]) for column in twin.description}
    assert {c: KINDS[k] for c, k in ours.dtypes} == kinds
    order = [list(kinds).index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in twin.fetchall()]
    assert plain(tuple(row) for row in ours.select(columns).collect()) == plain(expected)
