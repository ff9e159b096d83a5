"""Every registered query of the point and mesh operators against DuckDB on the same tables."""

import math
import os

import pytest

from cloudframe.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(rows, order):
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, database, name):
    found = catalog.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in found.collect()]
    if name not in catalog.oracle_sql():
        assert rows, "a query without SQL has rows at least"
        return
    cursor = database.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    assert sorted(found.columns) == sorted(names)
    columns = sorted(names)
    a = plain(rows, [found.columns.index(c) for c in columns])
    b = plain(wanted, [names.index(c) for c in columns])
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not wrong, wrong[:3]
