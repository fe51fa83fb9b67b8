"""Every bound query against its SQL statement on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tessella.plans.bindings.catalog import CATALOG  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(data_dir_module):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir_module}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def data_dir_module():
    path = Path("/root/testdata/sf0.001")
    if not path.is_dir():
        pytest.skip("benchmark tables are not available")
    return str(path)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


def test_every_query_has_a_statement():
    assert all(bound.sql for bound in CATALOG.values())
    assert CATALOG.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, data_dir_module, name):
    frame = entry.queries()[name](spark, data_dir_module)
    got = frame.toArrow().to_pydict()
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    left, right = canonical(frame.columns, list(zip(*got.values()))), canonical(names, cursor.fetchall())
    assert len(left) == len(right)
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule", "key", "detail"]
