"""Every registered query with SQL equals that SQL on the smallest tables; the others run."""

import decimal
import math
import os

import duckdb
import pytest

from loomspan.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_other_query_has_a_test_of_values():
    """Queries without SQL are held against plain Python by name."""
    here = os.path.dirname(__file__)
    texts = "".join(open(f"{here}/{f}", encoding="utf-8").read() for f in ("test_values.py", "test_whole.py"))
    assert [n for n in sorted(set(QUERIES) - set(ORACLE)) if f'QUERIES["{n}"]' not in texts] == []
