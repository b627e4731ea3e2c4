import duckdb
import pytest

from evidentia.plans import registry
from evidentia.plans.book import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        v = round(v, 5) + 0.0
        return str(int(v)) if v.is_integer() else repr(v)
    if hasattr(v, "as_tuple"):
        return norm(float(v))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_duckdb(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    mine = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    q = con.execute(registry.ORACLES[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in q.fetchall())
    assert mine == theirs
