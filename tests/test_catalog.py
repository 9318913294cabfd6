"""Every query of the catalog against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

from cutline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})")
    assert norm(map(tuple, df.select(*columns).collect())) == norm(want.fetchall())
