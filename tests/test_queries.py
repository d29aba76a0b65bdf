"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from quayside.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    if name in catalogue.ORACLE_SQL:
        r = db.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        order = [names.index(c) for c in sorted(got.columns)]
        assert sorted(names) == sorted(got.columns)
        assert rows == sorted(repr([plain(x[i]) for i in order]) for x in r.fetchall())
