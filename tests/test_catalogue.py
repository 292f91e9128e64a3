"""Every query of the catalogue against its SQL twin, over whole tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from lakestrata.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(map(str, ([r[c] for c in sorted(df.columns)] for r in df.collect())))
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    r = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(map(str, ([x[names.index(c)] for c in sorted(names)] for x in r.fetchall())))


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
