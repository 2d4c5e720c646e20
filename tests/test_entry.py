"""Every query of the catalog against its SQL at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(table):
    def norm(v):
        return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v

    names = sorted(table.column_names)
    return names, sorted((tuple(norm(x) for x in r) for r in zip(*(table[c].to_pylist() for c in names))), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toArrow()
    if sql := catalog.oracle_sql().get(name):
        done = duck.execute(sql)
        want = done.to_arrow_table() if hasattr(done, "to_arrow_table") else done.fetch_arrow_table()
        assert rows(got) == rows(want)
        assert {c: str(got.schema.field(c).type).replace("large_", "") for c in got.column_names} == {c: str(want.schema.field(c).type).replace("large_", "") for c in got.column_names}
    else:
        assert got.num_rows


def test_contract(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
