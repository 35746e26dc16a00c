"""Every registered query with a statement against DuckDB on the same tables."""

import duckdb
import pytest

from ledgerloom.oracle import oracle_sql
from ledgerloom.queries import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
