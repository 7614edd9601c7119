"""Every registered query of the engine against its SQL on the same tables."""

import duckdb
import pytest

from tidelog import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), [columns[i] for i in order]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, "/root/testdata/sf0.01")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = duck.execute(core.oracle_sql()[name])
    want = rows_of([c[0] for c in done.description], done.fetchall())
    assert got == want
    if name not in ("scan_inverted",):
        assert got[0]


def test_entry(spark):
    assert core.entry(spark, "/root/testdata/sf0.001").count() > 0
