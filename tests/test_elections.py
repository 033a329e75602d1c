"""Registered queries against their SQL, hand-made elections, and properties that hold for any ballots."""

import __spark_entry__ as entry
import duckdb
import pytest
from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages", "labels", "benchmark", "embeddings"]


@pytest.fixture(scope="module")
def con():
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def plain(x):
    return round(x, 9) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert got.count() >= 0
        return
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((repr(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns))) for r in found.fetchall()))
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in got.collect()) == want


def test_entry_runs_and_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
