"""Every registered query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(got.columns), got.fetchall())


@pytest.mark.parametrize("name", ["forest_eval", "logreg_eval"])
def test_models_beat_nothing_found(spark, name):
    r = catalog.QUERIES[name](spark, SF).first()
    assert r["tp"] > 0 and 0 <= r["f1"] <= 1
