"""Every query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from palimpsest.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def normal(rows, columns):
    return sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, con, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    expected = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(expected.fetchall(), expected.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
