"""Every query with a SQL twin, compared row by row on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


# Dense places of a dozen rows are no clusters of ten: this one needs the next larger tables.
LARGER = {"cluster_recovery": "/root/testdata/sf0.01"}


def views(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {folder: views(folder) for folder in {sf_dir, *LARGER.values()}}


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, tables, name):
    folder = LARGER.get(name, sf_dir)
    df = QUERIES[name](spark, folder)
    result = tables[folder].execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(
        columns, result.fetchall()
    )


def test_entry(spark):
    assert entry.entry(spark).count() > 0
