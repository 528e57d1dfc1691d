"""Every query of the catalogue against the SQL that states its result, on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

from palaver.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def compare_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


@pytest.mark.skipif(not Path(FOLDER).exists() or importlib.util.find_spec("duckdb") is None, reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    found = catalogue.queries()[name](spark, FOLDER)
    names = sorted(found.columns)
    assert (names, sorted((tuple(r) for r in found.select(*names).collect()), key=repr)) == compare_rows(catalogue.oracle_sql()[name], FOLDER)


def test_entry_point_imports():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
