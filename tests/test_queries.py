"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return None
        if isinstance(x, float):
            return int(x) if x.is_integer() else round(x, 9)
        return x if isinstance(x, str | bool) else int(x)

    return sorted([tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)], key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    wanted = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_takes_the_name_of_another():
    assert len(catalogue.QUERIES) == sum(len(m.QUERIES) for m in catalogue._MODULES)
