"""Queries that SQL can state equal it over whole tables; every query is registered."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from caseweave.llm.queries import ORACLE, QUERIES


def rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if pd.isna(v) else (round(float(v), 6) if isinstance(v, float) else v)
    return cols, sorted((tuple(str(clean(v)) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, folder, db, name):
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(db.execute(ORACLE[name]).df())


def test_all_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())
