"""Queries that SQL can express, against that SQL, on small whole tables."""

import pathlib

import pytest

from gneiss.llm import queries

from .conftest import records

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sql, name):
    import pandas as pd

    used = [t for t in ("documents", "pages", "conversations", "benchmark") if t in queries.ORACLE_SQL[name]]
    tables = {t: pd.read_parquet(f"{SMALL}/{t}.parquet") for t in used}
    assert records(queries.QUERIES[name](spark, SMALL)) == records(sql(queries.ORACLE_SQL[name], **tables))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
