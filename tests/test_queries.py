"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pytest

from barspan.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return db


def plain(v):
    if str(v) in ("None", "<NA>", "nan", "NaT"):
        return "None"
    if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        assert rows(got) == rows(want)
    else:
        assert len(got)
