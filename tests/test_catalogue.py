"""Every query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from foliospark.plans import catalogue, layout_queries, library_queries, service_queries  # noqa: F401  (the last three add their queries)

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: "null" if pd.isna(v) else str(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        assert rows(got) == rows(db.execute(catalogue.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
