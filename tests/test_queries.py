"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from faultline import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (list, np.ndarray)):
            return [str(x) for x in v]
        return float(v) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else v

    columns = sorted(df.columns)
    out = df[columns].copy()
    for c in columns:
        out[c] = out[c].map(one).astype(str)
    return out.sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = engine.QUERIES[name](spark, SF).toPandas(), duck.execute(engine.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0


def test_live_bits_of_every_thread(spark):
    """Threads of any number have compared outputs."""
    from pyspark.sql import functions as F

    from faultline.queries import traces

    def observed(shift):
        read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").withColumn("user_id", F.col("user_id") + shift)
        rows = traces._live(read).select((F.col("thread") - shift).alias("thread"), "index", "site", "observed", "due", "trace")
        return sorted(map(tuple, rows.collect()))

    want = observed(0)
    assert any(r[3] for r in want) and observed(5000) == want


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
