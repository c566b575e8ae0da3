"""Evenly spaced cycles over the domains of a table."""

from __future__ import annotations

from faultline.operators import sampling
from faultline.queries import QUERIES

from .test_queries import SF


def test_evenly_spaced_over_domains(spark):
    domains = [("a", 30, 1000), ("b", 1, 50), ("c", 0, 50), ("d", 10, 3), ("e", 4, 0), ("f", None, 9), ("g", 3, (1 << 60) + 1)]
    df = spark.createDataFrame(domains, "k string, n long, most long")
    want = sorted((k, n, m, i, i * m // max(n - 1, 1)) for k, n, m in domains for i in range(n or 0))
    for block in (1, 7, 4096):
        assert sorted(map(tuple, sampling.evenly_spaced(df, "n", "most", block).collect())) == want


def test_the_query_reads_events(spark):
    df = QUERIES["evenly_spaced"](spark, SF)
    assert [f.rsplit("/", 1)[-1] for f in df.inputFiles()] == ["events.parquet"]
    assert df.count() == spark.read.parquet(f"{SF}/events.parquet").count()
