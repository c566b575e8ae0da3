"""Address expressions in batches: nulls, slices of batches, and a plan without interpreted lambdas."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import addresses
from faultline.queries import QUERIES

SCHEMA = "i long, e struct<op:string,sources:array<int>,width:int,offset:long>, v array<long>, w array<int>, live long"


def test_nulls_and_missing_parts(spark):
    rows = [
        (0, ("ADD", [0, 1], 8, None), [255, 2], [8, None], 255), (1, None, [1], [8], 255), (2, ("ADD", None, 8, 0), [1], [8], 255), (3, ("ADD", [0, 1], None, 0), [1, 2], [8, 8], 255), (4, ("ADD", [0, 1], 8, 0), None, [8], 255),
        (5, ("XOR", [0, 1], 8, 0), [1, None], [8, 8], 255), (6, ("XOR", [1, 1], 8, 0), [1, 6], None, 15), (7, ("XOR", [0, 1], 8, 0), [1, 2], [3], None), (8, (None, [0], 8, 0), [1], [8], 255), (9, ("ADDR_SUM", [0, 1, 2, 3, 0], 16, 5), [1, 2, 3, 4], [16] * 4, 1),
        (10, ("NOT", [-1], 8, 0), [1], [8], 255), (11, ("IDENTITY", [None], 8, 0), [1], [8], 255),
    ]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r.i: (r.a, r.m and [tuple(x) for x in r.m]) for r in df.select("i", addresses.address(F.col("e"), F.col("v")).alias("a"), addresses.influence(F.col("e"), F.col("v"), F.col("w"), F.col("live")).alias("m")).collect()}
    want = {i: (None, None) for i in range(12)}
    want |= {0: (1, [(0, 255), (1, 255)]), 6: (0, [(1, 15), (1, 15)]), 7: (3, [(0, None), (1, None)]), 9: (16, [(0, 1), (1, 1), (2, 1), (3, 1), (0, 1)])}
    assert got == want


def test_influence_of_many_rows_interprets_no_lambdas(spark):
    plan = QUERIES["address_influence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan.lower()
