"""Accesses in ranges that overlap much: no access is joined with the ranges that hold it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import intervals


@pytest.mark.parametrize("parts", [1, 2, 9, 256])
def test_contained_by_a_running_maximum(spark, parts):
    rng = random.Random(parts)
    ranges = [(rng.choice([*"glc", None]), rng.choice([rng.randrange(-300, 900), None]), rng.choice([0, 1, 5, 90, 400, 5000])) for _ in range(120)]
    access = [(i, rng.choice([*"glcx", None]), rng.choice([rng.randrange(-400, 6500), None]), rng.choice([1, 4, 8, 300])) for i in range(900)]
    a, r = spark.createDataFrame(access * 2, "i long, space string, at long, n long").repartition(3), spark.createDataFrame(ranges, "space string, base long, size long")
    want = [i for i, s, x, n in access if s and x is not None and any(s == t and b is not None and b <= x and x + n <= b + z for t, b, z in ranges)]
    for once in (False, True):
        got = intervals._reached(a, r, F.col("at"), F.col("at") + F.col("n"), once, parts)
        assert got.columns == a.columns and sorted(x.i for x in got.collect()) == sorted(want * (1 if once else 2))


def test_wide_ranges_make_no_pairs(spark):
    """Each of 500 accesses lies in each of 500 ranges: a join would make 250,000 rows."""
    ranges = spark.createDataFrame([("g", -i, 1 << 40) for i in range(500)], "space string, base long, size long")
    access = spark.createDataFrame([(i, "g") for i in range(500)], "i long, space string")
    got = intervals.contained(access, ranges, F.col("i"), F.col("i") + 4)
    assert got.count() == 500 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert intervals.contained(access, ranges.limit(0), F.col("i"), F.col("i") + 4).count() == 0
    assert intervals.contained(access.limit(0), ranges, F.col("i"), F.col("i") + 4).count() == 0


def test_the_query_joins_nothing(spark):
    from faultline.queries import QUERIES

    plan = QUERIES["contained_wide"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
