"""Naming the value of an expression, so that an expression that uses it often stays small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once; several values go as a struct."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
