"""Sinks: committed CSV, JSON and Parquet, and small rendered reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """All or nothing, by Spark's commit protocol."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line with keys in order, nulls left out."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")).write.mode("overwrite").text(path)


def write_sparse(df: DataFrame, path: str) -> list[str]:
    """Parquet without the columns that are null throughout; returns the columns kept."""
    seen = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if seen[c]]
    df.select(*kept).write.mode("overwrite").parquet(path)
    return kept


#: Rows of a rendered table that the driver takes at most, if no limit is given.
MOST = 100_000


def _cells(df: DataFrame, limit: int | None) -> tuple[list[list[str]], str]:
    """(texts of the rows, a note on the rows that are left out, empty where none is); without a limit, more than ``MOST`` rows are refused."""
    rows = df.limit((MOST if limit is None else limit) + 1).collect()
    if limit is None and len(rows) > MOST:
        raise ValueError(f"a table of over {MOST} rows is not rendered; give a limit or write it as CSV or Parquet")
    over = 0 if limit is None or len(rows) <= limit else df.count() - limit
    return [["-" if v is None else str(v) for v in r] for r in (rows[:limit] if over else rows)], f"... {over} more rows\n" if over else ""


def markdown(df: DataFrame, limit: int | None = None) -> str:
    """A table of a small result: all rows, or the first ``limit`` and a note on how many more there are."""
    rows, note = _cells(df, limit)
    out = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(out + ["| " + " | ".join(r) + " |" for r in rows]) + "\n" + note


def aligned(df: DataFrame, limit: int | None = None) -> str:
    """A text table with columns as wide as their widest cell; ``limit`` as in ``markdown``."""
    rows, note = _cells(df, limit)
    cells = [df.columns, *rows]
    wide = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells) + "\n" + note


def manifest(tables: dict[str, str], warnings: DataFrame, limit: int = 30) -> str:
    """A JSON manifest of written tables and the first warnings."""
    found = [r["warning"] for r in warnings.orderBy("warning").limit(limit).collect()]
    return json.dumps({"tables": tables, "warnings": found}, sort_keys=True, indent=1)
