"""Outcomes of runs against a golden run: ordered decisions after the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUTS = (124, 137)


def classify(df: DataFrame, timeouts: tuple[int, ...] = TIMEOUTS) -> DataFrame:
    """Adds outcome and reason; the first rule that holds decides.

    Columns: golden_ok, log_ok, exit_status, missing_outputs (count), success, failed,
    outputs_equal. Missing flags count as false, a missing exit status as 0.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.coalesce(F.col("exit_status"), F.lit(0))
    rules = [
        (~flag("golden_ok"), "due", "invalid_path"),
        (status.isin(*timeouts), "due", "timeout_exit_status"),
        (~flag("log_ok"), "due", "missing_log"),
        (status != 0, "due", "abnormal_exit_status"),
        (F.coalesce(F.col("missing_outputs"), F.lit(0)) > 0, "due", "missing_expected_output"),
        (flag("success") & ~flag("failed"), "masked", "success"),
        (flag("failed") & ~flag("success"), "sdc", "failed"),
        (~flag("success") & ~flag("failed"), "due", "no_sentinel"),
        (flag("outputs_equal"), "masked", "outputs_equal"),
    ]
    outcome, reason = F.lit("sdc"), F.lit("outputs_differ")
    for test, o, r in reversed(rules):
        outcome, reason = F.when(test, o).otherwise(outcome), F.when(test, r).otherwise(reason)
    return df.withColumns({"outcome": outcome, "reason": reason})


def legacy_code(success: Column, cycles_same: Column, failed: Column) -> Column:
    """The older code of three tests: masked, performance, sdc, due."""
    return F.when(success & cycles_same, "masked").when(success, "performance").when(failed, "sdc").otherwise("due")


def compare_observations(df: DataFrame) -> Column:
    """Signatures, then values, then entry sets, whichever both sides have first; else due.

    Columns: ok, golden_signature, run_signature, golden_values, run_values (arrays of double),
    golden_entries, run_entries (arrays of string). NaN equals nothing.
    """
    nan = lambda c: F.exists(c, lambda v: F.isnan(v))
    both = lambda k: F.col(f"golden_{k}").isNotNull() & F.col(f"run_{k}").isNotNull()
    verdict = lambda same: F.when(same, "masked").otherwise("sdc")
    values = (F.col("golden_values") == F.col("run_values")) & ~nan("golden_values") & ~nan("run_values")
    entries = F.array_sort(F.array_distinct("golden_entries")) == F.array_sort(F.array_distinct("run_entries"))
    return (
        F.when(~F.coalesce(F.col("ok"), F.lit(False)), "due")
        .when(both("signature"), verdict(F.col("golden_signature") == F.col("run_signature")))
        .when(both("values"), verdict(values))
        .when(both("entries"), verdict(entries))
        .otherwise("due")
    )


#: Types of errors with a reason of their own.
ERROR_REASONS = {"outofrangememoryaccess": "out_of_range_memory_access", "maxstepsexceeded": "max_steps_exceeded", "uninitializedload": "uninitialized_load", "missingbytes": "missing_bytes"}


def semantic_outcome(df: DataFrame) -> DataFrame:
    """``df`` with outcome and reason of runs that end with a typed error, without an output, or with outputs to compare.

    Columns: run_failed, run_missing_output, run_error_type, reference (whether there is something to compare
    with; null: whether there is a golden signature or golden values), and those of ``compare_observations`` but ok.
    A failed run is due for its error's reason, else as invalid_path if there is no reference, else as run_failed;
    a run without an expected output is due; all others are compared.
    """
    error = F.lower(F.trim(F.coalesce("run_error_type", F.lit(""))))
    reference = F.coalesce("reference", F.col("golden_signature").isNotNull() | (F.coalesce(F.size("golden_values"), F.lit(0)) > 0))
    typed = F.coalesce(*[F.when(error == k, r) for k, r in ERROR_REASONS.items()], F.when(reference, "run_failed").otherwise("invalid_path"))
    failed, missing = F.coalesce("run_failed", F.lit(False)), F.coalesce("run_missing_output", F.lit(False))
    both = lambda k: F.col(f"golden_{k}").isNotNull() & F.col(f"run_{k}").isNotNull()
    compared = compare_observations(df.withColumn("ok", F.lit(True)))
    seen = F.when(both("signature") | both("values") | both("entries"), F.when(F.col("_compared") == "masked", "outputs_equal").otherwise("outputs_differ")).otherwise("nothing_to_compare")
    rows = df.withColumn("ok", F.lit(True)).withColumn("_compared", compared)
    rows = rows.withColumn("outcome", F.when(failed | missing, "due").otherwise(F.col("_compared")))
    return rows.withColumn("reason", F.when(failed, typed).when(missing, "missing_expected_output").otherwise(seen)).drop("_compared", "ok")


def missing_outputs(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Expected (run, base, bytes, name) that a run did not write; without a name, base and bytes decide."""
    a, b = expected.alias("a"), seen.alias("b")
    same = (F.col("a.run") == F.col("b.run")) & (F.col("a.base") == F.col("b.base")) & (F.col("a.bytes") == F.col("b.bytes"))
    return a.join(b, same & (F.col("a.name").isNull() | (F.col("a.name") == F.col("b.name"))), "left_anti")
