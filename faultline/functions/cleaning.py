"""Cleaning of text and loosely typed values, as Catalyst expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcomes, fault classes, and components with their codes.
OUTCOMES = ("masked", "sdc", "due")
CLASSES = ("benign", "dcr", "ebc")
COMPONENTS = {"rf": 0, "smem_rf": 2, "l1d": 3, "l2": 6}
RUNS = (1000, 5000, 10000)


def outcome_label(text: Column) -> Column:
    """The first of SDC, DUE, Masked that the text has, in any case; else Others."""
    t = F.lower(text)
    return F.when(t.contains("sdc"), "SDC").when(t.contains("due"), "DUE").when(t.contains("masked"), "Masked").otherwise("Others")


def tolerant_int(text: Column) -> Column:
    """Decimal, 0x hexadecimal or a float cut off; blank or else null."""
    t = F.trim(text)
    hexed = F.conv(F.substring(t, 3, 64), 16, 10).try_cast("decimal(20,0)")
    wrapped = F.when(hexed >= F.lit(Decimal(1 << 63)), hexed - F.lit(Decimal(1 << 64))).otherwise(hexed)
    return F.when(t.rlike("^0[xX][0-9a-fA-F]{1,16}$"), wrapped.try_cast("long")).otherwise(F.coalesce(t.try_cast("long"), t.try_cast("double").try_cast("long")))


def tolerant_float(text: Column, fallback: float | None = None) -> Column:
    """A number; true and false are 1 and 0; else the fallback."""
    t = F.lower(F.trim(text))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(F.coalesce(t.try_cast("double"), F.lit(fallback)))


def space_by_substring(text: Column) -> Column:
    """Memory space by what the name contains."""
    t = F.lower(text)
    return F.when(t.contains("shared"), "shared").when(t.contains("local"), "local").when(t.contains("global"), "global").when(t.contains("const"), "const").otherwise("other")


def space_by_alias(text: Column) -> Column:
    """Memory space by exact names and short forms; null if unknown."""
    alias = {"global": "global", "g": "global", "shared": "shared", "s": "shared", "local": "local", "l": "local", "const": "const", "constant": "const", "c": "const", "param": "param"}
    out = F.lit(None).cast("string")
    t = F.lower(F.trim(text))
    for name, space in alias.items():
        out = F.when(t == name, space).otherwise(out)
    return out


def predicate_true(value: Column) -> Column:
    """A missing predicate holds."""
    return F.coalesce(value, F.lit(1)) != 0


def access_size(width_bits: Column, *sizes: Column) -> Column:
    """The first positive size, else the width in whole bytes, at least 1."""
    firsts = [F.when(s > 0, s) for s in sizes]
    return F.coalesce(*firsts, F.greatest(F.lit(1), F.ceil(width_bits / 8))).cast("long")


#: What a log of a run that crashed says, and the exit statuses of a time limit.
CRASHED = "assert|fatal|segmentation fault|core dumped|cuda error|aborted"
TIMED_OUT = (124, 137)


def due_reason(text: Column, exit_status: Column, program: str = "simulator") -> Column:
    """Timeout, missing output (no or an empty log), error text, abnormal exit, other: the first that holds.

    An ``error`` in the log counts only on a line that names the ``program`` (a pattern) before it.
    """
    crashed = text.rlike(f"(?i){CRASHED}|{program}.*error")
    return (
        F.when(exit_status.isin(*TIMED_OUT), "timeout").when(F.coalesce(F.length(text), F.lit(0)) == 0, "missing_output").when(crashed, "simulator_error").when(exit_status != 0, "abnormal_exit").otherwise("other")
    )


def id_list(text: Column) -> Column:
    """Integers parted by commas, colons or spaces; distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, r"[,:\s]+"), lambda x: x != ""), lambda x: x.cast("long"))))


def first_text(*columns: Column) -> Column:
    """The first that is not null and not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def allowed_runs(value: int) -> int:
    if value not in RUNS:
        raise ValueError(f"runs is one of {RUNS}")
    return value


def one_or_mixed(values: Column) -> Column:
    """The label of a set of values: the only one, ``mixed``, or ``unknown`` if there is none."""
    known = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, F.element_at(known, 1).cast("string")).otherwise("mixed")


def fixed(value: Column, digits: int) -> Column:
    """With thousands commas; a dash if null."""
    return F.coalesce(F.format_number(value, digits), F.lit("-"))


def times(value: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(value, 2), F.lit("×")), F.lit("-"))


def new_name(name: Column, renames: dict[str, str]) -> Column:
    """Name migration: replacements in order."""
    for old, new in renames.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def same_number(a: Column, b: Column) -> Column:
    """Exact equality in which NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)
