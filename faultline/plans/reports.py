"""Reports over campaign results: rates, errors, speedups, shares and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import OUTCOMES


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def outcome_rates(df: DataFrame, keys: list[str], outcome: str, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """Per key: total and the rate of each outcome."""
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(total.alias("total"), *[ratio(F.count_if(F.col(outcome) == o), total).alias(f"{o}_rate") for o in outcomes])


def rate_error(a: str, b: str, outcomes: tuple[str, ...] = OUTCOMES) -> Column:
    """Mean absolute difference of the rates; null if a side is."""
    return sum((F.abs(F.col(f"{a}.{o}_rate") - F.col(f"{b}.{o}_rate")) for o in outcomes), F.lit(0.0)) / len(outcomes)


def errors(method: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Errors where both sides have the key: one row per key of the method."""
    m, t = method.alias("m"), truth.alias("t")
    cond = [F.col(f"m.{k}") == F.col(f"t.{k}") for k in keys]
    per = [F.abs(F.col(f"m.{o}_rate") - F.col(f"t.{o}_rate")).alias(f"{o}_diff") for o in OUTCOMES]
    return m.join(t, cond).select("m.*", rate_error("m", "t").alias("error"), *per)


def overall(errs: DataFrame, keys: list[str]) -> DataFrame:
    return errs.groupBy(*keys).agg(F.avg("error").alias("error"), F.count("error").alias("n"))


def by_category(errs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean difference of each outcome, in rows."""
    long = errs.select(*keys, F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"{o}_diff").alias("diff")) for o in OUTCOMES])).alias("x"))
    return long.groupBy(*keys, "x.outcome").agg(F.avg("x.diff").alias("diff"))


def combined(means: DataFrame, arch: str, keys: list[str], value: str) -> DataFrame:
    """A row ``Combined`` that is the mean of the means, not pooled."""
    rows = means.select(arch, *keys, value)
    return rows.unionByName(rows.groupBy(*keys).agg(F.avg(value).alias(value)).withColumn(arch, F.lit("Combined")))


def speedups(df: DataFrame, arch: str, truth_time: str, time: str, keys: list[str] = ()) -> DataFrame:
    """Ratio of sums per architecture, and in ``Combined`` over all; an architecture that is null stays null."""
    sets = [[*(F.col(k) for k in keys), F.col(arch)], [F.col(k) for k in keys]]
    parts = df.groupingSets(sets, *keys, arch).agg(F.sum(truth_time).alias("truth_time"), F.sum(time).alias("time"), F.grouping(arch).alias("_all"))
    name = F.when(F.col("_all") == 1, F.lit("Combined")).otherwise(F.col(arch))
    return parts.withColumn(arch, name).drop("_all").withColumn("speedup", ratio(F.col("truth_time"), F.col("time")))


def component_breakdown(errs: DataFrame, arch: str, component: str, method: str) -> DataFrame:
    """Mean error and rates by architecture and component, one column set per method."""
    return errs.groupBy(arch, component).pivot(method).agg(F.avg("error").alias("error"), F.avg("sdc_rate").alias("sdc_rate"))


def with_average(df: DataFrame, app: str, values: list[str]) -> DataFrame:
    """Means per app and a row ``Avg`` over the apps."""
    means = df.groupBy(app).agg(*[F.avg(v).alias(v) for v in values])
    return means.unionByName(means.agg(*[F.avg(v).alias(v) for v in values]).withColumn(app, F.lit("Avg")).select(means.columns))


def unknown_share(df: DataFrame, keys: list[str], known: list[str]) -> DataFrame:
    left = F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.coalesce(F.col(k), F.lit(0.0)) for k in known), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.avg(left).alias("unknown_share"))


def waterfall(df: DataFrame, keys: list[str], order: str, amount: str, total: str) -> DataFrame:
    """What each source adds in order until the total is used up, and its share of the total."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.coalesce(F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    used = F.greatest(F.lit(0.0), F.least(upto, F.col(total)) - F.least(before, F.col(total)))
    return df.withColumn("used", used).withColumn("share", ratio(F.col("used"), F.col(total)))


def repaired(masked: Column, sdc: Column, due: Column, unknown: Column, den: Column) -> list[Column]:
    """Counts that add up to ``den``: what is missing goes to unknown, what is too much leaves unknown, then masked."""
    gap = den - (masked + sdc + due + unknown)
    new_unknown = F.greatest(F.lit(0), unknown + gap)
    over = F.greatest(F.lit(0), -(unknown + gap))
    return [F.greatest(F.lit(0), masked - over).alias("masked"), sdc.alias("sdc"), due.alias("due"), new_unknown.alias("unknown")]


def clamped(benign: Column, ebc: Column, dcr: Column, den: Column) -> list[Column]:
    """Counts cut to ``den``: benign first, then ebc, then dcr."""
    b = F.least(benign, den)
    e = F.least(ebc, den - b)
    return [b.alias("benign"), e.alias("ebc"), F.least(dcr, den - b - e).alias("dcr")]


def unpivoted(wide: DataFrame, keys: list[str], components: list[str], metrics: list[str]) -> DataFrame:
    """``<component>_<metric>`` columns in rows; a denominator of 0 or less means unused: null."""
    rows = [F.struct(F.lit(c).alias("component"), *[F.when(F.col(f"{c}_den") > 0, F.col(f"{c}_{m}")).alias(m) for m in metrics]) for c in components]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def complete(df: DataFrame, expected: int) -> DataFrame:
    """The same rows, or an error if they are not ``expected`` many."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} rows, expected {expected}")
    return df


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a required column missing, and which."""
    lacking = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return df.withColumn("lacking", lacking).where(F.size("lacking") > 0)


def names(tables: list[DataFrame], name: str) -> DataFrame:
    """The distinct names that occur in any of the tables."""
    out = tables[0].select(name)
    for t in tables[1:]:
        out = out.unionByName(t.select(name))
    return out.distinct()
