"""Histograms, counter cubes, cache, memory and network statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import point_in_interval


def pow2_bin(v: Column) -> Column:
    """0 for 0, else one more than the floor of log2."""
    return F.when(v <= 0, F.lit(0)).otherwise(F.length(F.bin(v.cast("long")))).cast("long")


def linear_bin(v: Column, stride: int, bins: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(v / stride), F.lit(bins - 1).cast("long")))


def log_sqrt2_bin(v: Column) -> Column:
    """Twice the floor of log2, plus the bit below the highest."""
    n = F.length(F.bin(v.cast("long"))) - 1
    below = F.when(n > 0, F.call_function("shiftright", v.cast("long"), F.greatest(n - 1, F.lit(0))).bitwiseAND(F.lit(1))).otherwise(0)
    return F.when(v <= 0, F.lit(0)).otherwise(2 * n + below).cast("long")


def histogram(df: DataFrame, keys: list[str], bin_: Column) -> DataFrame:
    return df.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, keys: list[str], value: str, bin_: Column) -> DataFrame:
    """Distinct bins, greatest value and mean to two places."""
    return df.withColumn("_bin", bin_).groupBy(*keys).agg(F.count_distinct("_bin").alias("bins"), F.max(value).alias("most"), F.round(F.avg(value), 2).alias("mean"))


def accumulated(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Values clamped at both ends; least and greatest without NaN; population variance."""
    v = F.when(F.isnan(value), None).otherwise(F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)))
    return df.withColumn("_v", v).groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("variance"))


#: Bins of a stored histogram: ``pow2_bin`` of a long is at most 63.
BINS = 64


def accumulators(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key one ``state`` of whole numbers that can be stored and merged later: n, sum, squares, least, most, bins.

    Sums are decimals, so they are exact in any order. With v = h 2^32 + l, squares has the sums of l l, h l and h h,
    none of which overflows below 10^18 rows. bins counts by ``pow2_bin``. Nulls are not counted.
    """
    v = F.col(value).cast("long")
    high, low = F.shiftright(v, 32).cast("decimal(10,0)"), v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)")
    bins = F.array(*[F.count_if(pow2_bin(v) == i) for i in range(BINS)])
    squares = F.array(*[F.sum(x * y).cast("decimal(38,0)") for x, y in ((low, low), (high, low), (high, high))])
    sums = [F.count(F.lit(1)).alias("n"), F.sum(v.cast("decimal(19,0)")).cast("decimal(38,0)").alias("sum"), squares.alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"), bins.alias("bins")]
    return df.where(v.isNotNull()).groupBy(*keys).agg(*sums).select(*keys, F.struct("n", "sum", "squares", "least", "most", "bins").alias("state"))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of the same key as one, whatever runs they come from and however they were merged before."""
    s = lambda n: F.col(f"state.{n}")
    added = lambda n, size, kind: F.array(*[F.sum(F.get(s(n), F.lit(i))).cast(kind) for i in range(size)])
    sums = [F.sum(s("n")).alias("n"), F.sum(s("sum")).cast("decimal(38,0)").alias("sum"), added("squares", 3, "decimal(38,0)").alias("squares"), F.min(s("least")).alias("least"), F.max(s("most")).alias("most"), added("bins", BINS, "long").alias("bins")]
    return states.groupBy(*keys).agg(*sums).select(*keys, F.struct("n", "sum", "squares", "least", "most", "bins").alias("state"))


def read_out(states: DataFrame, keys: list[str]) -> DataFrame:
    """n, total, least, most, mean, population variance and the bins that are not empty."""
    n, total = F.col("state.n").cast("double"), F.col("state.sum").cast("double")
    low, mixed, high = (F.get("state.squares", F.lit(i)).cast("double") for i in range(3))
    mean = total / n
    squares = low + mixed * float(1 << 33) + high * float(1 << 64)
    filled = F.filter(F.transform("state.bins", lambda c, i: F.struct(i.alias("bin"), c.alias("count"))), lambda b: b["count"] > 0)
    return states.select(*keys, "state.n", F.col("state.sum").cast("long").alias("total"), "state.least", "state.most", mean.alias("mean"), F.greatest(squares / n - mean * mean, F.lit(0.0)).alias("variance"), filled.alias("bins"))


def interval_means(df: DataFrame, keys: list[str], time: str, value: str, width: int, bin_) -> DataFrame:
    """Means of each interval, then a histogram of the means."""
    means = df.withColumn("_t", F.floor(F.col(time) / width)).groupBy(*keys, "_t").agg(F.avg(value).alias("_mean"))
    return means.withColumn("bin", bin_(F.col("_mean"))).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


# caches

#: Outcomes of an access.
OUTCOMES = ("HIT", "HIT_RESERVED", "MISS", "RESERVATION_FAIL", "SECTOR_MISS")


def counter_cube(df: DataFrame, kind: str, outcome: str, n: str | None = None) -> DataFrame:
    """Counts by kind and outcome with all subtotals; a subtotal has null in the key."""
    return df.cube(kind, outcome).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"), F.grouping_id().cast("long").alias("level"))


def cache_totals(df: DataFrame, keys: list[str], outcome: str, n: str | None = None) -> DataFrame:
    """accesses (without reservation fails), misses, pending hits, reservation fails, miss rate."""
    count = F.col(n) if n else F.lit(1)
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col(outcome).isin(*kinds), count)), F.lit(0)).cast("long")
    out = df.groupBy(*keys).agg(of("HIT", "HIT_RESERVED", "MISS", "SECTOR_MISS").alias("accesses"), of("MISS", "SECTOR_MISS").alias("misses"), of("HIT_RESERVED").alias("pending_hits"), of("RESERVATION_FAIL").alias("reservation_fails"))
    return out.withColumn("miss_rate", F.coalesce(F.try_divide(F.col("misses").cast("double"), F.col("accesses").cast("double")), F.lit(0.0)))


def windowed_miss_rate(df: DataFrame, keys: list[str], window: Column, outcome: str, sector_twice: bool = False) -> DataFrame:
    """Misses over accesses of each window; optionally with sector misses counted twice, as some reports do."""
    miss = F.count_if(F.col(outcome).isin("MISS", "SECTOR_MISS"))
    if sector_twice:
        miss = miss + F.count_if(F.col(outcome) == "SECTOR_MISS")
    out = df.withColumn("window", window).groupBy(*keys, "window").agg(miss.alias("misses"), F.count_if(F.col(outcome) != "RESERVATION_FAIL").alias("accesses"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("misses").cast("double"), F.col("accesses").cast("double")), F.lit(0.0)))


def ratios(df: DataFrame, keys: list[str], parts: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of sums: name -> (numerator, denominator), 0 where the denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    return df.groupBy(*keys).agg(*[ratio(a, b).alias(name) for name, (a, b) in parts.items()])


def bank_rollup(df: DataFrame, chip: str, bank: str, value: str) -> DataFrame:
    """Per bank, per chip and in total."""
    return df.rollup(chip, bank).agg(F.sum(value).alias("total"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def dram_utilisation(df: DataFrame, keys: list[str], commands: str, active: str, idle: str) -> DataFrame:
    """Share of busy cycles and of useful ones, in whole percent."""
    percent = lambda a, b: F.coalesce(F.floor(F.try_divide((F.sum(a) * 100).cast("double"), b.cast("double"))), F.lit(0)).cast("long")
    whole = F.sum(active) + F.sum(idle)
    return df.groupBy(*keys).agg(percent(commands, whole).alias("utilisation"), percent(commands, F.sum(active)).alias("efficiency"))


def traffic(df: DataFrame, keys: list[str], kind: str, is_atomic: Column, size: str) -> DataFrame:
    """Packets and bytes by kind, atomics apart."""
    named = F.when(is_atomic, F.concat(F.col(kind), F.lit("_atomic"))).otherwise(F.col(kind))
    return df.withColumn("traffic", named).groupBy(*keys, "traffic", size).agg(F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"))


def network_stats(df: DataFrame, cls: str, value: str, position: str) -> DataFrame:
    """Per class: sum, mean, least and greatest with where they are; ties by position."""
    lo, hi = F.min(F.struct(value, position)), F.max(F.struct(F.col(value).alias("v"), (-F.col(position)).alias("p")))
    out = df.groupBy(cls).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), lo.alias("_lo"), hi.alias("_hi"))
    return out.select(cls, "total", "mean", F.col(f"_lo.{value}").alias("least"), F.col(f"_lo.{position}").alias("least_at"), F.col("_hi.v").alias("most"), (-F.col("_hi.p")).alias("most_at"))


def weighted_power(df: DataFrame, keys: list[str], counter: str, count: str, weights: DataFrame) -> DataFrame:
    """Sum of coefficient times counter; weights: (counter, coefficient)."""
    return df.join(weights, counter).groupBy(*keys).agg(F.sum(F.col("coefficient") * F.col(count)).alias("power"))


# source lines and memory accesses


def line_profile(df: DataFrame, file: str, line: str, sums: list[str]) -> DataFrame:
    return df.groupBy(file, line).agg(*[F.sum(c).alias(c) for c in sums])


def line_rollup(profile: DataFrame, line_map: DataFrame, line: str, source: str, total: str, part: str) -> DataFrame:
    """Lines to source lines: sum, greatest, and ratio of sums; every line counts, the last too."""
    return profile.join(line_map, line).groupBy(source).agg(F.sum(total).alias("total"), F.max(total).alias("most"), F.coalesce(F.try_divide(F.sum(part).cast("double"), F.sum(total).cast("double")), F.lit(0.0)).alias("ratio"))


def exposed_latency(stalls: DataFrame, flights: DataFrame, keys: list[str], at: str, start: str, end: str, line: str, bucket: int | None = None) -> DataFrame:
    """A stall cycle counts for every instruction in flight; with ``bucket``, they meet by key and time bucket."""
    return point_in_interval(stalls, flights, keys, at, start, end, "inner", bucket).groupBy(line).agg(F.count(F.lit(1)).alias("exposed"))


def segment_size(data_bytes: Column) -> Column:
    """Segment of a coalesced access by the size of its data: 32, 64 or 128 bytes."""
    return F.when(data_bytes == 1, 32).when(data_bytes == 2, 64).otherwise(128)


def coalesced(df: DataFrame, access: list[str], addr: str, size: str, lane: str | None = None) -> DataFrame:
    """Distinct segments per access; an access that straddles two counts in both."""
    seg = segment_size(F.col(size))
    at = df.withColumn("_s", seg).withColumn("segment", F.explode(F.array_distinct(F.array(F.floor(F.col(addr) / F.col("_s")), F.floor((F.col(addr) + F.col(size) - 1) / F.col("_s"))))))
    chunk = F.floor(F.pmod(F.col(addr), F.col("_s")) / 32)
    masks = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), chunk.cast("int"))).alias("chunk_mask")]
    if lane:
        masks.append(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(lane).cast("int"))).alias("lane_mask"))
    return at.groupBy(*access, "segment").agg(F.count(F.lit(1)).alias("n"), *masks)


def coalesced_atomic(df: DataFrame, access: list[str], addr: str, size: str, lane: str, sectors: bool = False) -> DataFrame:
    """Transactions of atomics: within a segment, the k-th lane of an access that meets an address goes into its k-th one.

    Data of an access have one size and lie at multiples of it, so two lanes meet in the same bytes or in
    none. With ``sectors`` every segment is 32 bytes.
    """
    seg = F.lit(32) if sectors else segment_size(F.col(size))
    at = df.withColumn("segment", F.floor(F.col(addr) / seg)).withColumn("transaction", F.row_number().over(W.partitionBy(*access, addr).orderBy(lane)))
    bit = lambda i: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))
    chunk = F.floor(F.pmod(F.col(addr), F.lit(128)) / 32)
    return at.groupBy(*access, "segment", "transaction").agg(F.count(F.lit(1)).alias("n"), bit(chunk).alias("chunk_mask"), bit(F.col(lane)).alias("lane_mask"))


def bank_conflicts(df: DataFrame, access: list[str], addr: str, banks: int = 32, word: int = 4, broadcast_one: bool = False) -> DataFrame:
    """Per access the most distinct words that meet in one bank, summed by ``access[:-1]``.

    With ``broadcast_one``, the first bank's extra word may be broadcast, which saves one.
    """
    w = F.floor(F.col(addr) / word)
    per = df.withColumns({"_word": w, "_bank": F.pmod(w, F.lit(banks))}).groupBy(*access, "_bank").agg(F.count_distinct("_word").alias("_n"))
    most = per.groupBy(*access).agg(F.max("_n").alias("_most"))
    cycles = F.greatest(F.col("_most") - 1, F.lit(1)) if broadcast_one else F.col("_most")
    return most.groupBy(*access[:-1]).agg(F.sum(cycles).alias("cycles"), F.count(F.lit(1)).alias("accesses"))
