"""Power and I/O metering over sample tables: counter deltas, rates, process power, duty cycle, down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clamp_or_zero
from ..functions.units import COUNTER_RANGE
from .sorting import fresh


def lag_delta(value: str, by: list[str], order: list[str]) -> Column:
    """value minus the sample before it in the same series; null for the first."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order))


def wrap_delta(value: str, by: list[str], order: list[str], width: int = COUNTER_RANGE) -> Column:
    """Delta of a counter that wraps at ``width``; never negative."""
    return F.pmod(lag_delta(value, by, order), F.lit(width).cast("bigint"))


def elapsed_micros(ts: str, by: list[str], order: list[str]) -> Column:
    before = F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))
    return F.timestamp_diff("MICROSECOND", before, F.col(ts))


def rate(delta: Column, micros: Column) -> Column:
    """delta per second; null where no time has passed."""
    return F.try_divide(delta.cast("double"), micros.cast("double") / F.lit(1e6))


def io_rate(delta_bytes: Column, micros: Column) -> Column:
    """Whole mebibytes per second, 0 where no time has passed."""
    mebibytes = F.floor(delta_bytes / F.lit(1048576)).cast("double")
    return F.when(micros == 0, F.lit(0.0)).otherwise(rate(mebibytes, micros))


def usage_percent(delta_process: Column, delta_system: Column) -> Column:
    return F.try_divide(delta_process.cast("double") * F.lit(100.0), delta_system.cast("double"))


def process_power(usage: Column, package_power: Column, idle_power: float) -> Column:
    """usage% of what the package draws above idle; 0 if usage or the result lies outside [0, 100]."""
    valid = clamp_or_zero(usage, 0.0, 100.0)
    return clamp_or_zero(valid / F.lit(100.0) * (package_power - F.lit(idle_power)), 0.0, 100.0)


def duty_cycle(power: Column, cap: float, time_base_ms: int = 100) -> dict[str, Column]:
    """Over, supply, ratio, sleep and execute milliseconds of a controller that holds power at a cap.

    Above the cap it sleeps for the relative excess (0.75 when that exceeds the cap itself); below, it executes for
    the relative headroom. Times are truncated. It only acts on times between 1 ms and the base: ``suspends`` and
    ``executes`` say whether it does.
    """
    if not 25 <= time_base_ms <= 100:
        raise ValueError("the time base lies between 25 and 100 ms")
    over = F.greatest(power - F.lit(cap), F.lit(0.0))
    supply = F.greatest(F.lit(cap) - power, F.lit(0.0))
    above = power > F.lit(cap)
    ratio = F.when(above, F.when(over > F.lit(cap), F.lit(0.75)).otherwise(over / power)).otherwise(supply / F.lit(cap))
    part = F.floor(ratio * F.lit(float(time_base_ms))).cast("bigint")
    rest = F.lit(time_base_ms).cast("bigint") - part
    sleep, execute = F.when(above, part).otherwise(rest), F.when(above, rest).otherwise(part)
    acts = lambda t: t.between(1, time_base_ms)
    return {
        "power_over": over,
        "power_supply": supply,
        "ratio": ratio,
        "time_sleep": sleep,
        "time_execute": execute,
        "suspends": acts(sleep),
        "executes": acts(execute),
    }


def downsample_last(df: DataFrame, by: list[str], ts: str, tiebreak: str, unit: str) -> DataFrame:
    """Last sample per series and time bucket (``unit`` as date_trunc takes it): by columns, bucket, then all columns."""
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    rest = [c for c in df.columns if c not in by]
    last, name = F.max_by(F.struct(*rest), F.struct(ts, tiebreak)), fresh(df, "_last")
    return df.groupBy(*by, bucket.alias("bucket")).agg(last.alias(name)).select(*by, "bucket", *[F.col(f"{name}.{c}").alias(c) for c in rest])


def running_total(value: str, by: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def min_gap_samples(df: DataFrame, by: list[str], ts: str, order: list[str], gap_ms: int = 250) -> DataFrame:
    """Samples at least ``gap_ms`` after the one before; the first of a series stays."""
    gap = fresh(df, "_gap")
    return df.withColumn(gap, elapsed_micros(ts, by, order)).where(F.col(gap).isNull() | (F.col(gap) >= gap_ms * 1000)).drop(gap)


def disk_averages(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Columns count, bytes and ticks (100 ns) of one direction, to avg_ms per operation and bytes_per_ms.

    No operation at all: -1 and 0. A tick delta of 0 or less counts as 1 tick, a negative byte delta as 0; the
    rate is null when less than a whole millisecond was spent.
    """
    d_bytes, d_ticks = lag_delta("bytes", by, order), lag_delta("ticks", by, order)
    whole_ms = F.floor(F.greatest(d_ticks, F.lit(1)) / F.lit(10000)).cast("double")
    return df.select(
        "*",
        F.when(F.col("count") == 0, F.lit(-1.0)).otherwise(F.floor(d_ticks / F.lit(10000)).cast("double") / F.col("count")).alias("avg_ms"),
        F.when(F.col("count") == 0, F.lit(0.0)).otherwise(F.try_divide(F.greatest(d_bytes, F.lit(0)).cast("double"), whole_ms)).alias("bytes_per_ms"),
    )


def frequency_ratio(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Interval ratios from cycle counters acnt, mcnt, tsc: actual over maximum and over time-stamp cycles."""
    a, m, t = (lag_delta(c, by, order) for c in ("acnt", "mcnt", "tsc"))
    return df.select("*", F.try_divide(a.cast("double"), m.cast("double")).alias("ratio_max"), F.try_divide(a.cast("double"), t.cast("double")).alias("ratio_tsc"))


def explode_states(df: DataFrame, states: str = "states") -> DataFrame:
    """One row per element of an array of state structs."""
    rest, state = [c for c in df.columns if c != states], fresh(df, "_state")
    return df.select(*rest, F.posexplode(states).alias("state_no", state)).select(*rest, "state_no", f"{state}.*")


def space(df: DataFrame, total: str, free: str) -> DataFrame:
    """Whole mebibytes of a disk's or a machine's byte counters: columns total_mb, free_mb, used_mb added."""
    mb = lambda x: F.floor(x / F.lit(1048576)).cast("bigint")
    return df.select("*", mb(F.col(total)).alias("total_mb"), mb(F.col(free)).alias("free_mb"), mb(F.col(total) - F.col(free)).alias("used_mb"))


def tsc_mhz(first: Column, second: Column, micros: Column) -> Column:
    """Whole cycles a microsecond between two readings; a second reading below the first has passed 2^32 - 1 once.
    Null where no time has passed."""
    cycles = F.when(second < first, F.lit(COUNTER_RANGE - 1).cast("bigint") - first + second).otherwise(second - first)
    return F.floor(F.try_divide(cycles.cast("double"), micros.cast("double")))
