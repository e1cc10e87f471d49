"""External sorts, sorted runs and their key ranges.

A run is ``rows_per_run`` consecutive rows in key order. Run numbers come from a distributed ranking: rows are dealt by
range and sorted, a row's place in its partition is written with it, and its rank is that place plus the sizes of the
partitions before. Bounds are sampled by row and rows of equal keys are told apart by their place in the input, so a hot
key is cut like any other; no stage holds more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

#: monotonically_increasing_id() holds the partition above so many bits, the row's place below.
PLACE_BITS = 33


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def external_sort(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total order over all partitions: range exchange, then a spilling local sort."""
    return df.orderBy(*keys)


def sort_runs(df: DataFrame, keys: list[str], runs: int) -> DataFrame:
    """At most ``runs`` range-disjoint partitions, each sorted; the merge phase's input."""
    return df.repartitionByRange(runs, *keys).sortWithinPartitions(*keys)


def range_bounds(df: DataFrame, key: str, parts: int, accuracy: int = 10_000) -> list:
    """At most parts - 1 ascending, different values of a numeric key that cut df about evenly by rows.

    One aggregate of mergeable sketches: parts - 1 values reach the driver, whatever df's size and however often a
    value repeats.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, accuracy)).first()[0] if shares else None
    return sorted(set(found or []))


def range_part(key: Column, bounds: list) -> Column:
    """Number of bounds below or at a row's key, by halving; null keys lie before all ranges."""

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key >= F.lit(bounds[mid]), find(mid + 1, high)).otherwise(find(low, mid))

    return find(0, len(bounds))


def with_rank(df: DataFrame, keys: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with its 1-based position in the total order of keys; rows of equal keys follow the input's order.

    The sorted rows are written to the shared folder once, since places must be the same whenever they are read.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, place, size, before, part = (fresh(df, x) for x in ("_tie", "_place", "_size", "_before", "_part"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys, tie).sortWithinPartitions(*keys, tie)
    rows = staged(dealt.drop(tie).withColumn(place, F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn(part, F.shiftright(place, PLACE_BITS)).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    starts = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(before))  # one row a partition
    ranked = rows.join(F.broadcast(starts), part)
    return ranked.withColumn(name, F.col(place) + F.col(before) + F.lit(1)).drop(part, place, before)


def make_runs(df: DataFrame, keys: list[str], rows_per_run: int) -> DataFrame:
    """df with ``rank`` and ``run`` = (rank - 1) div rows_per_run."""
    ranked = with_rank(df, keys)
    return ranked.withColumn("run", F.floor((F.col("rank") - 1) / F.lit(rows_per_run)).cast("bigint"))


def run_stats(runs: DataFrame, key: str) -> DataFrame:
    """Zone map: (run, lowest_key, highest_key, n)."""
    return runs.groupBy("run").agg(F.min(key).alias("lowest_key"), F.max(key).alias("highest_key"), F.count(F.lit(1)).alias("n"))


def sorted_descriptors(stats: DataFrame) -> DataFrame:
    """A zone map in the order of its lowest keys, runs of equal ones by number."""
    return stats.orderBy("lowest_key", "run")


def top_k(df: DataFrame, keys: list, k: int) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def merge_passes(n_runs: int, fan_in: int) -> int:
    """Passes a fan-in bounded merge would need for so many runs."""
    if fan_in < 2:
        raise ValueError("a merge takes two runs at least")
    passes = 0
    while n_runs > 1:
        n_runs, passes = -(-n_runs // fan_in), passes + 1
    return passes


def merge_report(df: DataFrame, rows_per_run: int, fan_ins: list[int]) -> DataFrame:
    """(fan_in, n_runs, passes) of sorting df in runs of so many rows."""
    runs = -(-df.count() // rows_per_run)
    return df.sparkSession.createDataFrame([(f, runs, merge_passes(runs, f)) for f in fan_ins], "fan_in bigint, n_runs bigint, passes bigint")
