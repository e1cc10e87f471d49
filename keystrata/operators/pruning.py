"""Key-range pruning between sorted runs and between whole relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .joins import equi_join, small_side
from .sorting import fresh, make_runs, range_bounds, range_part, run_stats


def _bucketed(stats: DataFrame, side: str, scale: DataFrame) -> DataFrame:
    """Runs under every bucket of the key space that they reach; disjoint runs make about runs + buckets rows."""
    bucket = lambda k: F.floor((F.col(k) - F.col("low")) / F.col("width")).cast("bigint")
    runs = stats.select(F.col("run").alias(f"{side}_run"), F.col("lowest_key").alias(f"{side}_lo"), F.col("highest_key").alias(f"{side}_hi"))
    runs = runs.where(F.col(f"{side}_lo").isNotNull()).crossJoin(F.broadcast(scale))  # one row on the right
    runs = runs.select(f"{side}_run", f"{side}_lo", f"{side}_hi", bucket(f"{side}_lo").alias(f"{side}_first"), bucket(f"{side}_hi").alias("last"))
    return runs.withColumn("bucket", F.explode(F.sequence(F.col(f"{side}_first"), F.col("last")))).drop("last")


def run_pairs(r_stats: DataFrame, s_stats: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges overlap: (r_run, s_run, lowest, highest).

    Zone maps of sorted runs are disjoint and ordered, so each r run meets a contiguous stretch of s runs and there are
    about as many pairs as runs. The key space is cut into as many buckets as there are runs and runs are joined by
    bucket; a pair counts in the first bucket that both reach.
    """
    both = r_stats.select("lowest_key", "highest_key").unionByName(s_stats.select("lowest_key", "highest_key"))
    width = (F.max("highest_key") - F.min("lowest_key") + F.lit(1)) / F.count(F.lit(1)).cast("double")
    scale = both.agg(F.min("lowest_key").alias("low"), width.alias("width"))
    pairs = _bucketed(r_stats, "r", scale).join(_bucketed(s_stats, "s", scale), "bucket")
    meet = (F.col("r_lo") <= F.col("s_hi")) & (F.col("s_lo") <= F.col("r_hi")) & (F.col("bucket") == F.greatest("r_first", "s_first"))
    return pairs.where(meet).select("r_run", "s_run", F.greatest("r_lo", "s_lo").alias("lowest"), F.least("r_hi", "s_hi").alias("highest"))


def pair_counts(r_stats: DataFrame, s_stats: DataFrame) -> DataFrame:
    """Per r run: s runs read (ranges overlap) and skipped: (r_run, n_read, n_skipped)."""
    total = s_stats.agg(F.count(F.lit(1)).alias("total"))
    read = run_pairs(r_stats, s_stats).groupBy("r_run").agg(F.count(F.lit(1)).alias("n_read"))
    r = r_stats.select(F.col("run").alias("r_run"))
    joined = r.join(read, "r_run", "left").crossJoin(F.broadcast(total))  # one row on the right
    n_read = F.coalesce("n_read", F.lit(0)).cast("bigint")
    return joined.select("r_run", n_read.alias("n_read"), (F.col("total") - n_read).alias("n_skipped"))


def run_pair_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, r_order: list[str], s_order: list[str], rows_per_run: int) -> DataFrame:
    """Run-by-run join: columns r_run, s_run, then both sides.

    Runs that overlap no run of the other side are dropped by the zone maps before the join. Equal keys lie in
    overlapping runs, so the join itself needs the key alone and no row is sent once for every run it might meet.
    """
    rr, ss = make_runs(r, r_order, rows_per_run), make_runs(s, s_order, rows_per_run)
    pairs = staged(run_pairs(run_stats(rr, r_key), run_stats(ss, s_key)).select("r_run", "s_run"), "run-pairs")
    keep = lambda side: small_side(pairs.select(F.col(f"{side}_run").alias("run")).distinct())
    left = rr.join(keep("r"), "run", "left_semi").withColumnRenamed("run", "r_run").drop("rank")
    right = ss.join(keep("s"), "run", "left_semi").withColumnRenamed("run", "s_run").drop("rank")
    joined = left.join(right.hint("merge"), left[r_key] == right[s_key])
    return joined.select("r_run", "s_run", *[left[c] for c in r.columns], *[right[c] for c in s.columns])


def range_joined(r: DataFrame, s: DataFrame, r_key: str, s_key: str, ranges: int) -> DataFrame:
    """Both sides cut by the same bounds of r's key and joined on (range, key): equal keys lie in equal ranges.

    Spark deals a merge join by the hash of its keys, so a task holds keys of several ranges and a hot range is spread
    over all tasks by key; rows outside s's reach of a range are never compared.
    """
    bounds = range_bounds(r, r_key, ranges)
    r_range, s_range = fresh(r, "r_range"), fresh(s, "s_range")
    left, right = r.withColumn(r_range, range_part(F.col(r_key), bounds)), s.withColumn(s_range, range_part(F.col(s_key), bounds))
    on = (left[r_range] == right[s_range]) & (left[r_key] == right[s_key])
    return left.join(right.hint("merge"), on).drop(left[r_range], right[s_range])


def range_pruned_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, algorithm: str = "sort_merge") -> DataFrame:
    """equi_join after both sides are cut to the overlap of their key ranges.

    The bounds are two rows of metadata; as literals in a BETWEEN they reach the Parquet scan, where row groups
    outside are skipped.
    """
    lo_hi = [df.agg(F.min(k), F.max(k)).first() for df, k in ((r, r_key), (s, s_key))]
    if any(x[0] is None for x in lo_hi):
        return equi_join(r.limit(0), s.limit(0), r_key, s_key, algorithm)
    low, high = max(x[0] for x in lo_hi), min(x[1] for x in lo_hi)
    cut = [df.where(F.col(k).between(F.lit(low), F.lit(high))) for df, k in ((r, r_key), (s, s_key))]
    return equi_join(cut[0], cut[1], r_key, s_key, algorithm)
