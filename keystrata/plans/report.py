"""Phase reports: what a join or sort run took, as a metrics table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sorting import merge_passes

REPORT_SCHEMA = "operator string, phase string, rows bigint, wall_ms bigint, plan string"


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df that counts its rows as they pass, in the same job that uses them."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def timed_phases(spark: SparkSession, operator: str, phases: dict) -> DataFrame:
    """Run each phase (name to DataFrame) to a no-op sink; one row of REPORT_SCHEMA each and a total."""
    rows, total = [], 0
    for name, df in phases.items():
        df, seen = observed(df)
        begun = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        took = int((time.monotonic() - begun) * 1000)
        total += took
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = sorted({w for w in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin", "Exchange", "Sort") if w in plan})
        rows.append((operator, name, seen.get.get("rows", 0), took, ",".join(joins)))
    rows.append((operator, "total", sum(r[2] for r in rows), total, ""))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


# The columns of the sensor log and of the power-cap log, in their order.
SENSOR_COLUMNS = (
    "system_time rdtsc cpu_time_total cpu_time frequency_mhz multiplier voltage processor_power_watt package_energy_joules package_energy_mwh process_power process_usage "
    "power_cap_value package_temperature_c package_power_limit_watt read_bytes_count write_bytes_count read_rate_mb_s write_rate_mb_s disk_time_ms total_byte_read"
).split()
SENSOR_PATTERNS = dict(zip(SENSOR_COLUMNS, "%s %d %.2f %.2f %d %d %.6f %.2f %.3f %.3f %.2f %.2f %.2f %d %d %d %d %.0f %.0f %d %d".split(), strict=True))
POWER_CAP_PATTERNS = dict(
    zip("package_power process_usage process_power power_over power_supply ratio time_sleep time_execute".split(), "%.2f %.2f %.2f %.2f %.2f %.2f %d %d".split(), strict=True)
)


def formatted(df: DataFrame, patterns: dict[str, str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The log's columns as text in their printf patterns, in the log's order, behind the columns to keep."""
    kinds = {"f": "double", "d": "bigint", "s": "string"}
    return df.select(*keep, *[F.format_string(p, F.col(c).cast(kinds[p[-1]])).alias(c) for c, p in patterns.items()])


def partition_report(tables: dict[str, DataFrame], rows_per_run: int, fan_in: int) -> DataFrame:
    """(table, relation_rows, run_rows, partition_num, merge_pass): the partition phase of each side of a join."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        n = df.count()
        runs = -(-n // rows_per_run)
        rows.append((name, n, rows_per_run, runs, merge_passes(runs, fan_in)))
    return spark.createDataFrame(rows, "table string, relation_rows bigint, run_rows bigint, partition_num bigint, merge_pass bigint")


def join_report(spark: SparkSession, phases: dict[str, DataFrame], join: str = "join") -> DataFrame:
    """(entry, value) of a join run phase by phase: Total Join Count, then each phase's and the whole time in ms."""
    timed = timed_phases(spark, "join", phases)
    count = timed.where(F.col("phase") == join).select(F.lit("Total Join Count").alias("entry"), F.col("rows").alias("value"))
    return count.unionByName(timed.select(F.concat(F.lit("Total "), F.initcap("phase"), F.lit(" Time")).alias("entry"), F.col("wall_ms").alias("value")))
