"""Sample streams: a file source of sensor rows, projection, watermarked down-sampling, a duty-cycle log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metering import duty_cycle


def sample_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet samples as a stream; event time is cast to TIMESTAMP, which watermarks need.

    The last letter is made a pattern, so that the path may be one file as well as a folder of files.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def downsample_stream(stream: DataFrame, by: str, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Last sample per series and window; windows close once the watermark passes them."""
    last = F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id"))
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", interval), F.col(by)).agg(last.alias("last"), F.count(F.lit(1)).alias("n"))
    return windows.select(by, F.col("window.start").alias("bucket"), "last.event_id", "last.value", "n")


def duty_cycle_stream(stream: DataFrame, power: str, cap: float, time_base_ms: int = 100) -> DataFrame:
    columns = duty_cycle(F.col(power), cap, time_base_ms)
    return stream.select("*", *[c.alias(k) for k, c in columns.items()])


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, to a Parquet folder."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
