"""Relations: Parquet tables, delimited text with an integer key, CSV reports, row-range slices and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import text_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, key_pos: int = 1, delimiter: str = "|") -> DataFrame:
    """Text lines as (key, value). A key is what ``atoi`` makes of the field; lines of any length stay whole."""
    lines = spark.read.text(path)
    return with_text_key(lines, "value", key_pos, delimiter)


def with_text_key(df: DataFrame, line: str, key_pos: int = 1, delimiter: str = "|") -> DataFrame:
    return df.withColumn("key", text_key(F.col(line), key_pos, delimiter))


def write_relation(df: DataFrame, path: str, key: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, one file a task. With a key the files are range-partitioned and sorted, so later scans skip row groups."""
    if key:
        df = df.repartitionByRange(key).sortWithinPartitions(key)
    df.write.mode(mode).parquet(path)


def write_delimited(df: DataFrame, path: str, columns: list[str], delimiter: str = "|", mode: str = "overwrite") -> None:
    """Lines of the given columns, a delimiter behind each; null columns are empty fields."""
    fields = [x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(delimiter))]
    df.select(F.concat(*fields).alias("value")).write.mode(mode).text(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def slice_rows(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows first..last (1-based, inclusive) of df in a total order, as column ``row_no``.

    Rows are ranked in their range partitions, so a slice near the end costs no more than one near the start.
    """
    from ..operators.sorting import with_rank

    return with_rank(df, order, "row_no").where(F.col("row_no").between(first, last))


def slice_pages(df: DataFrame, order: list[str], rows_per_page: int, first_page: int, last_page: int) -> DataFrame:
    """Pages [first, last) when every page has ``rows_per_page`` rows in the given order."""
    rows = slice_rows(df, order, first_page * rows_per_page + 1, last_page * rows_per_page)
    return rows.withColumn("page_no", F.floor((F.col("row_no") - 1) / F.lit(rows_per_page)).cast("bigint"))


def tuple_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def size_estimate(df: DataFrame, line: str, fraction: float = 0.01, seed: int = 7) -> DataFrame:
    """Mean line length of a Bernoulli sample: (sampled, mean_bytes)."""
    sample = df.sample(fraction=fraction, seed=seed)
    return sample.agg(F.count(F.lit(1)).alias("sampled"), F.avg(F.octet_length(F.col(line))).alias("mean_bytes"))
