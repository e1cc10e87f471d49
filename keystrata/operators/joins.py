"""Equi-joins of two keyed relations under a chosen physical strategy.

Every strategy gives the same multiset of rows: the inner join on the key, both key columns kept, null keys never
matching, many-to-many keys fully paired, whichever side comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import text_key

#: The strategy's name and the hint that asks for it.
HINTS = {
    "sort_merge": "merge",
    "parallel_sort_merge": "merge",
    "grace_hash": "shuffle_hash",
    "hybrid_hash": None,
    "block_nested_loop": None,
    "shared_scan": None,
    "auto": None,
}

#: Above this estimated size a side is not broadcast; the join falls back to a shuffled hash join.
BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for df (from files' sizes, scaled by what the plan keeps)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df marked for broadcast if its estimate is within the limit, else marked for a shuffled hash build."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df.hint("shuffle_hash")


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    algorithm: str = "auto",
    how: str = "inner",
    partitions: int | None = None,
) -> DataFrame:
    """left joined with right where the keys are equal; columns of left, then of right. Key names must differ.

    ``block_nested_loop``, ``shared_scan`` and ``hybrid_hash`` build a hash table of the right side and share it with
    every task scanning the left one, if the right side is small enough; otherwise both sides are dealt by hash, as
    ``grace_hash`` does in any case. ``parallel_sort_merge`` first deals both sides by key into ``partitions`` parts, so
    that one exchange a side serves the sort, the join and whatever follows on the same key; without ``partitions`` its
    plan is that of ``sort_merge``, which Spark runs in parallel anyway.
    """
    if algorithm not in HINTS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {sorted(HINTS)}")
    on = left[left_key] == right[right_key]
    if algorithm in ("block_nested_loop", "shared_scan", "hybrid_hash"):
        return left.join(small_side(right), on, how)
    if algorithm == "parallel_sort_merge" and partitions:
        left, right = left.repartition(partitions, left_key), right.repartition(partitions, right_key)
        on = left[left_key] == right[right_key]
    hint = HINTS[algorithm]
    return left.join(right.hint(hint) if hint else right, on, how)


def concat_join(left: DataFrame, right: DataFrame, key_pos: tuple[int, int] = (1, 1), algorithm: str = "sort_merge") -> DataFrame:
    """Join of two text relations (column ``value``) on the key field of each line: (key, value = left text + right text)."""
    r = left.select(text_key(F.col("value"), key_pos[0]).alias("left_key"), F.col("value").alias("left_value"))
    s = right.select(text_key(F.col("value"), key_pos[1]).alias("right_key"), F.col("value").alias("right_value"))
    joined = equi_join(r, s, "left_key", "right_key", algorithm)
    return joined.select(F.col("left_key").alias("key"), F.concat("left_value", "right_value").alias("value"))


def partition_sizes(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows per hash bucket, the bucket being key mod buckets: (bucket, n)."""
    bucket: Column = F.pmod(F.col(key), F.lit(buckets)).cast("bigint")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def join_cardinality(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows the inner join would have, from per-key counts, without making them: (n_keys, n_rows)."""
    l = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("lk")).agg(F.count(F.lit(1)).alias("ln"))
    r = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("rk")).agg(F.count(F.lit(1)).alias("rn"))
    both = l.join(r, l["lk"] == r["rk"])
    return both.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("ln") * F.col("rn")), F.lit(0)).cast("bigint").alias("n_rows"))


def lookup_first(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, order: list[str], keep: list[str]) -> DataFrame:
    """rows with the columns ``keep`` of the first matching dim row in the given order; null where none matches."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    one = dim.groupBy(F.col(dim_key).alias("dim_key")).agg(first.alias("first_match"))
    joined = rows.join(small_side(one), rows[key] == one["dim_key"], "left")
    return joined.select(*[rows[c] for c in rows.columns], *[one["first_match"][c].alias(c) for c in keep])
