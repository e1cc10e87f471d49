"""Connected components of an edge table by alternating star contractions; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its least neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that links reach.

    Each round writes its edges to the shared folder and drops the round before. Rounds stop when the edge set stays
    the same, which then is a star around each component's least node: about log(nodes) rounds, and two for stars.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = common.materialise(now, name)
    seen = _state(now)
    while True:
        new = common.materialise(_small_star(_large_star(now).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), name)
        common.drop_table(now)
        now, state = new, _state(new)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
