"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> node, component (the smallest node that links reach), for nodes with an edge.

    Minima are aggregated before the shuffle and joined back, so a node with very many neighbours is no bottleneck;
    each step ends in a written table.
    """
    held = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(held)
    while mark[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        stepped = materialize(small, "edges")
        now = _mark(stepped)
        discard(held)
        held = stepped
        if now == mark:
            break
        mark = now
    roots = held.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
