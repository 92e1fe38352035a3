"""Connected components of an edge table by alternating star contraction.

Each round has two passes over the edges: every vertex hands its larger
neighbours the smallest vertex it knows, then its smaller ones. Edge rows shrink
towards stars in O(log^2 n) rounds. The minimum of each vertex is written before
it is joined back, so that both sides of that join are plain exchanges, which
Spark splits when a hub holds most of the edges. Nothing goes to the driver but
one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.store import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> (node, component): the smallest node reachable, for every node that has an edge.

    Loops, repeated edges and either direction are allowed; rows with a null end
    are dropped. No edges give an empty table.
    """
    now = materialize(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc-edges",
    )
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-min")
        large = materialize(
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "cc-large",
        )
        small = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        after = materialize(
            large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct(),
            "cc-edges",
        )
        state = _state(after)
        for old in (now, least, large, small):
            discard(old)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct().toDF("node", "component")
    )
