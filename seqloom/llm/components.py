"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbours and itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``edges`` ``(u, v)`` that isn't its component's least node.

    ``component`` is the least node reachable. Loops, repeated and reversed edges change
    nothing; rows with a null are left out; no edges give an empty table.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        last, now = now, stored(_small(_large(now)), "edges")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = mark
