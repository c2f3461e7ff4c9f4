"""Exact quantiles of groups of any size.

Each wanted rank of a group is searched for in a range of values that narrows: a mergeable sketch
gives cuts within the range, rows are counted between the cuts, and the part that holds the rank is
the next range. Tasks hold sketches and counts, never a group; the few rows of the last range
are sorted at the end. A round over a billion rows leaves some ten million of them, the next some hundred thousand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.sources.folders import new_folder

#: Parts that a round cuts a range into, about; rows of a range that are few enough to sort.
CUTS, FEW = 128, 2_000


def _written(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, f"quantiles-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(grp, rank, value)``: the values at the ranks, from 0, of ``wanted`` ``(grp, rank)`` among ``rows`` ``(grp, x)`` without nulls."""
    found = []
    state = _written(wanted.select("grp", "rank", F.lit(0).cast("long").alias("skip"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    while True:
        # The table of ranges is as long as there are wanted ranks; rows go where they are in range.
        within = rows.join(state, "grp").filter((F.col("low").isNull() | (F.col("x") >= F.col("low"))) & (F.col("high").isNull() | (F.col("x") <= F.col("high"))))
        cuts = within.groupBy("grp", "rank").agg(F.percentile_approx("x", [i / CUTS for i in range(1, CUTS)], 20 * CUTS).alias("cuts"))
        part = F.size(F.filter("cuts", lambda c: c < F.col("x")))
        counted = within.join(cuts, ["grp", "rank"]).groupBy("grp", "rank", "skip", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("grp", "rank").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        held = counted.withColumn("skip", F.col("skip") + before).filter((F.col("skip") <= F.col("rank")) & (F.col("rank") < F.col("skip") + F.col("n")))
        state = _written(held.select("grp", "rank", "skip", "low", "high", "n"))
        found.append(state.filter("low = high").select("grp", "rank", F.col("low").alias("value")))
        small = state.filter(f"low < high and n <= {FEW}")
        last = rows.join(small, "grp").filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).groupBy("grp", "rank", "skip").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        found.append(last.select("grp", "rank", F.get("xs", (F.col("rank") - F.col("skip")).cast("int")).alias("value")))
        state = state.filter(f"low < high and n > {FEW}").drop("n")
        if state.isEmpty():
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out


def quantiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """``(by, share, value)``: exact quantiles by linear interpolation between ranks; nulls count for nothing, a group of them has no row.

    A null group is one of its own and NaN the largest number.
    """
    x = rows.select(F.struct(F.col(by).alias("g")).alias("grp"), F.col(value).cast("double").alias("x")).filter("x is not null")
    share = F.explode(F.array(*map(F.lit, shares)))
    at = x.groupBy("grp").agg(F.count("*").alias("n")).select("grp", "n", share.alias("share")).withColumn("at", (F.col("n") - 1) * F.col("share"))
    at = _written(at.select("grp", "share", F.floor("at").alias("r0"), F.ceil("at").alias("r1"), (F.col("at") - F.floor("at")).alias("part")))
    wanted = at.select("grp", F.explode(F.array("r0", "r1")).alias("rank")).distinct()
    values = _written(ranked(x, wanted))
    low, high = (values.select("grp", F.col("rank").alias(r), F.col("value").alias(v)) for r, v in (("r0", "v0"), ("r1", "v1")))
    out = at.join(low, ["grp", "r0"]).join(high, ["grp", "r1"])
    return out.select(F.col("grp.g").alias(by), "share", F.when(F.col("part") > 0, F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).otherwise(F.col("v0")).alias("value"))
