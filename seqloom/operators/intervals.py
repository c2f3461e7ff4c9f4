"""Joins on half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bins(df: DataFrame, prefix: str, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return df.filter("start < end").select("grp", F.col("start").alias(f"{prefix}_start"), F.col("end").alias(f"{prefix}_end"), F.col("id").alias(f"{prefix}_id"), F.explode(bins).alias("bin"))


def overlaps(a: DataFrame, b: DataFrame, width: int = 1024) -> DataFrame:
    """``(grp, a_id, b_id, overlap)`` of intervals ``(grp, id, start, end)`` of one group that overlap.

    Intervals are dealt into bins of ``width``, so the join is on equal bins; a pair counts
    in the bin where its overlap begins.
    """
    both = _bins(a, "a", width).join(_bins(b, "b", width), ["grp", "bin"])
    low, high = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.filter((low < high) & (F.floor(low / width) == F.col("bin"))).select("grp", "a_id", "b_id", (high - low).alias("overlap"))


def free(a: DataFrame, taken: DataFrame, width: int = 1024) -> DataFrame:
    """Intervals of ``a`` that overlap none of ``taken``; columns and repeated rows of ``a`` stay as they are.

    A sweep: an interval is hit if, of the taken ones that begin before it ends, the furthest end
    lies past its start. That running maximum is kept in two levels, over bins of ``width`` and
    within each, so no overlapping pair is made and a long group is many windows. Empty intervals
    and those with a null or of a null group overlap nothing.
    """
    whole = F.col("grp").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") < F.col("end"))
    rows = a.select(F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("row"), "grp", "start", "end", F.coalesce(whole, F.lit(False)).alias("whole"))
    asked = rows.filter("whole").select("grp", F.col("end").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("upto"), F.col("start").alias("from"), "row")
    begun = taken.filter(whole).select("grp", F.col("start").alias("key"), F.lit(1).alias("kind"), F.col("end").cast("long").alias("upto"), F.lit(None).cast("long").alias("from"))
    both = asked.unionByName(begun, allowMissingColumns=True).withColumn("bin", F.floor(F.col("key") / width))
    earlier = W.partitionBy("grp").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = both.groupBy("grp", "bin").agg(F.max("upto").alias("m")).select("grp", "bin", F.max("m").over(earlier).alias("reached"))
    # At one key the question comes first: a taken interval that begins where another ends does not overlap it.
    within = W.partitionBy("grp", "bin").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = both.join(bins, ["grp", "bin"]).withColumn("reached", F.greatest("reached", F.max("upto").over(within)))
    free_ = swept.filter((F.col("kind") == 0) & (F.col("reached").isNull() | (F.col("reached") <= F.col("from"))))
    return free_.select("row.*").unionByName(rows.filter("not whole").select("row.*"))
