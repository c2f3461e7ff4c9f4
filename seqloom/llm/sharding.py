"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that stays together. The heaviest groups and bundles of
light ones, sorted by size, go one after the other to the least-loaded shard through a heap.
The heap sees a bounded number of items whatever the corpus holds: a group heavier than
``1 / (n_shards * items_per_shard)`` of all bytes is an item of its own (by the pigeonhole
principle there are at most ``n_shards * items_per_shard`` of these) and all other groups are
dealt by hash to as many bundles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import stored, tidy


def longest_first(items: Iterable[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Item to shard: the largest first, each to the least-loaded shard.

    Ties in size go by the item's name, ties in load by the shard's number.
    """
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("grp")
    )


def _bundle(parts: int) -> Column:
    return F.concat(F.lit("~"), F.pmod(F.xxhash64("grp"), F.lit(parts)).cast("string"))


def _plan(slim: DataFrame, n_shards: int, items_per_shard: int) -> tuple[DataFrame, DataFrame]:
    """``(grp, heavy)`` and ``(bundle, light)``: the shard of each heavy group and of each bundle."""
    parts = n_shards * items_per_shard
    cut = (slim.agg(F.sum("size")).first()[0] or 0) // parts
    items = (
        slim.groupBy("grp").agg(F.sum("size").alias("b"))
        .withColumn("item", F.when(F.col("b") > cut, F.col("grp")).otherwise(_bundle(parts)))
        .groupBy("item").agg(F.sum("b").alias("b"))
    )
    plan = longest_first(((r["item"], r["b"]) for r in items.collect()), n_shards)
    types = pa.schema([("item", pa.string()), ("to", pa.int32())])
    df = slim.sparkSession.createDataFrame(pa.table({"item": list(plan), "to": list(plan.values())}, schema=types))
    light = F.col("item").startswith("~")
    return df.filter(~light).select(F.col("item").alias("grp"), F.col("to").alias("heavy")), df.filter(light).select(F.col("item").alias("bundle"), F.col("to").alias("light"))


def _placed(rows: DataFrame, plan: tuple[DataFrame, DataFrame], parts: int) -> DataFrame:
    """``rows``, which have ``grp``, with ``shard``. Either table has at most ``parts`` rows, so both are broadcast."""
    heavy, light = plan
    return (
        rows.withColumn("bundle", _bundle(parts)).join(F.broadcast(heavy), "grp", "left").join(F.broadcast(light), "bundle", "left")
        .withColumn("shard", F.coalesce("heavy", "light")).drop("grp", "bundle", "heavy", "light")
    )


@tidy
def assign(docs: DataFrame, n_shards: int = 8, items_per_shard: int = 4000, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``shard``, which takes the place of one of that name; no row is shuffled.

    Equal texts, null among the empty ones, share a shard.
    """
    plan = _plan(stored(_slim(docs, text_col, text_col).drop("id"), "sizes"), n_shards, items_per_shard)
    kept = [c for c in docs.columns if c != "shard"]
    rows = docs.select(F.struct(*kept).alias("row"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("grp"))
    return _placed(rows, plan, n_shards * items_per_shard).select("row.*", "shard")


@tidy
def shard(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", items_per_shard: int = 4000, rows_per_bucket: int = 8192
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 1. Groups are equal texts; null counts as the empty
    text. ``slot`` numbers the rows of a shard without gaps, by a hash bucket of the id, then
    the id. Repeated rows are rows of their own; rows with null ids come first in their
    bucket. An empty table gives an empty result. A group larger than a shard's share makes
    its shard the largest: equal texts are never torn apart.
    """
    slim = stored(_slim(docs, id_col, text_col), "sizes")
    plan = _plan(slim, n_shards, items_per_shard)
    buckets = max(1, -(-slim.count() // (n_shards * rows_per_bucket)))
    placed = _placed(slim, plan, n_shards * items_per_shard).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
