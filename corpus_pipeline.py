"""The corpus pipeline: documents through the stages of STAGES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, neardup, sharding, toxicity
from seqloom.llm.common import settled, sized, stored, table, tidy


def _wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as one column ``row``, so that no column of theirs clashes with ``more``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go.

    Null and empty texts score as a text without toxic words and stay, as do rows without id;
    repeated rows are judged alike. Without labels all documents score the share of toxic
    ones, 0.001, and stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(_wrapped(docs, text=F.col("text")), model).filter("toxicity.score < 0.3").select("row.*")


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id.

    Of several rows of that id one stays, the first by a hash of the text, then of the row.
    A row without id goes by a hash of its text in place of one, so of equal texts without
    id, empty ones too, one stays. Rows with an id but without words have no copies and stay.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1)))
    marks = neardup.near_duplicates(docs.select(own.alias("doc_id"), "text"))
    gone = stored(marks.filter(~F.col("kept")).select(F.col("doc_id").alias("own")).distinct(), "gone")
    twice = stored(marks.filter("kept").groupBy(F.col("doc_id").alias("own")).agg(F.count("*").alias("c")).filter("c > 1").select("own"), "twice")
    rows = _wrapped(docs, own=own, text=F.col("text")).join(sized(gone), "own", "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    many = rows.join(sized(twice), "own", "left_semi")
    one = many.groupBy("own").agg(F.min_by("row", F.struct(F.xxhash64("text"), F.xxhash64("row"))).alias("row"))
    return rows.join(sized(twice), "own", "left_anti").select("row.*").unionByName(one.select("row.*"))


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go.

    Rows of one id, or without id, are judged apart by their texts; null and empty texts hold
    nothing and stay; an empty benchmark leaves all.
    """
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 or doc_id is null").isEmpty()
    own = F.col("doc_id") if unique else F.struct("doc_id", F.xxhash64("text").alias("text"))
    marks = decontaminate.contamination(docs.select(own.alias("own"), "text"), table(spark, sf_dir, "benchmark"), id_col="own")
    gone = sized(stored(marks.filter("contaminated").select(F.col("own").alias("gone")).distinct(), "gone"))
    return _wrapped(docs, own=own).join(gone, F.col("own").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, rows of small sources up to twice.

    A null source is one of its own; rows without words are taken once; rows of equal id and
    text share their fate.
    """
    return mixing.realise(docs, mixing.plan(docs, max_repeats=2.0))


@tidy
def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row, 0 to 7, in place of a column of that name.

    Equal texts share a shard, null and empty ones too; ties in size go by a hash of the text.
    """
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", into_shards),
]

#: SQL cannot express the stages that learn or hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
