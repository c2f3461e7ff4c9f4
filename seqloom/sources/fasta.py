"""FASTA as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(seq_id, description, seq, length)``.

    A record begins with ``>`` at the start of a line, so headers may hold ``>``. The id is
    the header's first word. Line ends of either kind and white space in sequences are dropped.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    head = F.regexp_replace(F.regexp_extract("r", r"^([^\n]*)", 1), r"\r$", "")
    body = F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    rows = raw.filter(F.trim(F.regexp_replace("r", r"\s", "")) != "").select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), head.alias("description"), body.alias("seq")
    )
    return rows.withColumn("length", F.length("seq"))


def write_fasta(records: DataFrame, path: str) -> None:
    """``(seq_id, seq)`` as a folder of FASTA part files."""
    records.select(F.format_string(">%s\n%s", F.col("seq_id").cast("string"), "seq").alias("value")).write.mode("overwrite").text(path)
