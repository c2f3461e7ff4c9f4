"""K-mer counts and background counts over a stream of sequences.

The aggregates are those of :mod:`seqloom.operators.corpus`; only the source differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.corpus import count_kmers


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``(seq_id, seq, length)`` from a folder into which FASTA files of one line a sequence arrive."""
    lines = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder)
    head = F.regexp_extract(F.regexp_replace("value", "^>", ""), r"^(\S*)", 1)
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return lines.select(head.alias("seq_id"), seq.alias("seq")).withColumn("length", F.length("seq"))


def kmer_stream(sequences: DataFrame, k: int, name: str) -> StreamingQuery:
    """Running counts of k-mers of one strand as an in-memory table; state is one row a k-mer, at most 4^k."""
    counts = count_kmers(sequences, k, strands=1)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).start()
