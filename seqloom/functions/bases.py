"""Column functions on DNA strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"


def clean(text: Column) -> Column:
    """Upper case, without anything but A, C, G and T; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^ACGT]+", "")


def encode(seq: Column) -> Column:
    """Base codes A=0, C=1, G=2, T=3, anything else -1."""
    return F.transform(F.array_remove(F.split(F.upper(seq), ""), ""), lambda c: (F.instr(F.lit(BASES), c) - 1).cast("int"))


def reverse_complement(seq: Column) -> Column:
    """Complement of the reverse; unknown letters become N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), BASES, BASES[::-1]))


def kmers(seq: Column, k: int, only_n: bool = False) -> Column:
    """All windows of ``k`` known bases, in one linear pass; none if the sequence is shorter.

    With ``only_n`` only windows with an N are left out, and other unknown letters stay.
    """
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?s)(?=({'[^N]' if only_n else '[ACGT]'}{{{k}}}))"), F.lit(1))


def windows(seq: Column, k: int) -> Column:
    """All windows of ``k`` letters, known or not, in order."""
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def context_index(context: Column) -> Column:
    """Base-4 number of a string of known bases, first base most significant; empty is 0."""
    digits = F.translate(context, BASES, "0123")
    return F.when(F.length(context) == 0, F.lit(0)).otherwise(F.conv(digits, 4, 10)).cast("long")


def from_index(index: Column, k: int) -> Column:
    """The string of ``k`` bases with this base-4 number."""
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), k, "0"), "0123", BASES) if k else F.lit("")


def log2_add(x: Column, y: Column) -> Column:
    """log2(2^x + 2^y)."""
    top, low = F.greatest(x, y), F.least(x, y)
    return F.when(low == float("-inf"), top).otherwise(top + F.log2(1 + F.pow(F.lit(2.0), low - top)))


def log2_sum(values: Column) -> Column:
    """log2 of the sum of 2^x over an array of numbers."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), x - top))
    return F.when(top == float("-inf"), top).otherwise(top + F.log2(total))


def log2_sum_by(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(*by, total)``: log2 of the sum of 2^x over each group, in two levels of partial sums.

    Values are summed by bins of 512 exponents, which no number overflows, before a group's few
    bins meet, so a group may hold any number of rows. Nulls count for nothing; a group without
    values has none, one of -inf alone -inf. Infinite or missing numbers (inf, nan) are kept.
    """
    x = F.col(value).cast("double")
    plain = F.when(F.abs(x) < float("inf"), x)
    bins = rows.filter(x.isNotNull()).groupBy(*by, F.floor(plain / 512).alias("bin")).agg(
        F.sum(F.pow(F.lit(2.0), plain - 512 * F.floor(plain / 512))).alias("part"), F.max(F.when(plain.isNull(), x)).alias("odd")
    )
    logs = bins.select(*by, F.coalesce(F.log2("part") + 512 * F.col("bin"), F.col("odd")).alias("log"))
    return logs.groupBy(*by).agg(F.collect_list("log").alias("logs")).select(
        *by, F.when(F.array_max("logs") < float("inf"), log2_sum(F.col("logs"))).otherwise(F.array_max("logs")).alias("total")
    )


def log2sumexp(x: pa.Array) -> float:
    """log2 of the sum of 2^x as an aggregate; nulls count for nothing, no values give null. One task reads a group: huge ones go by :func:`log2_sum_by`."""
    found = x.drop_null().to_numpy(zero_copy_only=False)
    if not len(found):
        return None
    top = float(found.max())
    return top if not np.isfinite(top) else top + float(np.log2(np.exp2(found - top).sum()))


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL text: ``revcomp``, ``kmers``, ``log2_sum``, the aggregate ``log2sumexp`` and the table function ``kmer_table``."""
    spark.udf.register("log2sumexp", F.arrow_udf(log2sumexp, "double"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING"
        " RETURN reverse(translate(regexp_replace(upper(s), '[^ACGT]', 'N'), 'ACGT', 'TGCA'))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS ARRAY<STRING>"
        " RETURN regexp_extract_all(upper(s), concat('(?=([ACGT]{', k, '}))'), 1)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION log2_sum(v ARRAY<DOUBLE>) RETURNS DOUBLE"
        " RETURN array_max(v) + log2(aggregate(v, 0D, (a, x) -> a + pow(2D, x - array_max(v))))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmer_table(s STRING, k INT) RETURNS TABLE (pos INT, kmer STRING)"
        " RETURN SELECT pos, w AS kmer FROM posexplode(regexp_extract_all(upper(s), concat('(?s)(?=(.{', k, '}))'), 1)) AS t(pos, w)"
        " WHERE w RLIKE '^[ACGT]*$'"
    )
