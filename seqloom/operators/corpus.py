"""Corpus statistics: k-mers, enrichment, backgrounds, composition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.bases import clean, context_index, from_index, kmers, reverse_complement
from seqloom.functions.motifs import kmer_pwm_column
from seqloom.operators import longmers

PSEUDO = 0.01


def from_documents(docs: DataFrame) -> DataFrame:
    """Texts as sequences ``(seq_id, seq, length)``: their letters A, C, G and T in upper case."""
    return docs.select(F.col("doc_id").alias("seq_id"), clean(F.col("text")).alias("seq")).withColumn("length", F.length("seq"))


#: Rows of a task, about, of a table that is dealt out anew.
ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A table that few tasks read, such as a file of one row group, dealt by ``key`` to more than there are cores; any other as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    read = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.count("*").alias("tasks"), F.sum("n").alias("n")).first()
    if read["tasks"] >= cores or (read["n"] or 0) < 2:
        return rows
    return rows.repartition(max(2 * cores, -(-read["n"] // ROWS)), key)


def last_wins(records: DataFrame) -> DataFrame:
    """One record an id: the last one's sequence at the first one's place; ``records`` has ``ord``."""
    return records.groupBy("seq_id").agg(F.max_by("seq", "ord").alias("seq"), F.min("ord").alias("ord"))


#: Letters of the pieces that long records are cut into, so that no row holds all windows of a chromosome.
PIECE = 1_000_000


def pieces(corpus: DataFrame, k: int, size: int = PIECE, by: tuple[str, ...] = ()) -> DataFrame:
    """``(seq,)`` and the columns ``by``: sequences cut into pieces of ``size`` window starts each, which overlap by ``k - 1`` letters.

    Every window of ``k`` letters is in one piece.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - k, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda i: F.substring(F.col("seq"), i + 1, F.lit(size + k - 1)))
    return corpus.select(*by, F.explode(F.when(F.length("seq") <= size + k - 1, F.array("seq")).otherwise(cut)).alias("seq"))


def count_kmers(corpus: DataFrame, k: int, strands: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """``(kmer, cnt)``, or ``(*by, kmer, cnt)``; with two strands each window also counts its reverse complement (a palindrome twice).

    Windows are counted before the other strand is added, so that only counts are doubled. Those
    of 12 to 31 bases are counted by :mod:`seqloom.operators.longmers`, unless by groups.
    """
    if 12 <= k <= 31 and not by:
        letters = corpus.agg(F.sum(F.length("seq"))).first()[0] or 0
        return longmers.count(pieces(corpus, k), k, strands, letters * strands)
    one = pieces(corpus, k, by=by).select(*by, F.explode(kmers(F.col("seq"), k)).alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("cnt"))
    return one if strands == 1 else other_strand(one, by)


def other_strand(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of one strand as those of both."""
    both = counts.select(*by, F.explode(F.array("kmer", reverse_complement(F.col("kmer")))).alias("kmer"), "cnt")
    return both.groupBy(*by, "kmer").agg(F.sum("cnt").alias("cnt"))


def canonical_kmers(corpus: DataFrame, k: int) -> DataFrame:
    """``(canon, cnt)``: windows of both strands under the lesser of the two spellings."""
    one = pieces(corpus, k).select(F.explode(kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return one.groupBy(F.least("kmer", reverse_complement(F.col("kmer"))).alias("canon")).agg(F.sum("cnt").alias("cnt"))


def gc_content(corpus: DataFrame) -> DataFrame:
    """``(gc,)``: G and C among all letters but N; 0.5 if there are none."""
    letters = lambda keep: F.sum(F.length(F.regexp_replace(F.upper("seq"), keep, "")))
    gc, known = letters("[^GC]"), letters("N")
    return corpus.agg(F.when(known > 0, gc / known).otherwise(0.5).alias("gc"))


def enriched(corpus: DataFrame, k: int = 8, top: int = 10, least: int = 5) -> DataFrame:
    """``(kmer, cnt, ratio, rnk)``: k-mers by observed over expected count, one spelling of each strand pair.

    Expected is the chance of the k-mer under the corpus's GC content times the number of
    windows of both strands, at least 1. Ties go by the k-mer.
    """
    # The one row of statistics is broadcast.
    rated = count_kmers(corpus, k).filter(F.col("cnt") >= least).crossJoin(F.broadcast(composition(corpus, k)))
    best = one_spelling(rated.withColumn("ratio", enrichment(k))).orderBy(F.desc("ratio"), "kmer").limit(top)
    return best.withColumn("rnk", F.row_number().over(W.orderBy(F.desc("ratio"), "kmer")))


def composition(corpus: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, seqs, g, l, p)``: sequences, letters G and C, letters but N, and windows of ``k`` letters of both strands."""
    return corpus.groupBy(*by).agg(
        F.count("*").alias("seqs"),
        F.sum(F.length(F.regexp_replace(F.upper("seq"), "[^GC]", ""))).alias("g"),
        F.sum(F.length(F.regexp_replace(F.upper("seq"), "N", ""))).alias("l"),
        F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(0)) * 2).alias("p"),
    )


def enrichment(k: int) -> Column:
    """Observed over expected count of a row ``(kmer, cnt, g, l, p)``; expected is at least 1."""
    gc_n = F.length(F.regexp_replace("kmer", "[^GC]", ""))
    gc = F.when(F.col("l") > 0, F.col("g") / F.col("l")).otherwise(0.5)
    return F.col("cnt") / F.greatest(F.pow(gc / 2, gc_n) * F.pow((1 - gc) / 2, k - gc_n) * F.col("p"), F.lit(1.0))


def one_spelling(rated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, kmer, cnt, ratio)``: of a k-mer and its reverse complement the one with the greater ratio, then the lesser spelling."""
    canon = F.least("kmer", reverse_complement(F.col("kmer")))
    one = rated.groupBy(*by, canon.alias("canon")).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "kmer", "cnt")).alias("x"))
    return one.select(*by, "x.kmer", "x.cnt", (-F.col("x.r")).alias("ratio"))


def seed_pwms(corpus: DataFrame, motifs: int, length: int) -> DataFrame:
    """``(rnk, kmer, pwm)``: k-mers to begin with, the best ``motifs`` of the ``2 * motifs`` most enriched, as log2 matrices."""
    return enriched(corpus, length, 2 * motifs).filter(F.col("rnk") <= motifs).select("rnk", "kmer", kmer_pwm_column(F.col("kmer")).alias("pwm"))


def seed_kmers(corpus: DataFrame, motifs: int, length: int) -> list[str]:
    return [r["kmer"] for r in seed_pwms(corpus, motifs, length).orderBy("rnk").collect()]


def background(corpus: DataFrame, order: int = 3) -> DataFrame:
    """``(ctx, base, cnt, logp)`` of a Markov model: log2 chance of a base after ``order`` bases, for every context.

    Each cell has 0.01 added; windows with unknown letters are skipped.
    """
    if not 0 <= order <= 5:
        raise ValueError("the order is 0 to 5")
    seen = count_kmers(corpus, order + 1, strands=1).select(context_index(F.col("kmer")).alias("id"), "cnt")
    grid = corpus.sparkSession.range(4 ** (order + 1))
    full = grid.join(seen, "id", "left").select(
        F.floor(F.col("id") / 4).cast("int").alias("ctx"), (F.col("id") % 4).cast("int").alias("base"), F.coalesce("cnt", F.lit(0)).alias("cnt")
    )
    total = F.sum("cnt").over(W.partitionBy("ctx"))
    return full.withColumn("logp", F.log2((F.col("cnt") + PSEUDO) / (total + 4 * PSEUDO) + 1e-10))


def uniform_background() -> list[list[float]]:
    return [[-2.0] * 4]


def background_stats(model: DataFrame) -> DataFrame:
    """Mean chance of each base over contexts, and GC: ``(a, c, g, t, gc)``."""
    p = F.pow(F.lit(2.0), "logp")
    at = lambda b: F.avg(F.when(F.col("base") == b, p))
    return model.agg(at(0).alias("a"), at(1).alias("c"), at(2).alias("g"), at(3).alias("t")).withColumn("gc", F.col("c") + F.col("g"))


def initial_bases(corpus: DataFrame, order: int) -> DataFrame:
    """``(base, p)`` over the first ``order`` letters of each sequence, 0.01 added to each count."""
    letters = corpus.select(F.explode(F.split(F.substring(F.upper("seq"), 1, order), "")).alias("c")).filter(F.col("c").isin(*"ACGT"))
    seen = letters.groupBy((F.instr(F.lit("ACGT"), F.col("c")) - 1).cast("long").alias("id")).agg(F.count("*").alias("cnt"))
    full = corpus.sparkSession.range(4).join(seen, "id", "left").select(F.col("id").cast("int").alias("base"), (F.coalesce("cnt", F.lit(0)) + PSEUDO).alias("c"))
    return full.select("base", (F.col("c") / F.sum("c").over(W.partitionBy())).alias("p"))


def lengths(corpus: DataFrame) -> DataFrame:
    """``(n, total, mean, shortest, longest)``; the mean sets a motif's transition 1 / mean."""
    return corpus.agg(
        F.count("*").alias("n"), F.sum("length").alias("total"), F.avg("length").alias("mean"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    )


def transitions(mean: float, motifs: int) -> tuple[float, float]:
    """log2 of staying in the background and of entering a motif."""
    each = 1 / mean
    return math.log2(1 - min(motifs * each, 0.9999)), math.log2(each)


def ensemble_size(total: int) -> int:
    """Live points for a corpus of so many bases."""
    return max(50, int(50 * math.log10(max(total, 100))))


def dinucleotides(corpus: DataFrame) -> DataFrame:
    return count_kmers(corpus, 2, strands=1)


def contexts(model: DataFrame, order: int) -> DataFrame:
    """``model`` with contexts spelt out."""
    return model.withColumn("context", from_index(F.col("ctx"), order))
