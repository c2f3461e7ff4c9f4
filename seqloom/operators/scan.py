"""Scanning sequences with a motif: all windows as plain columns, or a summary of each row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.bases import BASES, from_index, windows
from seqloom.functions.motifs import reverse
from seqloom.operators.likelihood import block_scores, encode, portions, window_codes


def window_score(window: Column, pwm: np.ndarray) -> Column:
    """Sum of log2 weights over a window; null if a letter is unknown."""
    out = F.lit(0.0)
    for i, row in enumerate(np.asarray(pwm)):
        letter = F.substring(window, i + 1, 1)
        cell = F.when(letter == "A", float(row[0]))
        for b, x in zip(BASES[1:], row[1:], strict=True):
            cell = cell.when(letter == b, float(x))
        out = out + cell
    return out


#: Longest window whose scores are looked up in a table of all windows, 4^LOOKUP rows at most.
LOOKUP = 8


def scan(corpus: DataFrame, pwm: np.ndarray, both_strands: bool = False) -> DataFrame:
    """``(seq_id, pos, score)`` of every window of known bases, ``pos`` from 0; with both strands the better score.

    A window's score depends on its letters alone: short ones are looked up in a broadcast
    table of all windows, and no row is shuffled.
    """
    w = len(pwm)
    each = corpus.select("seq_id", F.posexplode(windows(F.col("seq"), w)).alias("pos", "w"))
    score = window_score(F.col("w"), pwm)
    if both_strands:
        score = F.greatest(score, window_score(F.col("w"), reverse(pwm)))
    if w > LOOKUP:
        return each.select("seq_id", "pos", score.alias("score")).filter("score is not null")
    table = corpus.sparkSession.range(4**w).select(from_index(F.col("id"), w).alias("w")).withColumn("score", score)
    return each.join(F.broadcast(table), "w").select("seq_id", "pos", "score")


@dataclass(frozen=True)
class Matrix:
    """A motif's log2 weights with the place of its first row relative to a site, and what its scores count."""

    name: str
    rows: np.ndarray
    offset: int = 0
    weight: float = 1.0


def scan_matrices(corpus: DataFrame, matrices: list[Matrix], both_strands: bool = False) -> DataFrame:
    """``(seq_id, motif, pos, score)`` of every window of known bases of each matrix.

    ``pos`` is the site's place: a window that begins ``offset`` letters after it belongs to it, so
    matrices of one site add up by ``pos``, which may lie before the sequence's first letter. The score
    is the window's times the matrix's weight.
    """
    parts = [
        scan(corpus, m.rows, both_strands).select("seq_id", F.lit(m.name).alias("motif"), (F.col("pos") - m.offset).alias("pos"), (F.col("score") * m.weight).alias("score"))
        for m in matrices
    ]
    return reduce(DataFrame.unionByName, parts)


def summed_sites(corpus: DataFrame, matrices: list[Matrix], least: float = -np.inf, both_strands: bool = False, id_type: str = "long") -> DataFrame:
    """``(seq_id, pos, score)``: the sites where all matrices have a window of known bases and their scores add up to ``least`` or more.

    The sums over matrices of :func:`scan_matrices` by site, made sequence by sequence: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            joined, lengths = _side_by_side(batch.column(1).to_pylist())
            numbers, ends = window_codes(joined), np.cumsum(np.array(lengths, np.int64) + 1)
            # A site may lie before its sequence's first letter and after its last one.
            wide = 2 * (joined.shape[1] + max(abs(m.offset) for m in matrices) + 1)
            parts = []
            for m in matrices:
                score = block_scores(joined, np.asarray(m.rows, float), numbers)[0]
                if both_strands:
                    score = np.maximum(score, block_scores(joined, reverse(m.rows), numbers)[0])
                at = np.flatnonzero(score > -np.inf)
                own = np.searchsorted(ends, at, side="right")
                begin = ends[own] - np.array(lengths, np.int64)[own] - 1
                parts.append((own, at - begin - m.offset, score[at] * m.weight))
            own, pos, score = parts[0]
            for other, there, more in parts[1:]:
                _, i, j = np.intersect1d(own * wide + pos, other * wide + there, assume_unique=True, return_indices=True)
                own, pos, score = own[i], pos[i], score[i] + more[j]
            keep = score >= least
            ids = batch.column(0).take(pa.array(own[keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos[keep], pa.int32()), pa.array(score[keep])], names=["seq_id", "pos", "score"])

    return corpus.select("seq_id", "seq").mapInArrow(run, f"seq_id {id_type}, pos int, score double")


def summaries(corpus: DataFrame, pwm: np.ndarray, both_strands: bool, least: float = 0.0, id_type: str = "long") -> DataFrame:
    """``(seq_id, pos, score, hits, total)`` of each row with any window of known bases.

    ``pos`` and ``score`` are those of its best window, the first of equals; ``hits`` counts
    windows that score ``least`` or more; ``total`` is the log2 of the sum of 2^score. A
    batch's sequences are scored as one array, and nothing is shuffled.
    """
    w, fwd, rev = len(pwm), np.asarray(pwm, float), reverse(pwm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            joined, lengths = _side_by_side(batch.column(1).to_pylist())
            numbers = window_codes(joined)
            score = block_scores(joined, fwd, numbers)[0]
            if both_strands:
                score = np.maximum(score, block_scores(joined, rev, numbers)[0])
            at, rows = 0, []
            for i, n in enumerate(lengths):
                own = score[at : at + max(0, n - w + 1)]
                at += n + 1
                if len(own) and (top := own[best := int(own.argmax())]) > -np.inf:
                    rows.append((i, best, top, int((own >= least).sum()), top + np.log2(np.exp2(own - top).sum())))
            keep, pos, tops, hits, totals = zip(*rows, strict=True) if rows else ((),) * 5
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(pos, pa.int32()), pa.array(tops, pa.float64()), pa.array(hits, pa.int64()), pa.array(totals, pa.float64())],
                names=["seq_id", "pos", "score", "hits", "total"],
            )

    return corpus.select("seq_id", "seq").mapInArrow(run, f"seq_id {id_type}, pos int, score double, hits long, total double")


def best_hits(corpus: DataFrame, pwm: np.ndarray, both_strands: bool = True) -> DataFrame:
    """``(seq_id, pos, score)``: each row's best window, the first of equals."""
    return summaries(corpus, pwm, both_strands).select("seq_id", "pos", "score")


def hits(corpus: DataFrame, pwm: np.ndarray, least: float, both_strands: bool = True) -> DataFrame:
    """``(seq_id, hits)``: windows that score ``least`` or more, for rows with any."""
    return summaries(corpus, pwm, both_strands, least).select("seq_id", "hits").filter("hits > 0")


def log2_sums(corpus: DataFrame, pwm: np.ndarray) -> DataFrame:
    """``(seq_id, total)``: log2 of the sum of 2^score over a row's windows."""
    return summaries(corpus, pwm, both_strands=False).select("seq_id", "total")


def _side_by_side(seqs: list[str | None]) -> tuple[np.ndarray, list[int]]:
    """Codes of sequences one after another, with an unknown letter after each, and their lengths."""
    codes = [encode(s or "") for s in seqs]
    joined = np.concatenate([x for c in codes for x in (c, np.full(1, -1, np.int8))] or [np.empty(0, np.int8)])
    return joined[None, :], [len(c) for c in codes]


def best_sites(corpus: DataFrame, motifs: dict[str, np.ndarray], id_type: str = "long") -> DataFrame:
    """``(seq_id, motif, pos, strand, score, site)``: each row's best window of every motif, on either strand, in one pass.

    Scores have nine decimals, so that windows of equal weights tie: the first one wins, then
    the strand ``+``. ``site`` is the window as the motif reads it. A row without a window of
    known bases has no site.
    """
    sides = {name: (np.asarray(m, float), reverse(m)) for name, m in motifs.items()}
    kinds = pa.schema([("motif", pa.string()), ("pos", pa.int64()), ("strand", pa.string()), ("score", pa.float64()), ("site", pa.string())])
    turn = str.maketrans(BASES, BASES[::-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            seqs = batch.column(1).to_pylist()
            joined, lengths = _side_by_side(seqs)
            numbers, keep, rows = window_codes(joined), [], []
            for name, (fwd, rev) in sides.items():
                w, at = len(fwd), 0
                plus, minus = (np.round(block_scores(joined, m, numbers)[0], 9) for m in (fwd, rev))
                both = np.maximum(plus, minus)
                for i, n in enumerate(lengths):
                    own = both[at : at + max(0, n - w + 1)]
                    if len(own) and own[best := int(own.argmax())] > -np.inf:
                        straight = plus[at + best] == own[best]
                        site = seqs[i][best : best + w].upper()
                        keep.append(i)
                        rows.append({"motif": name, "pos": best, "strand": "+" if straight else "-", "score": float(own[best]), "site": site if straight else site.translate(turn)[::-1]})
                    at += n + 1
            out = pa.RecordBatch.from_pylist(rows, kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *out.columns], names=["seq_id", *kinds.names])

    return corpus.select("seq_id", "seq").mapInArrow(run, f"seq_id {id_type}, motif string, pos long, strand string, score double, site string")


def site_counts(sites: DataFrame) -> DataFrame:
    """``(motif, pos, a, c, g, t)``: the letters of all sites of a motif at each of its places."""
    letters = sites.select("motif", F.posexplode(F.split("site", "")).alias("pos", "b")).filter(F.col("b") != "")
    return letters.groupBy("motif", F.col("pos").cast("long").alias("pos")).agg(*[F.count_if(F.col("b") == b).alias(b.lower()) for b in BASES])


def logistic_facet(corpus: DataFrame, labels: DataFrame, pwms: list[np.ndarray], weights: list[float]) -> DataFrame:
    """``(seq_id, eta, p, log2_lik)`` of a logistic model of boolean labels ``(seq_id, label)``.

    ``eta`` is the weighted sum, over motifs, of a sequence's log2 sum of window likelihoods
    over the uniform background's; a sequence shorter than the motif adds nothing. All motifs
    are scored in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            joined, lengths = _side_by_side(batch.column(1).to_pylist())
            numbers, eta = window_codes(joined), np.zeros(len(lengths))
            for pwm, weight in zip(pwms, weights, strict=True):
                score, at = block_scores(joined, np.asarray(pwm, float), numbers)[0], 0
                for i, n in enumerate(lengths):
                    own = score[at : at + max(0, n - len(pwm) + 1)]
                    if len(own) and (top := own.max()) > -np.inf:
                        eta[i] += weight * (top + np.log2(np.exp2(own - top).sum()) + 2.0 * len(pwm))
                    at += n + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(eta)], names=["seq_id", "eta"])

    kind = corpus.schema["seq_id"].dataType.simpleString()
    out = corpus.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, eta double")
    p = 1 / (1 + F.exp(-F.col("eta")))
    return out.join(labels, "seq_id").withColumn("p", p).withColumn("log2_lik", F.log2(F.when(F.col("label"), F.col("p")).otherwise(1 - F.col("p"))))


def sum_facets(*facets: DataFrame) -> DataFrame:
    """``(seq_id, log2_lik)``: the sum over facets ``(seq_id, log2_lik)`` of each datum; a facet without the datum adds nothing."""
    every = reduce(DataFrame.unionByName, [f.select("seq_id", "log2_lik") for f in facets])
    return every.groupBy("seq_id").agg(F.sum("log2_lik").alias("log2_lik"))


def group_contributions(contributions: DataFrame, components: DataFrame) -> DataFrame:
    """``(seq_id, grp, n, total)``: what the components of each group contribute to a datum, weighted.

    ``contributions`` is ``(seq_id, component, value)`` and ``components`` ``(component, grp, weight)``: a
    model's facets by group. A component may be in several groups; one in no group counts in
    none, and a null weight counts 1. Nulls are left out of both.
    """
    rows = contributions.filter("component is not null and value is not null").join(components.filter("component is not null"), "component")
    return rows.groupBy("seq_id", "grp").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.coalesce("weight", F.lit(1.0))).alias("total"))


def register(spark: SparkSession, pwm: np.ndarray, name: str = "pwm_scan", both_strands: bool = True) -> None:
    """Make a motif's best window score of a sequence available to SQL text; null where no window is known."""
    fwd, rev = np.asarray(pwm, float), reverse(pwm)

    @F.pandas_udf("double")
    def best(seqs: pd.Series) -> pd.Series:
        def one(s: str | None) -> float | None:
            x = encode(s or "")[None, :]
            score = block_scores(x, fwd)
            score = np.maximum(score, block_scores(x, rev)) if both_strands else score
            top = score.max(initial=-np.inf)
            return float(top) if top > -np.inf else None

        return pd.Series([one(s) for s in seqs], dtype="float64")

    spark.udf.register(name, best)
