"""Counts of k-mers of 12 to 31 bases, which are too many for tasks to sum before they are shuffled.

Windows next to each other mostly share their minimizer, the least m-mer in them by a hash, and
travel as one run of letters rather than as one string each. A window and its reverse complement
have the same minimizer, so all that one k-mer counts meets in one bucket of minimizers, where
windows are packed into two bits a base, counted, and turned to both strands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.likelihood import encode, portions

#: Bases of a minimizer; letters that one bucket holds, about.
M, BUCKET = 9, 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(codes: np.ndarray, k: int) -> np.ndarray:
    """The numbers, base 4, of all windows of ``k`` known bases."""
    out = np.zeros(max(len(codes) - k + 1, 0), np.uint64)
    for j in range(k):
        out = (out << np.uint64(2)) | codes[j : j + len(out)].astype(np.uint64)
    return out


def turned(numbers: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the reverse complements."""
    out = np.zeros_like(numbers)
    for j in range(k):
        out = (out << np.uint64(2)) | (np.uint64(3) - ((numbers >> np.uint64(2 * j)) & np.uint64(3)))
    return out


def spelt(numbers: np.ndarray, k: int) -> pa.Array:
    letters = np.empty((len(numbers), k), np.uint8)
    for j in range(k):
        letters[:, k - 1 - j] = np.frombuffer(b"ACGT", np.uint8)[(numbers >> np.uint64(2 * j)) & np.uint64(3)]
    offsets = np.arange(0, (len(numbers) + 1) * k, k, dtype=np.int64)
    return pa.LargeStringArray.from_buffers(len(numbers), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())).cast(pa.string())


def _letters_at(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Upper-case letters of texts one after another, each followed by one that is unknown, and their codes."""
    letters = np.frombuffer("\n".join([*[t or "" for t in texts], ""]).upper().encode("latin-1", "replace"), np.uint8)
    return letters, encode(letters.tobytes())


def _whole(codes: np.ndarray, k: int) -> np.ndarray:
    """Where windows of ``k`` known bases begin."""
    bad = np.concatenate([[0], np.cumsum(codes < 0)])
    return bad[k:] == bad[:-k] if len(codes) >= k else np.zeros(0, bool)


def runs(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(minimizers, starts, ends)``: runs of letters, all known, whose windows of ``k`` share their minimizer; every such window is in one run."""
    whole = _whole(codes, k)
    if not whole.any():
        return (np.zeros(0, np.int64),) * 3
    own = packed(np.maximum(codes, 0), M)
    mixed = np.minimum(own, turned(own, M)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    least = mixed[: len(whole)].copy()
    for j in range(1, k - M + 1):
        np.minimum(least, mixed[j : j + len(whole)], out=least)
    first = np.flatnonzero(whole & np.concatenate([[True], (least[1:] != least[:-1]) | ~whole[:-1]]))
    # A run ends before the next one begins, or before the next window that isn't whole.
    stop = np.flatnonzero(np.concatenate([~whole, [True]]))
    last = np.minimum(np.concatenate([first[1:], [len(whole)]]), stop[np.searchsorted(stop, first)])
    return (least[first] & np.uint64((1 << 62) - 1)).astype(np.int64), first, last + k - 1


def super_kmers(pieces: DataFrame, k: int) -> DataFrame:
    """``(minimizer, run, n)`` of sequences ``(seq)``: runs of windows, equal ones of a batch counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            letters, codes = _letters_at(batch.column(0).to_pylist())
            least, start, end = runs(codes, k)
            sizes = end - start
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            # The letters of all runs end to end.
            own = letters[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)]
            text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own.tobytes())).cast(pa.string())
            found = pa.table([pa.array(least), text], names=["minimizer", "run"]).group_by(["minimizer", "run"]).aggregate([([], "count_all")])
            yield from found.rename_columns(["minimizer", "run", "n"]).to_batches()

    return pieces.select("seq").mapInArrow(run, "minimizer long, run string, n long")


def count(pieces: DataFrame, k: int, strands: int, letters: int) -> DataFrame:
    """``(kmer, cnt)`` of pieces that hold every window once, ``letters`` in all."""
    if not 12 <= k <= 31:
        raise ValueError("windows of 12 to 31 bases are packed")

    def bucket(table: pa.Table) -> pa.Table:
        texts = table["run"].to_pylist()
        _, codes = _letters_at(texts)
        numbers = packed(np.maximum(codes, 0), k)[_whole(codes, k)]
        times = np.repeat(table["n"].to_numpy(), [len(t) - k + 1 for t in texts])
        if strands == 2:
            numbers, times = np.concatenate([numbers, turned(numbers, k)]), np.concatenate([times, times])
        order = np.argsort(numbers, kind="stable")
        numbers, times = numbers[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        return pa.table([spelt(numbers[first], k), pa.array(np.add.reduceat(times, first), pa.int64())], names=["kmer", "cnt"])

    buckets = max(1, -(-letters // BUCKET))
    rows = super_kmers(pieces, k).select(F.pmod(F.xxhash64("minimizer"), F.lit(buckets)).alias("bucket"), "run", "n")
    # Few bytes of runs make much work, so buckets are not put together into fewer tasks; in a bucket equal runs meet first.
    runs_of = rows.repartition(min(buckets, 4096), "bucket").groupBy("bucket", "run").agg(F.sum("n").alias("n"))
    return runs_of.groupBy("bucket").applyInArrow(bucket, "kmer string, cnt long")
