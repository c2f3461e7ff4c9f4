"""Position weight matrices as columns and as NumPy arrays.

A motif column is an array with a row of four numbers (A, C, G, T) for each position. In NumPy
it is an array of shape (length, 4).
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.bases import BASES

# IUPAC letters and the bases they stand for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
FLOOR = 1e-10


def kmer_to_pwm(kmer: str, pseudocount: float = 0.1) -> np.ndarray:
    """log2 probabilities: 1 - 3p for the k-mer's base, p for the others; an unknown letter is uniform."""
    out = np.full((len(kmer), 4), 0.25)
    for i, c in enumerate(kmer.upper()):
        if c in BASES:
            out[i] = pseudocount
            out[i, BASES.index(c)] = 1 - 3 * pseudocount
    return np.log2(out + FLOOR)


def kmer_pwm_column(kmer: Column, pseudocount: float = 0.1) -> Column:
    """:func:`kmer_to_pwm` of a column of k-mers."""
    hit, miss, flat = (float(np.log2(x + FLOOR)) for x in (1 - 3 * pseudocount, pseudocount, 0.25))
    cell = lambda c, b: F.when(c == b, hit).when(c.isin(*BASES), miss).otherwise(flat)
    letters = F.array_remove(F.split(F.upper(kmer), ""), "")
    return F.transform(letters, lambda c: F.array(*[cell(c, b) for b in BASES]))


def iupac_pwm(consensus: str, noise: float = 0.05) -> np.ndarray:
    """Probabilities of an IUPAC consensus, mixed with ``noise`` of the uniform; unknown letters are uniform."""
    rows = []
    for c in consensus.upper():
        of = IUPAC.get(c, BASES)
        rows.append([(b in of) / len(of) * (1 - noise) + noise / 4 for b in BASES])
    return np.array(rows).reshape(-1, 4)


def consensus_pwm(consensus: str, strength: float, how: str = "strength") -> np.ndarray:
    """Probabilities by one of three rules: ``strength`` 0.25 + 0.75 s, ``conserved`` c + (1 - c) / 4, ``sharp`` (log2) 0 or -10."""
    one = np.array([[b == c for b in BASES] for c in consensus.upper()], float).reshape(-1, 4)
    if how == "sharp":
        return np.where(one > 0, 0.0, -10.0)
    top = 0.25 + 0.75 * strength if how == "strength" else strength + (1 - strength) / 4
    return np.where(one > 0, top, (1 - top) / 3)


def from_counts(counts, pseudocount: float = 0.1) -> np.ndarray:
    """Probabilities by column of (length, 4) counts."""
    c = np.asarray(counts, float) + pseudocount
    if c.ndim != 2 or c.shape[1] != 4:
        raise ValueError("a motif has four numbers a position")
    return c / c.sum(axis=1, keepdims=True)


def reverse(pwm: np.ndarray) -> np.ndarray:
    """The other strand's motif."""
    return np.ascontiguousarray(np.asarray(pwm)[::-1, ::-1])


def consensus(pwm: np.ndarray) -> str:
    """The likeliest base of each position, ties to the first."""
    return "".join(BASES[i] for i in np.asarray(pwm).argmax(axis=1))


def information(prob: np.ndarray) -> float:
    """Bits, summed over positions."""
    p = np.asarray(prob, float)
    return float((2 + (p * np.log2(np.maximum(p, FLOOR))).sum(axis=1)).sum())


def perturb(p: np.ndarray) -> np.ndarray:
    """Probabilities from log2 ones, floored and normalised."""
    x = np.maximum(np.exp2(p), FLOOR)
    return x / x.sum(axis=-1, keepdims=True)


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over positions of the correlation of rows; positions without variance are left out, -1 if lengths differ."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        return -1.0
    x, y = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    den = np.sqrt((x**2).sum(axis=1) * (y**2).sum(axis=1))
    ok = den > 0
    return float(((x * y).sum(axis=1)[ok] / den[ok]).mean()) if ok.any() else 0.0


def distance(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Frobenius distance and mean correlation over the shorter length."""
    n = min(len(a), len(b))
    return float(np.sqrt(((np.asarray(a)[:n] - np.asarray(b)[:n]) ** 2).sum())), pearson(a[:n], b[:n])


def kullback_leibler(p: np.ndarray, q: np.ndarray) -> float:
    """Sum of p log2(p / q); terms with p = 0 are 0."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    at = p > 0
    return float((p[at] * np.log2(p[at] / q[at])).sum())


def either_strand(a: np.ndarray, b: np.ndarray) -> float:
    """The better correlation of ``a`` with ``b`` or its other strand."""
    return max(pearson(a, b), pearson(a, reverse(b)))


def greedy_pairs(found: list[np.ndarray], truth: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """One-to-one matching: each found motif in turn takes the best truth still free, of those with a correlation above -1."""
    free, out = set(range(len(truth))), []
    for i, a in enumerate(found):
        best = max(((either_strand(a, truth[j]), -j) for j in free), default=(-1.0, 0))
        if best[0] > -1:
            free.discard(-best[1])
            out.append((i, -best[1], best[0]))
    return out


def string_match(found: str, truth: str) -> float:
    """100 plus the length of the shorter if one string holds the other, else the ratio of matching blocks."""
    if found in truth or truth in found:
        return 100.0 + min(len(found), len(truth))
    return difflib.SequenceMatcher(None, found, truth).ratio()


@dataclass
class GappedPattern:
    """Blocks of probabilities with ranges of gap lengths between them, such as ``ACGT[5-10]TGCA``."""

    blocks: list[np.ndarray]
    gaps: list[tuple[int, int]] = field(default_factory=list)
    name: str = ""

    @classmethod
    def parse(cls, text: str, noise: float = 0.05) -> GappedPattern:
        parts = re.split(r"\[(\d+)(?:-(\d+))?\]", text.upper())
        gaps = [(int(a), int(b or a)) for a, b in zip(parts[1::3], parts[2::3], strict=True)]
        return cls([iupac_pwm(b, noise) for b in parts[0::3]], gaps, text)

    @property
    def length(self) -> int:
        """Least span."""
        return sum(map(len, self.blocks)) + sum(lo for lo, _ in self.gaps)

    def pwm(self) -> np.ndarray:
        """Blocks joined by uniform columns, as many as each gap's mean length."""
        out = [self.blocks[0]]
        for (lo, hi), b in zip(self.gaps, self.blocks[1:], strict=True):
            out += [np.full(((lo + hi) // 2, 4), 0.25), b]
        return np.concatenate(out)

    def consensus(self) -> str:
        """Block consensus with gaps as ``[n]`` or ``[n-m]``."""
        out = consensus(self.blocks[0])
        for (lo, hi), b in zip(self.gaps, self.blocks[1:], strict=True):
            out += f"[{lo}]" if lo == hi else f"[{lo}-{hi}]"
            out += consensus(b)
        return out


# The same on columns of arrays of rows.
def column_consensus(pwm: Column) -> Column:
    return F.array_join(F.transform(pwm, lambda r: F.element_at(F.array(*map(F.lit, BASES)), F.array_position(r, F.array_max(r)).cast("int"))), "")


def column_dominant(prob: Column) -> Column:
    """The mean over positions of the likeliest base's chance."""
    return F.aggregate(prob, F.lit(0.0), lambda a, r: a + F.array_max(r)) / F.size(prob)


def column_perturb(log2_prob: Column) -> Column:
    """:func:`perturb` of a column."""
    floored = lambda r: F.transform(r, lambda x: F.greatest(F.pow(F.lit(2.0), x), F.lit(FLOOR)))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.transform(log2_prob, floored), lambda r: F.transform(r, lambda x: x / total(r)))


def column_information(prob: Column) -> Column:
    row = lambda r: 2 + F.aggregate(r, F.lit(0.0), lambda a, p: a + p * F.log2(F.greatest(p, F.lit(FLOOR))))
    return F.aggregate(F.transform(prob, row), F.lit(0.0), lambda a, x: a + x)


def column_from_counts(counts: Column, pseudocount: float = 0.1) -> Column:
    """:func:`from_counts` of a column of rows of four counts."""
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda r: F.transform(r, lambda x: (x + pseudocount) / (total(F.transform(r, lambda y: y + 0.0)) + 4 * pseudocount)))


def column_reverse(pwm: Column) -> Column:
    return F.reverse(F.transform(pwm, F.reverse))


def column_pearson(a: Column, b: Column) -> Column:
    """Mean over positions of the correlation of rows, null if lengths differ; flat positions are left out."""

    def one(x: Column, y: Column) -> Column:
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z)
        sx, sy = total(x), total(y)
        sxy = total(F.zip_with(x, y, lambda p, q: p * q))
        sxx, syy = total(F.transform(x, lambda p: p * p)), total(F.transform(y, lambda p: p * p))
        den = F.sqrt((sxx - sx * sx / 4) * (syy - sy * sy / 4))
        return F.when(den > 0, (sxy - sx * sy / 4) / den)

    each = F.filter(F.zip_with(a, b, one), lambda x: x.isNotNull())
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)
    return F.when(F.size(a) == F.size(b), F.when(F.size(each) > 0, mean).otherwise(0.0))
