"""Comparing motifs: every query motif against all others.

Each query meets each other motif, so the work is their product. A cell of it, a block of queries
and a part of the others, is scored as products of matrices, which round otherwise than the
measure does: so a cell gives all that may be a query's best, hardly ever more than one, and
the measure itself decides among those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: At most so many query motifs, of so many bytes in all, are broadcast; beyond that, blocks meet parts of the others.
BLOCK, BLOCK_BYTES = 2000, 16 << 20

#: Motifs of either side that a cell holds, and scores that it works on at a time.
CELL, SCORES = 8192, 2_000_000
#: Numbers within these bounds are multiplied without overflow.
SMALLEST, LARGEST = 1e-100, 1e100

Measure = Callable[[Column, Column], Column]


def _units(pwm: Column) -> Column:
    """Rows without their mean and of length 1, end to end, and a 1 for each row that isn't flat."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    def row(r: Column) -> Column:
        centred = F.transform(r, lambda x: x - total(r) / 4)
        norm = F.sqrt(total(F.transform(centred, lambda x: x * x)))
        return F.when(norm > 0, F.transform(centred, lambda x: x / norm)).otherwise(F.transform(r, lambda x: F.lit(0.0)))

    units = F.transform(pwm, row)
    return F.struct(F.flatten(units).alias("u"), F.transform(units, lambda r: (F.array_max(r) > 0).cast("double")).alias("f"))


def pearson(a: Column, b: Column) -> Column:
    """Mean correlation of rows, 0 if no two rows vary; ``a`` and ``b`` come from :func:`_units`."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    rows = dot(a["f"], b["f"])
    return F.when(F.size(a["f"]) == F.size(b["f"]), F.when(rows > 0, dot(a["u"], b["u"]) / rows).otherwise(0.0))


def either_strand(a: Column, b: Column) -> Column:
    """The better of the mean correlations with a motif and with its other strand; null if lengths differ. Both come from :func:`_units`."""
    return F.greatest(pearson(a, b), pearson(a, F.struct(F.reverse(b["u"]).alias("u"), F.reverse(b["f"]).alias("f"))))


#: What a measure wants to know of each motif, worked out once a motif rather than once a pair.
PREPARE: dict[Measure, Callable[[Column], Column]] = {pearson: _units, either_strand: _units}


def euclidean(a: Column, b: Column) -> Column:
    """Negative, so that the nearest is the largest; null if lengths differ."""
    total = F.aggregate(F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), -F.sqrt(total))


def shorter(a: Column, b: Column) -> Column:
    """Negative Frobenius distance over the shorter of two lengths."""
    n = F.least(F.size(a), F.size(b))
    return euclidean(F.slice(a, 1, n), F.slice(b, 1, n))


def kullback_leibler(a: Column, b: Column) -> Column:
    """Negative divergence of ``a`` from ``b``; terms with a = 0 are 0; null if lengths differ."""
    terms = F.zip_with(F.flatten(a), F.flatten(b), lambda p, q: F.when(p > 0, p * F.log2(p / q)).otherwise(0.0))
    return F.when(F.size(a) == F.size(b), -F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def pairs(asked: DataFrame, motifs: DataFrame, parts: int = 64) -> DataFrame:
    """``(query_id, a, other_id, b)``: each of ``asked`` with all of ``motifs`` but itself; both are ``(motif_id, pwm)``.

    Query motifs beyond one block are dealt into blocks; each block meets each part of the
    motifs in a task of its own, so no side has to fit in memory.
    """
    q = asked.select(F.col("motif_id").alias("query_id"), F.col("pwm").alias("a"))
    o = motifs.select(F.col("motif_id").alias("other_id"), F.col("pwm").alias("b"))
    sizes = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("pwm"))).cast("long")).alias("b")).first()
    n, total = sizes["n"], sizes["b"] or 0
    apart = F.col("query_id") != F.col("other_id")
    if n <= BLOCK and total <= BLOCK_BYTES:
        # Few bytes of motifs make much work, so they are dealt out first.
        return o.repartition(parts, "other_id").join(F.broadcast(q), apart)
    blocks = max(-(-n // BLOCK), min(n, -(-total // BLOCK_BYTES)))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    o = o.withColumn("part", F.pmod(F.xxhash64("other_id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return q.join(o, (q["block"] == o["block"]) & (q["part"] == o["part"]) & apart).drop("block", "part")


#: Motifs of one length as rows: their numbers end to end and, of units, which rows aren't flat.
Rows = tuple[np.ndarray, np.ndarray]
EPS = float(np.finfo(float).eps)


def _rough_pearson(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    (u, f), (v, g) = a, b
    rows = float(f.shape[1]) if f.all() and g.all() else np.maximum(f @ g.T, 1.0)
    return u @ v.T / rows, np.full(len(u), 16 * EPS * (u.shape[1] + 4))


def _rough_either(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    score, slack = _rough_pearson(a, b)
    return np.maximum(score, _rough_pearson(a, (b[0][:, ::-1], b[1][:, ::-1]))[0]), slack


def _rough_euclidean(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    (u, _), (v, _) = a, b
    own, other = (u * u).sum(axis=1), (v * v).sum(axis=1)
    square = own[:, None] + other - 2 * (u @ v.T)
    error = 16 * EPS * (u.shape[1] + 4) * (np.sqrt(own) + np.sqrt(other.max(initial=0.0))) ** 2
    # The root of a number that is off by so much is off by no more than the root of that.
    return -np.sqrt(np.maximum(square, 0.0)), np.sqrt(error)


def _rough_divergence(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    p, logs = np.maximum(a[0], 0.0), np.log2(b[0])
    own = p * np.log2(np.where(p > 0, p, 1.0))
    slack = 16 * EPS * (p.shape[1] + 4) * (np.abs(own).sum(axis=1) + p.sum(axis=1) * np.abs(logs).max(initial=0.0))
    return p @ logs.T - own.sum(axis=1)[:, None], slack


#: Scores of all pairs as products of matrices, and by how much a query's may be off.
ROUGH: dict[Measure, Callable[[Rows, Rows], tuple[np.ndarray, np.ndarray]]] = {
    pearson: _rough_pearson, either_strand: _rough_either, euclidean: _rough_euclidean, shorter: _rough_euclidean, kullback_leibler: _rough_divergence,
}


def _near(u: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative distances of some pairs by their differences, which are hardly off."""
    out = np.empty(len(r))
    size = max(1, SCORES // max(1, u.shape[1]))
    for lo in range(0, len(r), size):
        out[lo : lo + size] = -np.sqrt(((u[r[lo : lo + size]] - v[c[lo : lo + size]]) ** 2).sum(axis=1))
    return out, -out * (16 * EPS * (u.shape[1] + 4))


def _may_win(r: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which candidates ``c``, in the order of ids, may be the best of ``r``: their rounded values are ``lo`` to ``hi``.

    Of those whose value is sure, only the best counts, the first of equals; any other counts if it may be as good.
    """
    order = np.lexsort((c, -lo, r))
    first = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])] if len(r) else order
    least = np.full(r.max(initial=-1) + 1, -np.inf)
    least[r[first]] = lo[first]
    sure = lo == hi
    keep = (hi >= least[r]) & ~sure
    known = np.flatnonzero(sure & (lo == least[r]))
    known = known[np.lexsort((c[known], r[known]))]
    keep[known[np.concatenate([[True], r[known][1:] != r[known][:-1]])] if len(known) else known] = True
    return keep


def _lengths(table: pa.Table) -> Iterator[tuple[int, np.ndarray, Rows]]:
    """``(positions, places, rows)`` of a cell's motifs by length."""
    n = table["n"].to_numpy()
    order = np.argsort(n, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(order) else []:
        v, f = (table[k].take(pa.array(own)).combine_chunks().flatten().to_numpy() for k in ("v", "f"))
        yield int(n[own[0]]), own, (v.reshape(len(own), len(v) // len(own)), f.reshape(len(own), len(f) // len(own)))


def _cell(measure: Measure, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    rough, scale, distances = ROUGH[measure], 10.0**digits, measure in (euclidean, shorter)
    any_length = measure is shorter

    def run(asked: pa.Table, motifs: pa.Table) -> pa.Table:
        motifs = motifs.sort_by("other_id")
        places: dict = {}
        for i, x in enumerate(motifs["other_id"].to_pylist()):
            places.setdefault(x, []).append(i)
        own = [places.get(x, []) for x in asked["query_id"].to_pylist()]
        found: list[list[np.ndarray]] = [[], [], [], []]
        others = list(_lengths(motifs))
        for n, qs, (qv, qf) in _lengths(asked):
            for m, os, (ov, of) in others:
                if m != n and not any_length:
                    continue
                wide = 4 * min(n, m)
                b = ov[:, :wide], of
                at = np.full(motifs.num_rows, -1)
                at[os] = np.arange(len(os))
                step = max(1, SCORES // len(os))
                for lo in range(0, len(qs), step):
                    q = qs[lo : lo + step]
                    a = qv[lo : lo + step, :wide], qf[lo : lo + step]
                    score, slack = rough(a, b)
                    for i, x in enumerate(q):
                        for j in own[x]:
                            if at[j] >= 0:
                                score[i, at[j]] = -np.inf
                    top = score.max(axis=1)
                    r, c = np.nonzero((score >= (top - 1.01 / scale - 4 * slack)[:, None]) & (score > -np.inf))
                    value, off = _near(a[0], b[0], r, c) if distances else (score[r, c], slack[r])
                    off = off + 4 * EPS * np.abs(value)
                    low, high = (np.floor((value + d) * scale + 0.5) for d in (-off, off))
                    keep = _may_win(r, os[c], low, high)
                    for held, x in zip(found, (q[r], os[c], low, high), strict=True):
                        held.append(x[keep])
        r, c, low, high = (np.concatenate(x) if x else np.empty(0, int) for x in found)
        keep = _may_win(r, c, low, high)
        both = [(k, t[k].take(pa.array(i[keep]))) for t, i, names in ((asked, r, ("query_id", "a")), (motifs, c, ("other_id", "b"))) for k in names]
        return pa.table([x for _, x in both], names=[k for k, _ in both])

    return run


def _numbers(motifs: DataFrame, measure: Measure) -> DataFrame:
    """Prepared motifs with their positions ``n``, numbers ``v`` end to end, flags ``f``, and whether matrices may score them."""
    units = measure in (pearson, either_strand)
    x = F.col("pwm")
    v = x["u"] if units else F.flatten(x)
    n = F.size(x["f"] if units else x)
    f = x["f"] if units else F.array().cast("array<double>")
    small = F.lit(SMALLEST if measure is kullback_leibler else 0.0)
    known = lambda y: F.coalesce((F.abs(y) <= LARGEST) & ~F.isnan(y), F.lit(False))
    fine = F.coalesce((n > 0) & (F.size(v) == 4 * n) & F.forall(v, lambda y: known(y) & (y.isNull() | (F.abs(y) >= small) | (y == 0))), F.lit(False))
    if not units:
        fine = fine & F.coalesce(F.forall(x, lambda r: F.size(r) == 4), F.lit(False))
    # A divergence from nothing is not a number.
    whole = F.coalesce(F.forall(v, lambda y: y > 0), F.lit(False)) if measure is kullback_leibler else F.lit(True)
    return motifs.filter("motif_id is not null").select("motif_id", "pwm", n.alias("n"), v.alias("v"), f.alias("f"), fine.alias("fine"), (fine & whole).alias("whole"))


def candidates(asked: DataFrame, motifs: DataFrame, measure: Measure, digits: int = 6) -> DataFrame:
    """``(query_id, a, other_id, b)``: pairs among which each query's best match is, of prepared ``(motif_id, pwm)``.

    Of motifs that are alike to the last bit the two first ids stand for all. Motifs with numbers
    that products of matrices can't take, such as null or infinite ones, meet all others by :func:`pairs`.
    """
    q, o = _numbers(asked, measure), _numbers(motifs, measure)
    count = lambda df, flag: df.agg(F.count_if(flag).alias("n"), F.count_if(~F.col(flag)).alias("odd"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("b")).first()
    asks, has = count(q, "fine"), count(o, "whole")
    blocks, parts = (max(1, -(-x["n"] // CELL), -(-8 * x["b"] // BLOCK_BYTES)) for x in (asks, has))
    first = F.dense_rank().over(W.partitionBy("pwm").orderBy("motif_id")) <= 2
    # Names of their own, as both sides may come from one table.
    asking, kinds = ["query_id", "a", "n", "v", "f"], ["other_id", "b", "n", "v", "f"]
    left = q.filter("fine").select(F.col("motif_id").alias("query_id"), F.col("pwm").alias("a"), "n", "v", "f", F.pmod(F.xxhash64("motif_id"), F.lit(blocks)).alias("block"))
    right = o.filter("whole").withColumn("first", first).filter("first").select(F.col("motif_id").alias("other_id"), F.col("pwm").alias("b"), "n", "v", "f", F.pmod(F.xxhash64("motif_id"), F.lit(parts)).alias("part"))
    left = left.select(*asking, F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.col("block") * parts + p)).alias("cell"))
    right = right.select(*kinds, F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * parts + F.col("part"))).alias("cell"))
    kind = {k: asked.schema["pwm"].dataType for k in ("a", "b")} | {k: asked.schema["motif_id"].dataType for k in ("query_id", "other_id")}
    schema = StructType([StructField(k, kind[k]) for k in ("query_id", "a", "other_id", "b")])
    left, right = (df.repartition(blocks * parts, "cell") for df in (left, right))
    found = [left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell(measure, digits), schema)]
    plain = lambda df: df.select("motif_id", "pwm")
    if asks["odd"]:
        found.append(pairs(plain(q.filter("not fine")), plain(o)))
    if has["odd"] and asks["n"]:
        found.append(pairs(plain(q.filter("fine")), plain(o.filter("not whole"))))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df.select(*out.columns))
    return out


def best_matches(asked: DataFrame, motifs: DataFrame, measure: Measure, digits: int = 6) -> DataFrame:
    """``(query_id, other_id, value)``: each query's best match, ties to the smaller id; the value is rounded first.

    Only each task's best is shuffled. Motifs without one of equal length have no row. A measure of
    one's own is worked out for all pairs.
    """
    ready = PREPARE.get(measure, lambda pwm: pwm)(F.col("pwm"))
    asked, motifs = (df.select("motif_id", ready.alias("pwm")) for df in (asked, motifs))
    some = candidates(asked, motifs, measure, digits) if measure in ROUGH else pairs(asked, motifs)
    each = some.select("query_id", "other_id", F.round(measure(F.col("a"), F.col("b")), digits).alias("value")).filter("value is not null")
    best = each.groupBy("query_id").agg(F.min(F.struct((-F.col("value")).alias("v"), "other_id")).alias("x"))
    return best.select("query_id", "x.other_id", (-F.col("x.v")).alias("value"))
