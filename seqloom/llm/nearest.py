"""Nearest vectors through balanced posting lists.

A bounded sample is split in halves, the largest part first, into clusters of like sizes; their
centroids form a graph of relative neighbours that every task holds in memory. Each vector goes to
the list of its nearest centroid, and where it lies on a boundary to further lists too: those whose
centroid is about as near and stands apart from those of the lists it has gone to already. A query
looks at the lists whose centroid is at most ``ratio`` times as far as the nearest one. That ratio is
measured: some sampled vectors are compared with all others, and it is the least by which a set share
of their true neighbours is found. Lists and their queries meet in cells of bounded size, and what
several lists return is merged by exact distances.

Equal vectors are one entry of the index, with its smallest ids: a vector that a third of all rows
share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import arrow_bytes, lean, sized, stored, tidy

#: Bounds of the sample that the clusters are fitted to: vectors, and bytes of four-byte numbers.
SAMPLE, SAMPLE_BYTES = 16_000, 32 << 20
#: Vectors of the sample that are compared with all others to measure the ratio.
PROBES = 128
#: Entries for each cluster, most clusters, and sampled vectors for each at least.
LIST, CLUSTERS, LEAST = 256, 8_192, 4
#: Rounds that move the centroids after the splits.
ROUNDS = 8
#: A vector goes to at most so many lists, of centroids up to so many times as far as its nearest one.
#: each new centroid so many times further from the earlier ones than from the vector.
COPIES, EDGE, SPREAD = 2, 1.1, 0.3
#: Neighbours of a centroid in the graph, and centroids that a search for the nearest ones holds.
DEGREE, BEAM = 24, 12
#: Most entries and queries of a cell, about.
CELL = 4_096
#: Share of the probes' true neighbours that the ratio must reach.
RECALL = 0.97


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which of two clusters each row belongs to; neither gets less than a quarter of the rows."""
    centers = x[rng.choice(len(x), 2, replace=False)]
    quarter = len(x) // 4
    for _ in range(6):
        lean_to = ((x - centers[0]) ** 2).sum(axis=1) - ((x - centers[1]) ** 2).sum(axis=1)
        order = np.argsort(lean_to, kind="stable")
        first = int(np.clip((lean_to < 0).sum(), max(1, quarter), len(x) - max(1, quarter)))
        side = np.ones(len(x), bool)
        side[order[:first]] = False
        centers = np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)])
    return side


def clusters(x: np.ndarray, count: int) -> np.ndarray:
    """Centroids of ``count`` parts of like sizes (fewer where there are fewer rows): the largest part is split first."""
    rng = np.random.default_rng(20240607)
    parts = [np.arange(len(x))]
    while len(parts) < min(count, len(x)):
        at = max(range(len(parts)), key=lambda i: len(parts[i]))
        part = parts.pop(at)
        side = halves(x[part], rng)
        parts += [part[~side], part[side]]
    centers = np.stack([x[p].mean(axis=0) for p in parts])
    even = len(x) / len(parts)
    sizes = np.full(len(parts), even)
    for _ in range(ROUNDS):
        # to the nearest centroid, one of a large part counting as further away
        to = np.concatenate([((centers**2).sum(axis=1) - 2 * y @ centers.T + weight).argmin(axis=1) for y, weight in _weighed(x, centers, sizes / even)])
        sizes = np.bincount(to, minlength=len(parts)).astype(float)
        sums = np.zeros_like(centers)
        np.add.at(sums, to, x)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def _weighed(x: np.ndarray, centers: np.ndarray, fill: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the rows, with what is added to squared distances: up to a tenth of their spread for each full size above the even one."""
    spread = float(((x[:1_000] - x.mean(axis=0)) ** 2).sum(axis=1).mean())
    weight = 0.1 * spread * np.maximum(fill - 1, 0)
    for i in range(0, len(x), 4_096):
        yield x[i : i + 4_096], weight


class Graph:
    """Centroids and their neighbours: an edge to a near one is left out where a kept neighbour is nearer to it, up to DEGREE edges, and all are reachable from the first."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers.astype(np.float32)
        self.norms = (self.centers**2).sum(axis=1)
        n = len(centers)
        links: list[list[int]] = []
        for i in range(0, n, 512):
            apart = self._apart(self.centers[i : i + 512])
            apart[np.arange(len(apart)), np.arange(i, i + len(apart))] = np.inf
            near = np.argsort(apart, axis=1, kind="stable")[:, : min(n - 1, 3 * DEGREE)]
            for row, order in zip(apart, near, strict=True):
                between = self._apart(self.centers[order])[:, order] if len(order) else None
                kept: list[int] = []
                for j in range(len(order)):
                    if len(kept) < DEGREE and (not kept or between[j, kept].min() > row[order[j]]):
                        kept.append(j)
                # few are kept where all are about as far: the nearest others fill up half
                kept += [j for j in range(len(order)) if j not in kept][: max(0, DEGREE // 2 - len(kept))]
                links.append([int(order[j]) for j in kept])
        self._join(links)
        self.near = np.full((n, max(map(len, links), default=0)), -1, np.int64)
        for i, found in enumerate(links):
            self.near[i, : len(found)] = found

    def _apart(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(axis=1)[:, None] + self.norms - 2 * x @ self.centers.T, 0)

    def _join(self, links: list[list[int]]) -> None:
        """Link what can't be reached to the nearest reached centroid, both ways."""
        reached = np.zeros(len(links), bool)
        queue = [0]
        while True:
            while queue:
                i = queue.pop()
                if not reached[i]:
                    reached[i] = True
                    queue += links[i]
            if reached.all():
                return
            i = int(np.flatnonzero(~reached)[0])
            apart = np.where(reached, self._apart(self.centers[i : i + 1])[0], np.inf)
            j = int(apart.argmin())
            links[j].append(i)
            links[i].append(j)
            queue = [i]

    def _met(self, x: np.ndarray, own: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of rows of ``x`` to the centroids ``at``, in parts that fit a cache."""
        out = np.empty(len(rows), np.float32)
        for i in range(0, len(rows), 16_384):
            r, c = rows[i : i + 16_384], at[i : i + 16_384]
            out[i : i + 16_384] = own[r] + self.norms[c] - 2 * np.einsum("ij,ij->i", x[r], self.centers[c])
        return np.maximum(out, 0, out=out)

    @property
    def _starts(self) -> np.ndarray:
        # the clusters were split in halves, so evenly spaced ones lie in different parts
        return np.unique(np.linspace(0, len(self.centers) - 1, min(len(self.centers), 8)).astype(int))

    def nearest(self, x: np.ndarray, width: int = BEAM, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """``(distances, centroids)``, nearest first, that a walk over the graph finds for each row of ``x``.

        All rows walk at once. A row holds its ``width`` nearest centroids so far and leaves the
        ``step`` nearest of them that it hasn't left, until none is left.
        """
        x = x.astype(np.float32)
        own, m = (x**2).sum(axis=1), len(x)
        starts, each = self._starts, np.arange(m)[:, None]
        ids = np.tile(starts, (m, 1))
        d = np.maximum(own[:, None] + self.norms[starts] - 2 * x @ self.centers[starts].T, 0)
        left, seen = np.zeros(ids.shape, bool), np.zeros((m, len(self.centers)), bool)
        seen[:, starts] = True
        while True:
            open_ = np.where(left, np.inf, d)
            at = np.argpartition(open_, min(step, open_.shape[1]) - 1, axis=1)[:, :step]
            live = np.take_along_axis(open_, at, axis=1) < np.inf
            if not live.any():
                order = np.argsort(d, axis=1, kind="stable")
                return np.sqrt(np.take_along_axis(d, order, axis=1)), np.take_along_axis(ids, order, axis=1)
            np.put_along_axis(left, at, True, axis=1)
            new = np.where(live[:, :, None], self.near[np.take_along_axis(ids, at, axis=1)], -1).reshape(m, -1)
            new.sort(axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[each, new]
            rows, cols = np.nonzero(fresh)
            seen[rows, new[rows, cols]] = True
            far = np.full(new.shape, np.inf, np.float32)
            far[rows, cols] = self._met(x, own, rows, new[rows, cols])
            ids, d, left = np.hstack([ids, new]), np.hstack([d, far]), np.hstack([left, ~fresh])
            keep = np.argpartition(d, min(width, d.shape[1]) - 1, axis=1)[:, :width]
            ids, d, left = (np.take_along_axis(v, keep, axis=1) for v in (ids, d, left))

    def lists(self, x: np.ndarray) -> list[list[int]]:
        """The lists that each row of ``x`` goes to, the nearest centroid's first."""
        out = []
        for i in range(0, len(x), 1_024):
            d, ids = self.nearest(x[i : i + 1_024])
            may = d <= EDGE * d[:, :1]
            apart = ((self.centers[ids] - self.centers[ids[:, :1]]) ** 2).sum(axis=2) > (SPREAD * d) ** 2
            for row, near, ok in zip(d.tolist(), ids, may & apart, strict=True):
                kept = [int(near[0])]
                for j in np.flatnonzero(ok):
                    if len(kept) == COPIES:
                        break
                    if len(kept) < 2 or ((self.centers[kept] - self.centers[near[j]]) ** 2).sum(axis=1).min() > (SPREAD * row[j]) ** 2:
                        kept.append(int(near[j]))
                out.append(kept)
        return out

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances from rows of ``x`` to the centroids that a walk meets which leaves every one up to ``ratio`` times as far as the nearest; infinite for the others."""
        x = x.astype(np.float32)
        own, n = (x**2).sum(axis=1), len(self.centers)
        d, ids = self.nearest(x)
        found = np.full((len(x), n), np.inf, np.float32)
        np.put_along_axis(found, ids, d * d, axis=1)
        left = np.zeros(found.shape, bool)
        while True:
            todo = (found <= ratio * ratio * found.min(axis=1, keepdims=True)) & ~left
            rows, at = np.nonzero(todo)
            if not len(rows):
                return np.sqrt(found)
            left |= todo
            near = self.near[at]
            rows = np.repeat(rows, near.shape[1])[(near >= 0).ravel()]
            near = near[near >= 0]
            fresh = found[rows, near] == np.inf
            code = np.unique(rows[fresh] * n + near[fresh])
            rows, near = code // n, code % n
            found[rows, near] = self._met(x, own, rows, near)

    def within(self, x: np.ndarray, ratio: float) -> Iterator[np.ndarray]:
        """For each row of ``x`` the lists of the centroids at most ``ratio`` times as far as the nearest."""
        for i in range(0, len(x), 256):
            found = self.search(x[i : i + 256], ratio)
            yield from (np.flatnonzero(row <= ratio * row.min()) for row in found)


def least(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(distances, positions in x)`` of the ``k`` rows of ``x`` nearest to ``q``, exact, ties by id.

    ``x`` holds those that a faster product can't rule out, ``ids`` their ids.
    """
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))[:k]
    return d[order], order


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``q``: ``(distances, positions in x)`` of its ``k`` nearest rows of ``x``."""
    xx, qq = (x**2).sum(axis=1), (q**2).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(x)))
    for i in range(0, len(q), step):
        rough = xx + qq[i : i + step, None] - 2 * q[i : i + step] @ x.T
        slack = 4e-16 * (x.shape[1] + 8) * (np.sqrt(xx.max()) + np.sqrt(qq[i : i + step])) ** 2
        bound = (np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(rough), np.inf)) + 2 * slack
        for j, row in enumerate(rough):
            may = np.flatnonzero(row <= bound[j])
            d, order = least(q[i + j], x[may], ids[may], k)
            yield d, may[order]


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec, h1, h2)`` of the rows that take part; h1 and h2 are a hash of the vector."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def _fit(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, v) for b in batches for i, v in zip(b.column(0).to_pylist(), _matrix(b.column(1)), strict=True)]
        if rows:
            centers = clusters(np.stack([v for _, v in sorted(rows, key=lambda r: r[0])]), count)
            yield pa.RecordBatch.from_pydict({"no": list(range(len(centers))), "center": [c.tolist() for c in centers]})

    return run


def _true(q: np.ndarray, own: np.ndarray, k: int):
    """The ``k`` nearest rows of a task to each probe but itself: ``(probe, d, id, vec)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in q]
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if len(ids):
                for p, (d, at) in enumerate(best(q, x, ids, k + 1)):
                    more = [(dist, int(ids[j]), x[j].tolist()) for dist, j in zip(d.tolist(), at, strict=True) if ids[j] != own[p]]
                    held[p] = sorted([*held[p], *more])[:k]
        rows = [{"probe": p, "d": d, "id": i, "vec": v} for p, found in enumerate(held) for d, i, v in found]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("probe", pa.int64()), ("d", pa.float64()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))]))

    return run


def measured_ratio(base: DataFrame, probes: DataFrame, graph: Graph, k: int, recall: float = RECALL) -> float:
    """The least ratio of distances within which the lists of ``recall`` of the true ``k`` nearest of all ``probes`` lie."""
    rows = sorted(probes.select("id", "vec").collect())
    if not rows:
        return 1.0
    own, q = np.array([r["id"] for r in rows]), np.array([r["vec"] for r in rows], np.float64)
    found = base.select("id", "vec").mapInArrow(lean(_true(q, own, k)), "probe long, d double, id long, vec array<double>")
    order = W.partitionBy("probe").orderBy("d", "id")
    true = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("probe", "vec").collect()
    if not true:
        return 1.0
    at, x = np.array([r["probe"] for r in true]), np.array([r["vec"] for r in true])
    apart = np.sqrt(graph._apart(q.astype(np.float32)))
    need = [apart[p, c].min() / max(apart[p].min(), 1e-30) for p, c in zip(at, graph.lists(x), strict=True)]
    return max(1.0, float(np.quantile(need, recall, method="higher"))) * (1 + 1e-5)


def _posted(graph: Graph, vectors: bool = True, ratio: float = 1.0):
    """Rows ``(list, id, vec)``: entries in their lists, or queries in those they look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                found = graph.lists(x) if vectors else list(graph.within(x, ratio))
                sizes = [len(f) for f in found]
                for i in range(0, len(found), 128):
                    rows = np.repeat(np.arange(i, min(i + 128, len(found))), sizes[i : i + 128])
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[i : i + 128]), pa.int64()), part.column(0), part.column(1)], names=["list", "id", "vec"])

    return run


def _counted(graph: Graph):
    """How many entries of a task go to each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(graph.centers), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.concatenate(graph.lists(_matrix(batch.column(0)))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["list", "n"])

    return run


def _cell(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        ids, own = entries["id"].to_numpy(), queries["id"].to_numpy()
        out = []
        if len(ids) and len(own):
            for q, (d, at) in zip(own.tolist(), best(_matrix(queries["vec"]), _matrix(entries["vec"]), ids, k), strict=True):
                out.append({"q": q, "found": [{"d": a, "id": b} for a, b in zip(d.tolist(), ids[at].tolist(), strict=True)]})
        return pa.Table.from_pylist(out, pa.schema([("q", pa.int64()), ("found", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))]))

    return run


_FOUND = "q long, found array<struct<d:double,id:long>>"


def _meet(entries: DataFrame, queries: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``(q, found)``: the ``k`` nearest entries of each query over the lists ``(list, id, vec)`` that both are in.

    ``counts`` has the entries of each list. A long list is dealt into blocks, and so are the queries of one that many look at; each
    block of entries meets each block of queries.
    """
    sizes = counts.join(queries.groupBy("list").agg(F.count("*").alias("m")), "list")
    parts = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    sizes = sized(stored(sizes.select("list", parts("n").alias("n"), parts("m").alias("m")), "sizes"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = entries.join(sizes, "list").select("list", part("id", "n").alias("i"), every("m").alias("j"), "id", "vec")
    b = queries.join(sizes, "list").select("list", every("n").alias("i"), part("id", "m").alias("j"), "id", "vec")
    return a.groupBy("list", "i", "j").cogroup(b.groupBy("list", "i", "j")).applyInArrow(_cell(k), _FOUND)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """``(q, found)``: the ``k`` least of the distinct entries of each query's arrays ``(q, found)``.

    Sorted first, as telling apart all pairs of an array takes the square of its length.
    """
    in_order = rows.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("all"))
    return in_order.select("q", F.slice(F.filter("all", lambda x, i: (i == 0) | (x != F.get(F.col("all"), i - 1))), 1, k).alias("found"))


def _of_one_length(base: DataFrame, asked: DataFrame, k: int, recall: float) -> DataFrame:
    """``(q, found)`` for vectors of one length: the ``k`` nearest entries of each asked id, itself included."""
    n, length = base.agg(F.count("*"), F.max(F.size("vec"))).first()
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * length)))
    share = lambda count: F.pmod(F.col("h1"), F.lit(1 << 40)) < int(min(1.0, count / n) * (1 << 40))
    sample = base.filter(share(size * 0.95 if n > size else n)).select("id", "vec")
    count = max(1, min(-(-n // LIST), CLUSTERS, min(n, size) // LEAST))
    fitted = sorted(sample.repartition(1).mapInArrow(lean(_fit(count)), "no long, center array<double>").collect())
    graph = Graph(np.array([r["center"] for r in fitted], np.float64))
    ratio = measured_ratio(base, base.filter(share(PROBES)), graph, k - 1, recall)
    kinds = f"list long, id long, vec {base.schema['vec'].dataType.simpleString()}"
    # Lists are counted first rather than stored: that would write every vector once more for each of its lists.
    counts = base.select("vec").mapInArrow(lean(_counted(graph)), "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    entries = base.select("id", "vec").mapInArrow(lean(_posted(graph)), kinds)
    queries = stored(base.join(sized(asked), "id", "left_semi").select("id", "vec").mapInArrow(lean(_posted(graph, False, ratio)), kinds), "queries")
    return _top(_meet(entries, queries, counts, k), k)


@tidy
def nearest(table: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows to each row whose id is divisible by ``every``.

    Score is the Euclidean distance in double precision, ties go to the smaller id, the query
    itself is left out; all are returned where there are fewer. The search is approximate:
    about ``recall`` of the true neighbours are found. Vectors that are null, zero or hold a null
    or non-finite component take no part, nor do rows without id; vectors are near only to those of
    their length. Rows of one id are one: of several vectors the first by their hash counts. An
    empty table gives an empty result.
    """
    with arrow_bytes(table.sparkSession):
        return _nearest(table, k, every, recall, id_col, vec_col)


def _nearest(table: DataFrame, k: int, every: int, recall: float, id_col: str, vec_col: str) -> DataFrame:
    rows = usable(table, id_col, vec_col)
    marks = stored(rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"), F.max(F.struct("h1", "h2")).alias("other")).select("id", "h.h1", "h.h2", (F.col("h") != F.col("other")).alias("odd")), "marks")
    odd = marks.filter("odd").select("id", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    if not odd.isEmpty():
        rows = rows.join(sized(odd), "id", "left").filter("a1 is null or (a1 = h1 and a2 = h2)").drop("a1", "a2")
    same = W.partitionBy("h1", "h2").orderBy("id")
    first = marks.select("id", "h1", "h2", F.row_number().over(same).alias("no")).filter(F.col("no") <= k + 1)
    many = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    many = stored(many.select("h1", "h2", F.col("ids")[0].alias("rep"), "ids"), "many")
    whose = sized(many.select("h1", "h2", "rep"))
    base = rows.join(whose, ["h1", "h2"], "left").filter("rep is null or rep = id").drop("rep")
    asked = marks.filter(F.col("id") % every == 0).join(whose, ["h1", "h2"], "left").select(F.col("id").alias("query_id"), F.coalesce("rep", "id").alias("q"))
    asked = stored(asked, "asked")
    reps = asked.select(F.col("q").alias("id")).distinct()
    lengths = [r[0] for r in base.select(F.size("vec")).distinct().collect()]
    found = [_of_one_length(base.filter(F.size("vec") == length), reps, k + 1, recall) for length in sorted(lengths)]
    empty = table.sparkSession.createDataFrame([], _FOUND)
    found = stored(reduce(DataFrame.unionByName, found, empty).select("q", F.explode("found").alias("x")).select("q", "x.*"), "found")
    # Equal vectors are equally far.
    ids = many.select(F.col("rep").alias("id"), "ids")
    full = found.join(sized(ids), "id", "left").withColumn("ids", F.coalesce("ids", F.array("id")))
    each = _top(full.select("q", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("found")), k + 1)
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked.join(each, "q").select("query_id", F.posexplode(others).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
