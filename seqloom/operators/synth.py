"""Synthetic sequences with planted motifs and known truth.

Every sequence is drawn from a generator of its own, seeded by (seed, split, id), so the data
are the same for any number of partitions.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.bases import BASES
from seqloom.functions.motifs import GappedPattern, consensus_pwm, iupac_pwm
from seqloom.operators import corpus as C
from seqloom.sources.fasta import write_fasta

_COMPLEMENT = str.maketrans(BASES, BASES[::-1])


def reverse_complement(seq: str) -> str:
    return "".join(c if c in BASES else "N" for c in seq.upper()).translate(_COMPLEMENT)[::-1]


@dataclass(frozen=True)
class Lengths:
    """``fixed`` (a), ``normal`` (mean a, deviation b), ``lognormal`` (of the logarithm) or ``learned`` (from ``values``); cut to whole numbers and clipped."""

    kind: str = "fixed"
    a: float = 200
    b: float = 0
    low: int = 50
    high: int = 1000
    values: tuple[int, ...] = ()
    #: How often each of ``values`` was seen; empty: once.
    counts: tuple[int, ...] = ()

    def sample(self, rng: np.random.Generator) -> int:
        if self.kind == "fixed":
            return int(self.a)
        if self.kind == "learned":
            p = np.array(self.counts) / sum(self.counts) if self.counts else None
            return int(rng.choice(self.values, p=p))
        x = rng.normal(self.a, self.b) if self.kind == "normal" else rng.lognormal(self.a, self.b)
        return int(np.clip(int(x), self.low, self.high))


def learned_lengths(corpus: DataFrame) -> Lengths:
    """The distinct lengths of a corpus with their exact counts."""
    rows = corpus.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()
    return Lengths("learned", values=tuple(r["length"] for r in rows), counts=tuple(r["n"] for r in rows))


#: Bases that are drawn side by side.
CELLS = 2_000_000


@dataclass
class Markov:
    """Bases one after the other, by the ``order`` before them; the first ones by ``init``."""

    order: int
    table: np.ndarray
    init: np.ndarray

    @classmethod
    def uniform(cls, gc: float = 0.5, order: int = 0) -> Markov:
        if not 0 <= gc <= 1 or not 0 <= order <= 5:
            raise ValueError("gc is 0 to 1 and the order 0 to 5")
        row = np.array([(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2])
        return cls(order, np.tile(row, (4**order, 1)), row)

    @classmethod
    def of_rows(cls, rows: list[list[float]]) -> Markov:
        """From weights of the four bases in each context, contexts in the order of their numbers; the first bases are drawn by their mean."""
        order = round(np.log(max(len(rows), 1)) / np.log(4))
        table = np.array(rows, float) if {len(r) for r in rows} == {4} else np.empty(0)
        if table.shape != (4**order, 4) or (table < 0).any() or not (table.sum(axis=1) > 0).all():
            raise ValueError("a background has four chances in each of 1, 4, 16 ... contexts")
        table = table / table.sum(axis=1, keepdims=True)
        return cls(order, table, table.mean(axis=0))

    @classmethod
    def learned(cls, corpus: DataFrame, order: int = 3) -> Markov:
        table = np.zeros((4**order, 4))
        for r in C.background(corpus, order).collect():
            table[r["ctx"], r["base"]] = 2 ** r["logp"]
        init = np.full(4, 0.25)
        for r in C.initial_bases(corpus, max(order, 1)).collect():
            init[r["base"]] = r["p"]
        return cls(order, table / table.sum(axis=1, keepdims=True), init)

    @property
    def gc(self) -> float:
        return float(self.table[:, 1:3].sum(axis=1).mean())

    def generate(self, length: int, rng: np.random.Generator) -> str:
        return self.spell([rng.random(length)])[0]

    def spell(self, draws: list[np.ndarray]) -> list[str]:
        """One sequence for each array of uniform draws, base by base for all sequences side by side."""
        out = [""] * len(draws)
        order = sorted(range(len(draws)), key=lambda k: -len(draws[k]))
        upto, first, size, at = np.cumsum(self.table, axis=1), np.cumsum(self.init), 4**self.order, 0
        while at < len(order):
            longest = max(1, len(draws[order[at]]))
            take = order[at : at + max(1, CELLS // longest)]
            at += len(take)
            lengths = np.array([len(draws[k]) for k in take])
            codes, ctx = np.zeros((longest, len(take)), np.uint8), np.zeros(len(take), np.int64)
            u = np.zeros((longest, len(take)))
            for j, k in enumerate(take):
                u[: lengths[j], j] = draws[k]
            for i in range(int(lengths.max(initial=0))):
                n = int(np.searchsorted(-lengths, -i, side="left"))  # the sequences that are longer than i
                edges = first[None, :] if i < self.order else upto[ctx[:n]]
                codes[i, :n] = b = np.minimum((u[i, :n, None] >= edges).sum(axis=1), 3)
                ctx[:n] = (ctx[:n] * 4 + b) % size
            letters = np.frombuffer(BASES.encode(), np.uint8)[codes.T]
            for j, k in enumerate(take):
                out[k] = letters[j, : lengths[j]].tobytes().decode()
        return out


#: Draws of last edges that are tried at a time, and in all.
DRAWS, TRIES = 12, 960
#: Sequences that walk side by side, at least; fewer walk one by one.
WALKERS = 48
_NUMBERS = bytes.maketrans(BASES.encode(), bytes(range(4)))
_LETTERS = bytes.maketrans(bytes(range(4)), BASES.encode())


def _last_edges(edges: list[bytes], letters: list[int], end: int, rng: np.random.Generator) -> dict[int, int]:
    """For each of ``letters`` one of its edges, so that they lead from all to ``end``: the first such draw, after which ``rng`` goes on.

    Runs of one letter make such draws as rare as one in the product of the runs' lengths, so after
    TRIES of them one is drawn from all choices that lead to the end, each by how often it would be drawn.
    """
    if not letters:
        return {}
    sizes, each = np.array([len(e) for e in edges] * DRAWS), len(letters)
    follow = [end] * 4

    def leads() -> bool:
        # Four letters are three steps from the end at most; the end leads to itself.
        return all(follow[follow[follow[a]]] == end for a in letters)

    for _ in range(0, TRIES, DRAWS):
        before = rng.bit_generator.state
        drawn = rng.integers(sizes).tolist()
        for first in range(0, len(drawn), each):
            for a, e, i in zip(letters, edges, drawn[first : first + each], strict=True):
                follow[a] = e[i]
            if leads():
                rng.bit_generator.state = before
                rng.integers(sizes[: first + each])
                return {a: follow[a] for a in letters}
    found, weights = [], []
    for ends in product(range(4), repeat=each):
        for a, b in zip(letters, ends, strict=True):
            follow[a] = b
        if leads() and (weight := math.prod(e.count(b) for e, b in zip(edges, ends, strict=True))):
            found.append(ends)
            weights.append(float(weight))
    upto = np.cumsum(weights)
    return dict(zip(letters, found[min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(found) - 1)], strict=True))


def _successors(codes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[int]]:
    """What follows each letter, in the order in which a walk takes it, letter by letter, and where each letter's begin."""
    before, end = codes[:-1], int(codes[-1])
    after = codes[1:][before.argsort(kind="stable")]
    at = [0, *np.bincount(before, minlength=4).cumsum().tolist()]
    there = [a for a in range(4) if at[a] < at[a + 1]]

    # Last edges, drawn until they lead from every letter to the end, make the walk use every edge.
    inner = [a for a in there if a != end]
    edges = [after[at[a] : at[a + 1]].tobytes() for a in inner]
    last = _last_edges(edges, inner, end, rng)
    held = dict(zip(inner, edges, strict=True))
    out = np.empty_like(after)
    for a in there:
        lo, hi = at[a], at[a + 1]
        if a == end:
            out[lo:hi] = after[lo:hi][rng.permutation(hi - lo)]
            continue
        take = rng.permutation(hi - lo - 1)
        take += take >= held[a].index(last[a])
        out[lo : hi - 1] = after[lo:hi][take]
        out[hi - 1] = last[a]
    return out, at


def shuffle_all(seqs: list[bytes], rngs: Iterable[np.random.Generator]) -> list[bytes]:
    """:func:`shuffle_dinucleotides` of sequences of known letters, each by its own generator; many walk side by side."""
    out = list(seqs)
    numbers = [s.translate(_NUMBERS) for s in seqs]
    rngs = list(rngs)
    order = sorted((k for k, s in enumerate(numbers) if len(s) > 1 and s.count(s[:1]) < len(s)), key=lambda k: -len(seqs[k]))
    if not order:
        return out
    lengths = np.array([len(seqs[k]) for k in order])
    base = np.concatenate([[0], np.cumsum(lengths)])
    # A sequence's letters in place, and in one place fewer what follows them.
    made, follow = np.empty(base[-1], np.uint8), np.empty(base[-1], np.uint8)
    next_at = np.empty((len(order), 4), np.int64)
    for r, k in enumerate(order):
        codes = np.frombuffer(numbers[k], np.uint8)
        found, at = _successors(codes, rngs[k])
        follow[base[r] : base[r + 1] - 1] = found
        next_at[r] = at[:4]
        made[base[r]] = codes[0]
    next_at += base[:-1, None]
    last_at = np.column_stack([next_at[:, 1:], base[1:] - 1])

    step, n = 0, len(order)
    now, row, put, pointers = made[base[:-1]], np.arange(len(order)) * 4, base[:-1].copy(), next_at.ravel()
    while (n := int(np.searchsorted(-lengths[:n], -(step + 1), side="left"))) >= WALKERS:
        k = row[:n] + now[:n]
        p = pointers[k]
        pointers[k] = p + 1
        now = follow[p]
        put = put[:n] + 1
        made[put] = now
        step += 1
    for r in range(n):
        walks = [follow[lo:hi][::-1].tolist().pop for lo, hi in zip(next_at[r], last_at[r], strict=True)]
        at = int(made[base[r] + step])
        made[base[r] + step + 1 : base[r + 1]] = np.frombuffer(bytes([at := walks[at]() for _ in range(int(lengths[r]) - step - 1)]), np.uint8)
    letters = made.tobytes().translate(_LETTERS)
    for r, k in enumerate(order):
        out[k] = letters[base[r] : base[r + 1]]
    return out


def shuffle_dinucleotides(seq: str, rng: np.random.Generator) -> str:
    """A random sequence with the same first and last letter and the same dinucleotides; unknown letters are read as A.

    Sequences with fewer than two distinct letters come back as they are.
    """
    return shuffle_all([re.sub(f"[^{BASES}]", "A", seq.upper()).encode()], [rng])[0].decode()


#: Every byte but those of the four bases.
_OTHERS = bytes(sorted({*range(256)} - {*BASES.encode()}))
#: Letters of the sequences that a task shuffles side by side, about.
SIDE_BY_SIDE = 1_000_000


def _shuffles(texts: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and the shuffled letters A, C, G and T of ``(id, text)``, texts in upper case as bytes."""
    for batch in texts:
        ids, seqs = batch.column(0).to_pylist(), [t.as_py().translate(None, _OTHERS) for t in batch.column(1)]
        upto = np.cumsum([len(s) for s in seqs])
        at = 0
        while at < len(seqs):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SIDE_BY_SIDE, side="right")))
            yield ids[at:end], shuffle_all(seqs[at:end], (np.random.default_rng([seed, int(i)]) for i in ids[at:end]))
            at = end


def _upper(texts: DataFrame) -> DataFrame:
    # Letters other than the bases are left out in the task: Spark's regular expressions take longer than all the rest.
    key, text = texts.columns
    return texts.select(F.col(key).cast("long"), F.upper(F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def shuffle_texts(texts: DataFrame, seed: int) -> DataFrame:
    """``(seq_id, shuffled)`` of ``(id, text)``: :func:`shuffle_dinucleotides` of each text's letters A, C, G and T, drawn by ``seed`` and the id."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _shuffles(parts, seed):
            yield pa.RecordBatch.from_pydict({"seq_id": pa.array(ids, pa.int64()), "shuffled": pa.array(made, pa.binary()).cast(pa.string())})

    return _upper(texts).mapInArrow(run, "seq_id long, shuffled string")


def count_shuffled(texts: DataFrame, seed: int) -> DataFrame:
    """``(seq_id, kmer, cnt)``: the dinucleotides of :func:`shuffle_texts`; a task counts those of a text, so a shuffle moves 16 rows of it at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _shuffles(parts, seed):
            codes = np.frombuffer(b"".join(made).translate(_NUMBERS), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(made)), [len(s) for s in made])
            inside = row[1:] == row[:-1]
            counts = np.bincount((row[:-1] * 16 + codes[:-1] * 4 + codes[1:])[inside], minlength=16 * len(made))
            there = np.flatnonzero(counts)
            kmers = pa.array([a + b for a in BASES for b in BASES]).take(pa.array(there % 16))
            yield pa.RecordBatch.from_pydict({"seq_id": pa.array(ids, pa.int64()).take(pa.array(there // 16)), "kmer": kmers, "cnt": pa.array(counts[there], pa.int64())})

    counted = _upper(texts).mapInArrow(run, "seq_id long, kmer string, cnt long")
    return counted.groupBy("seq_id", "kmer").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))


def _fitted(template: str, length: int, rng: np.random.Generator) -> str:
    """A shuffled template, cut or filled up with uniform bases."""
    base = shuffle_dinucleotides(template, rng)[:length]
    return base + "".join(BASES[int(i)] for i in rng.integers(4, size=length - len(base)))


@dataclass
class Shuffled:
    """A few templates by length; one of the wanted length if there is any, else any, cut or filled up with uniform bases."""

    templates: list[str]

    def __post_init__(self) -> None:
        self._by_length: dict[int, list[str]] = {}
        for t in self.templates:
            self._by_length.setdefault(len(t), []).append(t)

    def generate(self, length: int, rng: np.random.Generator) -> str:
        fits = self._by_length.get(length, self.templates)
        return _fitted(fits[int(rng.integers(len(fits)))], length, rng)


@dataclass
class ShuffledCorpus:
    """The same from a corpus ``(seq_id, seq, length)`` of any size, whose sequences stay where they are.

    Sequences are numbered within their length and over all lengths, in two levels so that no
    task numbers a whole length; each wanted sequence draws a number and is joined with it.
    """

    corpus: DataFrame
    seed: int = 0
    #: Parts that the sequences of one length are numbered in.
    parts: int = 1024

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` ``(len, part, seq_id, seq)`` as ``(len, number, seq)``."""
        sizes = rows.groupBy("len", "part").agg(F.count("*").alias("n"))
        before = W.partitionBy("len").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        heads = sizes.select("len", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
        own = rows.withColumn("own", F.row_number().over(W.partitionBy("len", "part").orderBy("seq_id", "seq")))
        return own.join(heads, ["len", "part"]).select("len", (F.col("head") + F.col("own") - 1).alias("number"), "seq")

    def templates(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` ``(id, want)`` with the ``template`` of each; without any sequence in the corpus the template is empty."""
        rows = self.corpus.select(F.length("seq").alias("len"), F.pmod(F.xxhash64("seq_id"), F.lit(self.parts)).alias("part"), "seq_id", "seq")
        every = self._numbered(rows.unionByName(rows.withColumn("len", F.lit(-1))))
        counts = rows.groupBy("len").agg(F.count("*").alias("n"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
        fits = wanted.join(counts.withColumnRenamed("len", "want"), "want", "left").crossJoin(F.broadcast(total))
        draw = F.pmod(F.xxhash64("id", F.lit(self.seed)), F.greatest(F.coalesce("n", "all"), F.lit(1)))
        asked = fits.select("id", "want", F.when(F.col("n").isNull(), -1).otherwise(F.col("want")).alias("len"), draw.alias("number"))
        return asked.join(every, ["len", "number"], "left").select("id", "want", F.coalesce("seq", F.lit("")).alias("template"))


@dataclass(frozen=True)
class Planting:
    """Where instances go: ``uniform``, ``centre`` (normal about a part of the length) or ``clustered``."""

    kind: str = "uniform"
    density: float = 0.8
    occurrences: int = 1
    strand_bias: float = 0.5
    edge: int = 5
    avoid_overlap: bool = True
    centre: float = 0.5
    spread: float = 0.2
    cluster: int = 50
    tries: int = 50

    def place(self, length: int, width: int, taken: list[tuple[int, int]], near: int | None, rng: np.random.Generator) -> int | None:
        """A free start, or None."""
        for _ in range(self.tries):
            if self.kind == "centre":
                at = int(rng.normal(length * self.centre, length * self.spread))
                if not 0 <= at <= length - width:
                    continue
            else:
                low, high = self.edge, length - width - self.edge
                if self.kind == "clustered" and near is not None:
                    low, high = max(0, near - self.cluster), min(length - width, near + self.cluster)
                if high < low:
                    return None
                at = int(rng.integers(low, high + 1))
            if not self.avoid_overlap or all(at + width <= s or e <= at for s, e in taken):
                return at
        return None


def instance(pattern: GappedPattern, rng: np.random.Generator) -> tuple[str, list[int]]:
    """An instance and its gap lengths; gaps are uniform bases."""
    draw = lambda rows: "".join(BASES[int(rng.choice(4, p=r / r.sum()))] for r in rows)
    out, gaps = draw(pattern.blocks[0]), []
    for (low, high), b in zip(pattern.gaps, pattern.blocks[1:], strict=True):
        gaps.append(int(rng.integers(low, high + 1)))
        out += "".join(BASES[int(i)] for i in rng.integers(4, size=gaps[-1])) + draw(b)
    return out, gaps


@dataclass
class Dataset:
    """``n`` sequences over a background, with motifs planted one after the other."""

    n: int = 100
    lengths: Lengths = field(default_factory=Lengths)
    background: Markov | Shuffled | ShuffledCorpus = field(default_factory=Markov.uniform)
    motifs: list[GappedPattern] = field(default_factory=list)
    planting: Planting = field(default_factory=Planting)
    seed: int = 42
    split: int = 0
    #: Chances that a sequence holds 0, 1, 2 ... instances, each of a motif drawn at random; empty: every motif by the planting's density.
    inserts: tuple[float, ...] = ()

    def length_of(self, i: int) -> int:
        return self.lengths.sample(np.random.default_rng([self.seed, self.split, i]))

    def one(self, i: int, template: str | None = None) -> tuple[str, list[dict]]:
        return self.many([i], [template])[0]

    def many(self, ids: list[int], templates: list[str | None]) -> list[tuple[str, list[dict]]]:
        """Sequences and what is planted in them; each number has random numbers of its own, so neither batches nor partitions change it."""
        rngs = [np.random.default_rng([self.seed, self.split, i]) for i in ids]
        lengths = [self.lengths.sample(rng) for rng in rngs]
        if isinstance(self.background, Markov):
            seqs = self.background.spell([rng.random(n) for rng, n in zip(rngs, lengths, strict=True)])
        else:
            seqs = [self.background.generate(n, rng) if t is None else _fitted(t, n, rng) for t, n, rng in zip(templates, lengths, rngs, strict=True)]
        return [self._planted(seq, rng) for seq, rng in zip(seqs, rngs, strict=True)]

    def _planted(self, seq: str, rng: np.random.Generator) -> tuple[str, list[dict]]:
        taken: list[tuple[int, int]] = []
        planted = []
        each, density = list(enumerate(self.motifs)), self.planting.density
        if self.inserts:
            drawn = rng.integers(len(self.motifs), size=int(rng.choice(len(self.inserts), p=self.inserts)))
            each, density = [(int(k), self.motifs[k]) for k in drawn], 1.0
        for k, motif in each:
            near = None
            for _ in range(1 if self.inserts else self.planting.occurrences):
                if rng.random() > density:
                    continue
                made, gaps = instance(motif, rng)
                at = self.planting.place(len(seq), len(made), taken, near, rng)
                if at is None:
                    continue
                strand = "+" if rng.random() < self.planting.strand_bias else "-"
                put = made if strand == "+" else reverse_complement(made)
                seq = seq[:at] + put + seq[at + len(put) :]
                taken.append((at, at + len(put)))
                near = at
                planted.append({"motif_id": k, "start": at, "end": at + len(put), "strand": strand, "sequence": put, "gap_lengths": gaps})
        return seq, planted

    def generate(self, spark: SparkSession) -> DataFrame:
        """``(seq_id, seq, length, planted)``."""

        own = replace(self, background=None) if isinstance(self.background, ShuffledCorpus) else self

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                templates = part["template"] if "template" in part else [None] * len(part)
                made = own.many(part["id"].tolist(), list(templates))
                yield pd.DataFrame({"seq_id": [f"seq_{i}" for i in part["id"]], "seq": [s for s, _ in made], "length": [len(s) for s, _ in made], "planted": [p for _, p in made]})

        def lengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"id": part["id"], "want": [own.length_of(int(i)) for i in part["id"]]})

        rows = spark.range(self.n)
        if isinstance(self.background, ShuffledCorpus):
            rows = self.background.templates(rows.mapInPandas(lengths, "id long, want int")).select("id", "template")
        kinds = "seq_id string, seq string, length int, planted array<struct<motif_id:int,start:int,end:int,strand:string,sequence:string,gap_lengths:array<int>>>"
        return rows.mapInPandas(run, kinds)

    def write_truth(self, made: DataFrame, path: str) -> None:
        """The truth of a set of any size as a folder of JSON lines, one a sequence."""
        made.select(F.to_json(F.struct(F.col("seq_id").alias("id"), "planted")).alias("value")).write.mode("overwrite").text(path)

    def truth(self, made: DataFrame) -> str:
        """The truth as JSON; for sets small enough to be read by people."""
        rows = sorted(made.select("seq_id", F.to_json("planted").alias("p")).collect(), key=lambda r: int(r["seq_id"].rpartition("_")[2]))
        motifs = [{"id": i, "consensus": m.consensus(), "length": m.length} for i, m in enumerate(self.motifs)]
        doc = {"config": {"n_sequences": self.n, "seed": self.seed, "n_motifs": len(motifs)}, "motifs": motifs, "sequences": [{"id": r["seq_id"], "planted": json.loads(r["p"])} for r in rows]}
        return json.dumps(doc, indent=2)


def patterns(texts: list[str], noise: float = 0.05) -> list[GappedPattern]:
    return [GappedPattern.parse(t, noise) for t in texts]


def solid(text: str, strength: float) -> GappedPattern:
    return GappedPattern([consensus_pwm(text, strength)], [], text)


# The reference sets' names, sizes and motifs.
PRESETS = {
    "simple": Dataset(100, Lengths("fixed", 100), motifs=[GappedPattern([iupac_pwm("TATAAATAGC", 0.2)])]),
    "multi": Dataset(100, Lengths("fixed", 200), motifs=patterns(["ACGTACGT", "TATAAAT", "GATAAGA"])),
    "gapped": Dataset(100, Lengths("fixed", 200), motifs=patterns(["ACGT[3-8]TGCA"])),
    "chip": Dataset(1000, Lengths("normal", 200, 50), motifs=patterns(["ACGTACGT"]), planting=Planting("centre", spread=0.1)),
    "medium": Dataset(50, Lengths("fixed", 100), motifs=[solid("ACGTACGTAC", 0.95), solid("GCTAGCTAGT", 0.70)], seed=123),
    "varying": Dataset(500, Lengths("fixed", 200), motifs=[solid(*x) for x in (("ACGTACGT", 0.95), ("TTTGGCCAAA", 0.80), ("TATATATATATATA", 0.60))]),
    "reversed": Dataset(100, Lengths("fixed", 150), motifs=patterns(["GGCCAATTCC"]), planting=Planting(density=1, strand_bias=0.0), seed=123),
    "sharp": Dataset(500, Lengths("fixed", 200), motifs=[solid("TATAAATA", 0.95), solid("GCGGCGGC", 0.95)]),
    "pair": Dataset(50, Lengths("fixed", 100), motifs=patterns(["AAAAAATT", "GGGGGGCCCCCC"], 0.0)),
    "verify": Dataset(100, Lengths("fixed", 50), motifs=patterns(["ACGTACGT"], 0.0), planting=Planting(density=1)),
    "huge": Dataset(50_000, Lengths("fixed", 50), motifs=patterns(["TATAAATA"])),
    "massive": Dataset(500_000, Lengths("fixed", 50), motifs=patterns(["TATAAATA"])),
}


def _drawn(n: int, low: int, high: int, seed: int, strengths: np.ndarray) -> list[GappedPattern]:
    rng = np.random.default_rng(seed)
    texts = ["".join(BASES[int(i)] for i in rng.integers(4, size=int(rng.integers(low, high + 1)))) for _ in range(n)]
    return [solid(t, float(s)) for t, s in zip(texts, strengths, strict=True)]


PRESETS["hard"] = Dataset(100, Lengths("fixed", 200), motifs=_drawn(10, 8, 12, 42, np.linspace(0.95, 0.40, 10)), inserts=(0.10, 0.40, 0.35, 0.15))
PRESETS["complex"] = Dataset(10_000, Lengths("fixed", 100), motifs=[_drawn(1, n, n, n, np.array([0.9]))[0] for n in (6, 8, 10, 12, 14)], inserts=(0.2,) * 5)


def splits(data: Dataset, train: int = 1000, test: int = 200) -> dict[str, Dataset]:
    """Train and test sets drawn apart: their generators never share a seed."""
    return {"train": replace(data, n=train, split=1), "test": replace(data, n=test, split=2)}


def standard_suite(data: Dataset, spark: SparkSession, folder: str, train: int = 1000, test: int = 200) -> None:
    """Sequences and truth in ``train`` and ``test`` below a folder; the test set's seed is one larger."""
    for name, part in (("train", replace(data, n=train)), ("test", replace(data, n=test, seed=data.seed + 1))):
        made = part.generate(spark)
        write_fasta(made, f"{folder}/{name}/sequences")
        part.write_truth(made, f"{folder}/{name}/truth")


def expected_density(data: Dataset) -> float:
    return 1 - (1 - data.planting.density) ** data.planting.occurrences if data.motifs else math.nan
