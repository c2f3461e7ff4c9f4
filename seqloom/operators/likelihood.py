"""Likelihood of sequences under motif models, by dynamic programming.

A sequence is read from left to right: each step is either one background base or one whole
motif instance, contiguous or gapped, on either strand. The log2 likelihood adds up all ways
to read it. A job scores many models at once; each task reads sequences in Arrow batches and
adds up its part of every model's total.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.gaps import GapConfig
from seqloom.functions.motifs import reverse

_CODE = np.full(256, -1, np.int8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
#: Sequences of a batch are scored side by side in groups of at most so many cells; a step holds some twenty numbers a cell.
CELLS = 500_000


#: Positions of a motif whose weights are looked up together, by the number of their letters.
TOGETHER = 5
#: Exponents of 2 up to which weights relative to the background are multiplied rather than added as logarithms.
LARGE = 300.0
#: The same below 1, for a block's weights and for the background's.
SAFE = 450.0
#: Windows whose weights are looked up at a time, about, so that they stay near the processor.
SLAB = 32_768
#: Spans that a batch keeps the background's weights of.
SPANS = 4
#: Rows from which a step adds position by position.
WIDE = 128


#: Letters that tasks work on as one array, about; a longer sequence is one by itself.
LETTERS = 500_000


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column holds sequences, cut so that none has many letters, however long sequences are."""
    for batch in batches:
        upto = np.cumsum([len(x.as_py() or "") + 1 for x in batch.column(batch.num_columns - 1)] or [0])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LETTERS, side="right")))
            yield batch.slice(at, end - at)
            at = end


def encode(seq: str | bytes) -> np.ndarray:
    raw = seq.encode("latin-1", "replace") if isinstance(seq, str) else seq
    return _CODE[np.frombuffer(raw, np.uint8)]


@dataclass
class Tables:
    """Weights, not as logarithms, of TOGETHER letters at a time by their number, for a block and its other strand."""

    strands: list[list[np.ndarray]]
    #: log2 of the largest weight of a window.
    most: float
    #: Whether every product of weights that isn't 0 is a number that a float holds in full.
    safe: bool

    @classmethod
    def of(cls, block: np.ndarray) -> Tables:
        most, least = float(block.max(axis=1).sum()), float(np.where(block == -np.inf, 0.0, block).min(axis=1).sum())
        if not (-SAFE < least and most < LARGE):
            return cls([], most, False)
        strands = []
        for pwm in (block, reverse(block)):
            rows, tables = np.column_stack([np.exp2(pwm), np.zeros(len(pwm))]), []
            for at in range(0, len(pwm), TOGETHER):
                table = np.ones(1)
                for r in rows[at : at + TOGETHER]:
                    table = np.multiply.outer(table, r).ravel()
                tables.append(table)
            strands.append(tables)
        return cls(strands, most, True)


@dataclass
class Piece:
    """A motif: one block of log2 weights or several with gaps between them."""

    blocks: list[np.ndarray]
    gaps: GapConfig | None = None
    #: Fixed gap lengths; None where they are summed over with their prior.
    lengths: list[int] | None = None
    _tables: Tables | None = None

    def tables(self) -> Tables:
        """Of a single block: worked out once."""
        if self._tables is None:
            self._tables = Tables.of(self.blocks[0])
        return self._tables

    def layouts(self) -> list[tuple[list[int], float]]:
        """Gap lengths and their log2 prior."""
        n = len(self.blocks) - 1
        if not n:
            return [([], 0.0)]
        if self.lengths is not None:
            return [(list(self.lengths), 0.0)]
        ranges = range(self.gaps.shortest, self.gaps.longest + 1)
        return [(list(g), sum(self.gaps.log_prior(x) for x in g) / np.log(2)) for g in product(ranges, repeat=n)]

    @property
    def chained(self) -> bool:
        """Whether gap lengths are summed over by a state for each block rather than a layout for each combination of them."""
        return self.lengths is None and len(self.blocks) > 2

    @property
    def spans(self) -> tuple[int, int]:
        """The fewest and the most bases of an instance."""
        n = len(self.blocks) - 1
        least, most = (0, 0) if not n else (sum(self.lengths),) * 2 if self.lengths is not None else (n * self.gaps.shortest, n * self.gaps.longest)
        own = sum(map(len, self.blocks))
        return own + least, own + most

    def other_strand(self) -> Piece:
        """Blocks and gaps in reverse order, each block reversed."""
        turned = None if self.lengths is None else list(self.lengths)[::-1]
        return Piece([reverse(b) for b in reversed(self.blocks)], self.gaps, turned)


@dataclass
class Model:
    """Motifs with the background, ``bg`` of shape (4^order, 4) in log2."""

    pieces: list[Piece]
    bg: np.ndarray
    mean_length: float
    both_strands: bool = True
    active: list[bool] = field(default_factory=list)

    @classmethod
    def plain(cls, pwms: list[np.ndarray], bg: np.ndarray, mean_length: float, both_strands: bool = True) -> Model:
        return cls([Piece([np.asarray(p, float)]) for p in pwms], bg, mean_length, both_strands)


def _background(x: np.ndarray, bg: np.ndarray) -> np.ndarray:
    """log2 weight of each base; -2 where it, or one of the bases before it, is unknown or missing."""
    order = round(np.log(len(bg)) / np.log(4))
    ctx = np.zeros(x.shape, np.int64)
    ok = x >= 0
    for back in range(order, 0, -1):
        prev = np.full(x.shape, -1, np.int64)
        prev[:, back:] = x[:, :-back]
        ok &= prev >= 0
        ctx = ctx * 4 + np.maximum(prev, 0)
    return np.where(ok, bg[ctx, np.maximum(x, 0)], -2.0)


Codes = Callable[[int], np.ndarray]


def window_codes(x: np.ndarray) -> Codes:
    """The numbers of all windows of a width, base 5 with 4 for an unknown letter; each width is worked out once."""
    digits = np.where(x < 0, 4, x).astype(np.intp)
    known: dict[int, np.ndarray] = {}

    def codes(width: int) -> np.ndarray:
        if width not in known:
            n = max(x.shape[1] - width + 1, 0)
            out = np.zeros((len(x), n), np.intp)
            for j in range(width):
                out = out * 5 + digits[:, j : j + n]
            known[width] = out
        return known[width]

    return codes


def block_scores(x: np.ndarray, pwm: np.ndarray, codes: Codes | None = None) -> np.ndarray:
    """Score of each window, -inf if a base is unknown."""
    n = max(x.shape[1] - len(pwm) + 1, 0)
    out = np.zeros((len(x), n))
    if not n:
        return out
    codes = codes or window_codes(x)
    rows = np.column_stack([pwm, np.full(len(pwm), -np.inf)])
    for at in range(0, len(pwm), TOGETHER):
        part = rows[at : at + TOGETHER]
        table = np.zeros(1)
        for r in part:
            table = np.add.outer(table, r).ravel()
        out += table[codes(len(part))[:, at : at + n]]
    return out


def _emissions(x: np.ndarray, piece: Piece, bg: np.ndarray, codes: Codes) -> list[tuple[int, np.ndarray]]:
    """``(span, scores by start)`` for every layout of gaps; gap bases weigh as background."""
    scores = [block_scores(x, b, codes) for b in piece.blocks]
    upto = np.concatenate([np.zeros((len(x), 1)), np.cumsum(bg, axis=1)], axis=1) if len(scores) > 1 else None
    out = []
    for gaps, prior in piece.layouts():
        span = sum(map(len, piece.blocks)) + sum(gaps)
        n = x.shape[1] - span + 1
        if n <= 0 or prior == -np.inf:
            continue
        total, at = np.full((len(x), n), prior), 0
        for i, b in enumerate(piece.blocks):
            if i:
                total += upto[:, at + gaps[i - 1] :][:, :n] - upto[:, at:][:, :n]
                at += gaps[i - 1]
            total += scores[i][:, at : at + n]
            at += len(b)
        out.append((span, total))
    return out


def _moves(x: np.ndarray, pieces: list[Piece], bg: np.ndarray, both_strands: bool, codes: Codes) -> Iterator[tuple[int, np.ndarray]]:
    """``(span, scores by start)`` of every piece and layout, the better strand's if asked for."""
    for p in pieces:
        found = _emissions(x, p, bg, codes)
        if both_strands:
            other = dict(_by_layout(x, p.other_strand(), bg, codes))
            found = [(s, np.maximum(m, other[key])) for key, (s, m) in zip(_keys(x, p), found, strict=True)]
        yield from found


@dataclass
class _Chain:
    """A motif of several blocks on one strand, its gaps summed over: ``ends[k]`` holds, by place, the weight of all reads whose block k ends there.

    A block follows the one before it after every gap length, so the work grows with the number
    of blocks times the range of lengths, not with its powers.
    """

    blocks: list[int]
    ratios: list[np.ndarray]
    gaps: np.ndarray
    shortest: int
    enter: float
    ends: list[np.ndarray]

    @classmethod
    def of(cls, piece: Piece, x: np.ndarray, upto: np.ndarray, stay: float, enter: float, codes: Codes) -> _Chain:
        n, blocks, ratios, gain = x.shape[1], [len(b) for b in piece.blocks], [], enter
        for b in piece.blocks:
            log = block_scores(x, b, codes) - (upto[:, len(b) :] - upto[:, : max(n - len(b) + 1, 0)])
            gain += max(0.0, log.max(initial=-np.inf))
            ratios.append(np.ascontiguousarray(np.exp2(log).T))
        lengths = np.arange(piece.gaps.shortest, piece.gaps.longest + 1)
        # A base of a gap weighs as background, but for the chance of staying in it.
        weights = np.exp2([piece.gaps.log_prior(int(d)) / np.log(2) - stay * d for d in lengths])
        if gain + (len(blocks) - 1) * max(0.0, float(np.log2(weights.sum()))) > LARGE:
            raise ValueError("a motif's weight over the background's is beyond 2^300")
        return cls(blocks, ratios, weights, piece.gaps.shortest, 2.0**enter, [np.zeros((n + 1, len(x))) for _ in blocks])

    def add(self, g: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """What instances that end at places ``lo + 1`` to ``hi`` add; no more places than the shortest block has."""
        before, skip = g, 0
        for k, (width, ratio, ends) in enumerate(zip(self.blocks, self.ratios, self.ends, strict=True)):
            weights = self.gaps if k else np.ones(1)
            skip = self.shortest if k else 0
            first = max(lo + 1, width)
            if first > hi:
                return np.zeros((hi - lo, g.shape[1]))
            total = np.zeros((hi - first + 1, g.shape[1]))
            for d, w in enumerate(weights, skip):
                begin = max(first, width + d)
                if begin <= hi:
                    total[begin - first :] += w * before[begin - width - d : hi - width - d + 1]
            ends[first : hi + 1] = total * ratio[first - width : hi - width + 1]
            before = ends
        return ends[lo + 1 : hi + 1] * self.enter


@dataclass
class _Weights:
    """Of a model over a batch: by span, position and row, the weights of instances over the background's, ``most`` at most in log2 of all that end at one base."""

    ratios: dict[int, np.ndarray]
    chains: list[_Chain]
    most: float
    reach: int
    #: The background's likelihood of each row.
    alone: np.ndarray


@dataclass
class Batch:
    """Sequences of like length side by side: codes, -1 beyond each one's size, and their places in the list they come from."""

    place: np.ndarray
    x: np.ndarray
    sizes: np.ndarray
    _bg: tuple[bytes, np.ndarray] = (b"", np.empty(0))
    _codes: Codes | None = None
    #: By width, and by position first: the numbers of windows.
    _turned: dict[int, np.ndarray] = field(default_factory=dict)
    #: The setting of what follows, the background's likelihood of each row, and by span its weights of windows and the log2 of the largest.
    _of: tuple = ()
    _alone: np.ndarray = field(default_factory=lambda: np.empty(0))
    _under: dict[int, tuple[np.ndarray, float]] = field(default_factory=dict)

    @property
    def codes(self) -> Codes:
        if self._codes is None:
            self._codes = window_codes(self.x)
        return self._codes

    def background(self, bg: np.ndarray) -> np.ndarray:
        """:func:`_background`, kept for the last model asked for."""
        if (key := bg.tobytes()) != self._bg[0]:
            self._bg = key, _background(self.x, bg)
        return self._bg[1]

    def turned(self, width: int) -> np.ndarray:
        """The numbers of all windows of at most TOGETHER letters, as :func:`window_codes`, by position first."""
        if width not in self._turned:
            digits = np.ascontiguousarray(np.where(self.x < 0, 4, self.x).T).astype(np.uint16)
            n = max(len(digits) - width + 1, 0)
            out = np.zeros((n, len(self.x)), np.uint16)
            for j in range(width):
                out *= 5
                out += digits[j : j + n]
            self._turned[width] = out
        return self._turned[width]

    def _upto(self, bg: np.ndarray, stay: float) -> np.ndarray:
        return np.concatenate([np.zeros((len(self.x), 1)), np.cumsum(self.background(bg) + stay, axis=1)], axis=1)

    def _settle(self, bg: np.ndarray, stay: float, enter: float) -> None:
        """Keep what depends on the background and the chance of a motif alone, as models of a search share these."""
        if (key := (bg.tobytes(), stay, enter)) != self._of:
            self._of, self._under = key, {}
            self._alone = np.take_along_axis(self._upto(bg, stay), self.sizes[:, None], axis=1)[:, 0]

    def _beside(self, span: int, bg: np.ndarray, stay: float, enter: float) -> tuple[np.ndarray, float]:
        """By position first, what turns the weight of an instance into its weight over the background's, and the log2 of the largest of them (infinite: not safe)."""
        if span not in self._under:
            upto = self._upto(bg, stay)
            log = enter - (upto[:, span:] - upto[:, : upto.shape[1] - span])
            safe = log.size and np.isfinite(log).all() and log.min() > -SAFE
            while len(self._under) >= SPANS:
                del self._under[next(iter(self._under))]
            self._under[span] = np.exp2(log.T, order="C"), float(log.max()) if safe else np.inf
        return self._under[span]

    def _ratios(self, piece: Piece, under: np.ndarray, both_strands: bool) -> np.ndarray:
        """By position first, the weights over the background's of instances of a single block, the better strand's if asked for."""
        span, tables = len(piece.blocks[0]), piece.tables().strands[: 1 + both_strands]
        n, rows = under.shape
        out = np.empty((n, rows))
        slab = max(1, SLAB // rows)
        one, other = np.empty((slab, rows)), np.empty((slab, rows))
        widths = [min(TOGETHER, span - at) for at in range(0, span, TOGETHER)]
        codes = [self.turned(w)[i * TOGETHER :][:n] for i, w in enumerate(widths)]
        for lo in range(0, n, slab):
            to, hi = out[lo : lo + slab], min(lo + slab, n)
            for into, strand in zip((to, one[: hi - lo]), tables, strict=False):
                for i, (table, c) in enumerate(zip(strand, codes, strict=True)):
                    part = np.take(table, c[lo:hi], out=other[: hi - lo] if i else into, mode="clip")
                    if i:
                        into *= part
            if both_strands:
                np.maximum(to, one[: hi - lo], out=to)
            to *= under[lo:hi]
        return out

    def score(self, model: Model) -> np.ndarray:
        """log2 likelihood of each row.

        Relative to a read of background bases alone the recursion is a sum of products, and
        within as many bases as the shortest motif has, no instance ends that begins there:
        so it goes that many bases at a time. Rows are scaled down before they overflow.
        """
        return self.score_all([model])[0]

    def score_all(self, models: list[Model]) -> list[np.ndarray]:
        """Likelihoods by model; where rows are few, models of the same spans that come one after another are read side by side."""
        out: list[np.ndarray] = []
        waiting: list[_Weights] = []
        beside = max(1, WIDE // len(self.x))

        def read() -> None:
            if waiting:
                first = waiting[0]
                ratios = first.ratios if len(waiting) == 1 else {s: np.concatenate([w.ratios[s] for w in waiting], axis=1) for s in first.ratios}
                gained = self._read(_Weights(ratios, first.chains, max(w.most for w in waiting), first.reach, first.alone), len(waiting))
                out.extend(w.alone + part for w, part in zip(waiting, np.split(gained, len(waiting)), strict=True))
                waiting.clear()

        for m in models:
            found = self._weigh(m)
            alike = isinstance(found, _Weights) and waiting and not found.chains and not waiting[0].chains and found.ratios.keys() == waiting[0].ratios.keys()
            if not alike or len(waiting) >= beside:
                read()
            if isinstance(found, _Weights):
                waiting.append(found)
            else:
                out.append(found)
        read()
        return out

    def _weigh(self, model: Model) -> np.ndarray | _Weights:
        """What :meth:`_read` reads, or the likelihoods at once."""
        x, sizes = self.x, self.sizes
        n = x.shape[1]
        pieces = [p for i, p in enumerate(model.pieces) if not model.active or model.active[i]]
        if not pieces:
            return np.where(np.arange(n) < sizes[:, None], self.background(model.bg), 0).sum(axis=1)
        each = 1 / model.mean_length
        stay, enter = np.log2(1 - min(len(pieces) * each, 0.9999)), np.log2(each)
        self._settle(model.bg, stay, enter)
        # Layouts of one span add up to one weight.
        ratios: dict[int, np.ndarray] = {}
        joint = [p for p in pieces if p.chained and not model.both_strands]
        most, slow = 0.0, []
        for p in pieces:
            span = len(p.blocks[0])
            if p.chained and not model.both_strands:
                continue
            if len(p.blocks) > 1 or not p.tables().safe:
                slow.append(p)
            elif span <= n:
                under, top = self._beside(span, model.bg, stay, enter)
                if top > SAFE:
                    slow.append(p)
                    continue
                ratio = self._ratios(p, under, model.both_strands)
                gain = top + p.tables().most
                if gain > LARGE and (gain := float(np.log2(max(ratio.max(), 1.0)))) > LARGE:
                    return self._score_logs(model, pieces, self.background(model.bg), stay, enter)
                most = max(most, gain)
                ratios[span] = ratios[span] + ratio if span in ratios else ratio
        chains = []
        if slow or joint:
            bg, upto = self.background(model.bg), self._upto(model.bg, stay)
            chains = [_Chain.of(p, x, upto, stay, enter, self.codes) for p in joint if p.spans[0] <= n]
            for span, m in _moves(x, slow, bg, model.both_strands, self.codes):
                gain = m + enter - (upto[:, span:] - upto[:, : n - span + 1])
                if gain.max(initial=-np.inf) > LARGE:
                    return self._score_logs(model, pieces, bg, stay, enter)
                # By position first, so that a step works on neighbours in memory.
                ratio = np.ascontiguousarray(np.exp2(gain, out=gain).T)
                ratios[span] = ratios[span] + ratio if span in ratios else ratio
        if not ratios and not chains:
            return self._alone.copy()
        grows = LARGE if slow or chains else most + np.log2(len(pieces))
        return _Weights(ratios, chains, grows, max([*ratios, *[p.spans[1] for p in joint]]), self._alone)

    def _read(self, weights: _Weights, times: int) -> np.ndarray:
        """log2 of what all ways to read a row weigh over the background's, of all rows as many times as there are models."""
        sizes = np.tile(self.sizes, times)
        n, rows, ratios, chains = self.x.shape[1], len(sizes), weights.ratios, weights.chains
        block = min([*ratios, *[b for c in chains for b in c.blocks]])
        out, scale, left = np.zeros(rows), np.zeros(rows), np.arange(rows)
        g = np.empty((n + 1, rows))
        g[0] = 1.0
        # In a block no row grows by more than all its windows' largest weights: so many blocks go by before a look at the largest.
        often = max(1, int(LARGE / (weights.most + np.log2(1 + block))))
        plain = next(iter(ratios.values())) if len(ratios) == 1 and not chains else None

        def finish(upto: int) -> np.ndarray:
            done = left[sizes[left] <= upto]
            out[done] = np.log2(g[sizes[done], done]) + scale[done]
            return left[sizes[left] > upto]

        for at, lo in enumerate(range(0, n, block), 1):
            hi = min(lo + block, n)
            add = g[lo + 1 : hi + 1]
            if plain is not None and lo:
                np.multiply(g[lo + 1 - block : hi + 1 - block], plain[lo + 1 - block : hi + 1 - block], add)
            else:
                add[:] = 0.0
                for span, r in ratios.items():
                    first = max(lo + 1, span)
                    if first <= hi:
                        add[first - lo - 1 :] += g[first - span : hi - span + 1] * r[first - span : hi - span + 1]
                for chain in chains:
                    add += chain.add(g, lo, hi)
            if rows < WIDE:
                np.add.accumulate(g[lo : hi + 1], 0, None, g[lo : hi + 1])
            else:
                for i in range(lo, hi):
                    np.add(g[i], g[i + 1], g[i + 1])
            if at % often == 0 and g[hi].max() > 2.0**LARGE:
                left = finish(hi)
                big = np.flatnonzero(g[hi] > 2.0**LARGE)
                down = np.floor(np.log2(g[hi, big]))
                scale[big] += down
                for held in (g, *[e for c in chains for e in c.ends]):
                    held[max(0, hi - weights.reach) : hi + 1, big] *= np.exp2(-down)
        finish(n)
        return out

    def _score_logs(self, model: Model, pieces: list[Piece], bg: np.ndarray, stay: float, enter: float) -> np.ndarray:
        """The same base by base in logarithms, for weights that no number holds."""
        x, sizes = self.x, self.sizes
        moves = list(_moves(x, pieces, bg, model.both_strands, self.codes))
        f = np.full((x.shape[1] + 1, len(x)), -np.inf)
        f[0] = 0.0
        out = np.zeros(len(x))
        for i in range(1, x.shape[1] + 1):
            best = f[i - 1] + bg[:, i - 1] + stay
            for span, m in moves:
                if i >= span:
                    best = np.logaddexp2(best, f[i - span] + m[:, i - span] + enter)
            f[i] = best
            done = sizes == i
            out[done] = best[done]
        return out


def _keys(x: np.ndarray, piece: Piece) -> list[tuple[int, ...]]:
    span = sum(map(len, piece.blocks))
    return [tuple(g) for g, prior in piece.layouts() if x.shape[1] - span - sum(g) + 1 > 0 and prior != -np.inf]


def _by_layout(x: np.ndarray, turned: Piece, bg: np.ndarray, codes: Codes) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Scores of the other strand by the forward strand's gap lengths."""
    return [(key[::-1], m) for key, (_, m) in zip(_keys(x, turned), _emissions(x, turned, bg, codes), strict=True)]


def batches(seqs: list[np.ndarray], cells: int = CELLS) -> list[Batch]:
    """Sequences of like length together, at most ``cells`` bases at a time; empty ones are in none."""
    out = []
    order = np.argsort([len(s) for s in seqs], kind="stable")
    at = len(order)
    while at:
        longest = len(seqs[order[at - 1]])
        if not longest:
            break
        take = order[max(0, at - max(1, cells // (longest + 1))) : at]
        take = take[[len(seqs[i]) * 2 >= longest for i in take]]
        x = np.full((len(take), longest), -1, np.int8)
        for r, i in enumerate(take):
            x[r, : len(seqs[i])] = seqs[i]
        out.append(Batch(take, x, np.array([len(seqs[i]) for i in take])))
        at -= len(take)
    return out


def score(seqs: list[np.ndarray], models: list[Model]) -> np.ndarray:
    """log2 likelihoods, (models, sequences); an empty sequence has 0."""
    out = np.zeros((len(models), len(seqs)))
    layouts = max((2 * len(p.blocks) if p.chained and not m.both_strands else len(p.layouts()) for m in models for p in m.pieces), default=1)
    # Models of one span in turn, as a batch keeps the background's weights of few spans.
    order = sorted(enumerate(models), key=lambda km: [p.spans[0] for p in km[1].pieces])
    for batch in batches(seqs, CELLS // layouts):
        for (k, _), found in zip(order, batch.score_all([m for _, m in order]), strict=True):
            out[k, batch.place] = found
    return out


def score_sequences(corpus: DataFrame, models: list[Model], id_type: str = "long") -> DataFrame:
    """``(seq_id, model_id, log2_lik)``; an empty sequence has log2 likelihood 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = score([encode(s) for s in batch.column(1).to_pylist()], models)
            for k in range(len(models)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(batch.num_rows, k, np.int32)), pa.array(found[k])], names=["seq_id", "model_id", "log2_lik"]
                )

    return corpus.select("seq_id", "seq").mapInArrow(run, f"seq_id {id_type}, model_id int, log2_lik double")


def register(spark: SparkSession, model: Model, name: str = "seq_log2lik") -> None:
    """Make a model's likelihood of a sequence available to SQL text."""

    @F.pandas_udf("double")
    def lik(seqs: pd.Series) -> pd.Series:
        return pd.Series(score([encode(s or "") for s in seqs], [model])[0])

    spark.udf.register(name, lik)


#: A sequence's likelihood counts in steps of 2^-20, so that sums are exact and depend on no order.
STEPS = float(1 << 20)


def in_steps(scores: np.ndarray, times: np.ndarray | int = 1) -> int:
    return int((np.round(scores * STEPS).astype(np.int64) * times).sum())


#: Rows and places of a slab of sequences that a task keeps; the most bases of a motif there, and the largest order of a background.
ROWS, PLACES, REACH, CONTEXT = 400, 48, 20, 4
#: Windows of it whose weights are looked up at a time, about, and numbers from which a step adds place by place.
CLOSE, BROAD = 5_000, 200
#: Models that are read side by side, at most.
ABREAST = 4
#: The least log2 weight of a base there, as those of PLACES and REACH bases are multiplied.
LEAST = -13.0


@dataclass
class _Slab:
    """Places from ``at`` on of the first ``n`` rows of a group: the numbers of windows of TOGETHER letters, and the background's weights of reads from ``at`` on."""

    at: int
    codes: np.ndarray
    upto: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def n(self) -> int:
        return self.codes.shape[1]


class Deck:
    """Sequences that a task scores for models after models, each counted ``times``: position first, by slabs that stay near the processor.

    Models of one block a motif are read side by side: one lookup finds the weights of all of them
    and of both strands. Others go by :class:`Batch`.
    """

    STATE = ("times", "sizes", "_of", "_safe", "_lowest", "_alone")

    def __init__(self, seqs: list[np.ndarray], times: np.ndarray) -> None:
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        self.seqs, self.times = [seqs[i] for i in order if len(seqs[i])], np.array([times[i] for i in order if len(seqs[i])], np.int64)
        self.sizes = np.array([len(x) for x in self.seqs], np.int64)
        self._groups: list[tuple[int, list[_Slab]]] = []
        for first in range(0, len(self.seqs), ROWS):
            sizes, slabs = self.sizes[first : first + ROWS], []
            digits = np.full((CONTEXT + int(sizes[0]) + PLACES + REACH + TOGETHER, len(sizes)), 4, np.uint8)
            for r, x in enumerate(self.seqs[first : first + ROWS]):
                digits[CONTEXT : CONTEXT + len(x), r] = np.where(x < 0, 4, x)
            for at in range(0, int(sizes[0]) + 1, PLACES):
                part = digits[at : at + CONTEXT + PLACES + REACH + TOGETHER - 1, : int(np.searchsorted(-sizes, -at, side="right"))].astype(np.uint16)
                codes = np.zeros((CONTEXT + PLACES + REACH, part.shape[1]), np.uint16)
                for j in range(TOGETHER):
                    codes *= 5
                    codes += part[j : j + len(codes)]
                slabs.append(_Slab(at, codes))
            self._groups.append((first, slabs))
        self._of: tuple = ()
        self._safe, self._lowest = False, 0.0
        self._alone = np.zeros(len(self.seqs))
        self._batches: list[Batch] | None = None

    def dump(self) -> bytes:
        """As arrays alone, since executors need not have this package."""
        state = {k: getattr(self, k) for k in self.STATE}
        return pickle.dumps((np.concatenate(self.seqs), [(first, [(s.at, s.codes, s.upto) for s in slabs]) for first, slabs in self._groups], state), 5)

    @classmethod
    def load(cls, data: bytes) -> Deck:
        letters, groups, state = pickle.loads(data)
        out = cls.__new__(cls)
        vars(out).update(state, seqs=np.split(letters, np.cumsum(state["sizes"])[:-1]), _batches=None)
        out._groups = [(first, [_Slab(*s) for s in slabs]) for first, slabs in groups]
        return out

    def score(self, models: list[Model]) -> list[int]:
        """The likelihood of all sequences under each model, in steps of 1 / STEPS."""
        if not self.seqs:
            return [0] * len(models)
        out, alike = [0] * len(models), {}
        for k, m in enumerate(models):
            alike.setdefault((len(m.pieces), m.bg.tobytes(), m.mean_length, m.both_strands), []).append(k)
        for places in alike.values():
            fast = self.settle(models[places[0]]) and [k for k in places if self._fits(models[k])] or []
            fast.sort(key=lambda k: models[k].pieces[0].spans[0])
            for at in range(0, len(fast), ABREAST):
                for k, found in zip(fast[at : at + ABREAST], self._read([models[k] for k in fast[at : at + ABREAST]]), strict=True):
                    out[k] = in_steps(self._alone + found, self.times)
            for k in sorted({*places} - {*fast}):
                if self._batches is None:
                    self._batches = batches(self.seqs)
                out[k] = sum(in_steps(b.score(models[k]), self.times[b.place]) for b in self._batches)
        return out

    @staticmethod
    def _fits(m: Model) -> bool:
        return not m.active and all(len(p.blocks) == 1 and len(p.blocks[0]) <= REACH and p.tables().safe for p in m.pieces)

    def settle(self, m: Model) -> bool:
        """What depends on the background and the chance of a motif; whether that can be read side by side."""
        order = round(np.log(len(m.bg)) / np.log(4))
        if (key := (m.bg.tobytes(), m.mean_length, len(m.pieces))) == self._of or not m.pieces or order > CONTEXT:
            return self._safe and bool(m.pieces) and order <= CONTEXT
        stay = np.log2(1 - min(len(m.pieces) / m.mean_length, 0.9999))
        # Of the first order + 1 letters of a window the last one's weight.
        weights = np.full((5,) * (order + 1), -2.0)
        weights[(slice(4),) * (order + 1)] = m.bg.reshape((4,) * (order + 1))
        weights = np.repeat(weights.ravel(), 5 ** (TOGETHER - order - 1)) + stay
        self._of, self._safe = key, bool(np.isfinite(weights).all() and weights.min() > LEAST)
        if self._safe:
            self._alone[:] = 0.0
            self._lowest = float(weights.min())
            for first, slabs in self._groups:
                for slab in slabs:
                    log = np.zeros((PLACES + REACH, slab.n))
                    np.cumsum(weights[slab.codes[CONTEXT - order : CONTEXT - order + PLACES + REACH - 1]], axis=0, out=log[1:])
                    own = slice(first, first + slab.n)
                    self._alone[own] += log[np.minimum(self.sizes[own] - slab.at, PLACES), np.arange(slab.n)]
                    slab.upto = np.exp2(log)
        return self._safe

    @staticmethod
    def _tables(models: list[Model], blocks: int) -> list[list[np.ndarray]]:
        """By strand, block of TOGETHER letters and number of a window: the weights of each motif."""
        pieces = [p for m in models for p in m.pieces]
        out = [[np.ones((5**TOGETHER, len(pieces))) for _ in range(blocks)] for _ in range(1 + models[0].both_strands)]
        for c, p in enumerate(pieces):
            for strand, tables in zip(out, p.tables().strands, strict=False):
                for to, table in zip(strand, tables, strict=False):
                    to[:, c] = np.repeat(table, 5**TOGETHER // len(table))
        for strand in out:
            strand[0] *= 1 / models[0].mean_length
        return out

    def _read(self, models: list[Model]) -> np.ndarray:
        """log2 of what all ways to read a sequence weigh over the background's, (models, sequences); models of one number of motifs and one setting."""
        each = len(models[0].pieces)
        order = sorted(range(len(models)), key=lambda k: len(models[k].pieces[0].blocks[0]))
        models = [models[k] for k in order]
        spans = [len(p.blocks[0]) for m in models for p in m.pieces]
        reach, block, columns, wide = max(spans), min(spans), len(spans), len(models)
        tables = self._tables(models, -(-reach // TOGETHER))
        # An instance weighs at most so many bits, and a block's places so many: so many blocks go by before a look at the largest.
        most = max(p.tables().most for m in models for p in m.pieces) - reach * self._lowest - np.log2(models[0].mean_length)
        often = max(1, int(LARGE / (max(most, 0.0) + np.log2(1 + each * block))))
        # Columns of one motif of all models that have one span, side by side.
        runs = [(spans[lo * each + m], slice(lo, hi), slice(lo * each + m, (hi - 1) * each + m + 1, each), m) for m in range(each) for lo, hi in _runs(spans[m::each])]
        room = np.empty((3, max(CLOSE, block * ROWS) * columns))
        out = np.zeros((wide, len(self.seqs)))
        for first, slabs in self._groups:
            n = slabs[0].n
            carry, scale = np.ones((n, wide)), np.zeros((n, wide))
            # What instances weigh by their start, those of the last slab first.
            held = np.zeros((reach + PLACES, n, columns))
            sums = np.empty((block, n, wide))
            for s, slab in enumerate(slabs):
                if slab.n < n:
                    n = slab.n
                    held, carry, scale, sums = held[:, :n].copy(), carry[:n].copy(), scale[:n].copy(), np.empty((block, n, wide))
                close = max(block, CLOSE // n // block * block)
                for b, lo in enumerate(range(0, PLACES, block), 1):
                    hi = min(lo + block, PLACES)
                    if lo % close == 0:
                        self._weigh(slab, lo, min(lo + close, PLACES), tables, spans, held[reach:], room)
                    add = sums[: hi - lo]
                    for span, to, columns_of, m in runs:
                        part = held[reach + lo - span : reach + hi - span, :, columns_of]
                        if m:
                            add[:, :, to] += part
                        else:
                            add[:, :, to] = part
                    add[0] += carry
                    if n * wide < BROAD:
                        np.add.accumulate(add, 0, None, add)
                    else:
                        before = add[0]
                        for row in add[1:]:
                            before = np.add(before, row, row)
                    carry = add[-1].copy()
                    for m in range(each):
                        held[reach + lo : reach + hi, :, m::each] *= add
                    if (b % often == 0 or hi == PLACES) and carry.max() > 2.0**LARGE:
                        down = np.where(carry > 2.0**LARGE, np.floor(np.log2(carry)), 0.0)
                        scale += down
                        carry *= np.exp2(-down)
                        for m in range(each):
                            held[hi : reach + hi, :, m::each] *= np.exp2(-down)
                held[:reach] = held[PLACES:]
                left = slabs[s + 1].n if s + 1 < len(slabs) else 0
                out[:, first + left : first + n] = (np.log2(carry[left:]) + scale[left:]).T
        return out[np.argsort(order)]

    @staticmethod
    def _weigh(slab: _Slab, lo: int, hi: int, tables: list[list[np.ndarray]], spans: list[int], into: np.ndarray, room: np.ndarray) -> None:
        """The weights over the background's of instances that start at places ``lo`` to ``hi``, the better strand's."""
        shape = (hi - lo, slab.n, len(spans))
        new, other, more = (into[lo:hi], *(x[: math.prod(shape)].reshape(shape) for x in room[1:]))
        for k, strand in enumerate(tables):
            to = other if k else new
            for i, table in enumerate(strand):
                at = CONTEXT + i * TOGETHER
                np.take(table, slab.codes[at + lo : at + hi], axis=0, out=more if i else to, mode="clip")
                if i:
                    to *= more
        if len(tables) > 1:
            np.maximum(new, other, out=new)
        for span in {*spans}:
            beside = slab.upto[lo:hi] / slab.upto[lo + span : hi + span]
            for c, own in enumerate(spans):
                if own == span:
                    new[..., c] *= beside


def _runs(values: list[int]) -> list[tuple[int, int]]:
    """Where equal values begin and end."""
    starts = [i for i, v in enumerate(values) if not i or v != values[i - 1]]
    return list(zip(starts, [*starts[1:], len(values)], strict=True))


#: Bases of a deck that is kept, about; it holds some 16 bytes a base.
DECK = 4_000_000


@dataclass
class Decks:
    """A corpus as decks that the cluster keeps, for job after job that scores a few models: a job then reads arrays and plans nothing."""

    kept: RDD

    @classmethod
    def of(cls, corpus: DataFrame, model: Model) -> Decks:
        """Of ``(times, seq)``, made for models of the setting of ``model``."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            times: list[int] = []
            seqs: list[np.ndarray] = []
            bases = 0

            def made() -> pa.RecordBatch:
                deck = Deck(seqs, np.array(times, np.int64))
                deck.settle(model)
                return pa.RecordBatch.from_pydict({"n": pa.array([len(seqs)], pa.int64()), "deck": pa.array([deck.dump()], pa.binary())})

            for part in parts:
                for n, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    times.append(n)
                    seqs.append(encode(x))
                    bases += len(x)
                    if bases >= DECK:
                        yield made()
                        times, seqs, bases = [], [], 0
            if times:
                yield made()

        rows = corpus.select(F.col("times").cast("long"), "seq").mapInArrow(run, "n long, deck binary")
        return cls(rows.rdd.map(lambda r: (r["n"], bytes(r["deck"]))).persist(StorageLevel.MEMORY_AND_DISK))

    def count(self) -> int:
        """Sequences."""
        return self.kept.map(lambda x: x[0]).sum()

    def score(self, models: list[Model]) -> list[int]:
        """In steps; a task sums its part, so a few numbers a task come to the driver."""

        def run(decks: Iterator[tuple[int, bytes]]) -> Iterator[list[int]]:
            found = [0] * len(models)
            for _, deck in decks:
                found = [a + x for a, x in zip(found, Deck.load(deck).score(models), strict=True)]
            yield found

        return [sum(own) for own in zip(*self.kept.mapPartitions(run).collect(), strict=True)]

    def unpersist(self) -> None:
        self.kept.unpersist()


def score_models(corpus: DataFrame | Decks, models: list[Model]) -> DataFrame | list[dict]:
    """``(model_id, log2_lik)`` over the corpus: a task sums its part, so one row a task and model is shuffled.

    A row of a corpus with ``times`` counts so many times. Of :class:`Decks` the rows are a list.
    """
    if isinstance(corpus, Decks):
        return [{"model_id": k, "log2_lik": x / STEPS} for k, x in enumerate(corpus.score(models))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0] * len(models)
        for part in portions(parts):
            times = part.column(0).to_numpy(zero_copy_only=False)
            found = [a + in_steps(x, times) for a, x in zip(found, score([encode(s) for s in part.column(1).to_pylist()], models), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(found, pa.int64())], names=["model_id", "steps"])

    times = F.col("times") if "times" in corpus.columns else F.lit(1)
    sums = corpus.select(times.cast("long").alias("times"), "seq").mapInArrow(run, "model_id int, steps long").groupBy("model_id").agg(F.sum(F.col("steps").cast("decimal(38,0)")).alias("s"))
    return sums.select("model_id", (F.col("s").cast("double") / STEPS).alias("log2_lik"))


def context_letters(models: list[Model]) -> int:
    """Letters before a piece that its likelihood depends on: those of an instance that ends in it, and of the background before that."""
    spans = [p.spans[1] for m in models for p in m.pieces]
    orders = [round(np.log(len(m.bg)) / np.log(4)) for m in models]
    return max(spans, default=1) - 1 + max(orders, default=0)


def transfer(before: np.ndarray, x: np.ndarray, model: Model) -> tuple[np.ndarray, float, float]:
    """:func:`transfers` of one piece."""
    held, exponent, background = transfers(before[None, :], x[None, :], model)
    return held[0], float(exponent[0]), float(background[0])


def transfers(before: np.ndarray, x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pieces of one length, a row each, do to the recursion: ``(matrices, exponents, backgrounds)``.

    The state is the recursion's last values, the newest first, relative to a read of background
    bases alone, as many as the longest motif has bases; gap lengths are taken by layout. All columns of the unit matrix go
    through the recursion side by side; a matrix counts times 2^exponent, and its background
    is the log2 weight of reading the piece as background.
    """
    both = np.concatenate([before, x], axis=1)
    codes, bg = window_codes(both), _background(both, model.bg)
    pieces = [p for i, p in enumerate(model.pieces) if not model.active or model.active[i]]
    each = 1 / model.mean_length
    stay, enter = (np.log2(1 - min(len(pieces) * each, 0.9999)), np.log2(each)) if pieces else (0.0, 0.0)
    upto = np.concatenate([np.zeros((len(both), 1)), np.cumsum(bg + stay, axis=1)], axis=1)
    ratios: dict[int, np.ndarray] = {}
    for span, m in _moves(both, pieces, bg, model.both_strands, codes):
        gain = m + enter - (upto[:, span:] - upto[:, : upto.shape[1] - span])
        if gain.max(initial=-np.inf) > LARGE:
            raise ValueError("a motif's weight over the background's is beyond 2^300")
        ratios[span] = ratios.get(span, 0) + np.exp2(gain)
    depth = max([p.spans[1] for p in pieces], default=1)
    # Rows are places, oldest first; columns are the unit states.
    held = np.repeat(np.eye(depth)[None, ::-1], len(both), axis=0)
    exponent, c, n = np.zeros(len(both)), before.shape[1], both.shape[1]
    step = min(ratios, default=max(1, x.shape[1]))
    for lo in range(c, n, step):
        hi = min(lo + step, n)
        add = np.zeros((len(both), hi - lo, depth))
        for span, r in ratios.items():
            # An instance that ends at place i begins at i - span, which is not before what is known.
            first = max(lo + 1, span)
            if first <= hi:
                at = slice(first - span - (lo - depth + 1), hi - span - (lo - depth + 1) + 1)
                add[:, first - lo - 1 :] += held[:, at] * r[:, first - span : hi - span + 1, None]
        add[:, 0] += held[:, -1]
        held = np.concatenate([held, np.cumsum(add, axis=1)], axis=1)[:, -depth:]
        top = held.max(axis=(1, 2))
        far = np.flatnonzero((top > 2.0**LARGE) | (top > 0) & (top < 2.0**-LARGE))
        if len(far):
            down = np.floor(np.log2(top[far]))
            held[far] *= np.exp2(-down)[:, None, None]
            exponent[far] += down
    return held[:, ::-1], exponent, upto[:, n] - upto[:, c]


#: Numbers of the matrices and letters of pieces that are worked on side by side.
SIDE_BY_SIDE = 200_000


def score_pieces(pieces: DataFrame, models: list[Model]) -> DataFrame:
    """``(seq_id, model_id, log2_lik)`` of records that come in pieces ``(seq_id, at, seq, before)``, as :func:`score_sequences` of whole ones.

    ``before`` holds the last :func:`context_letters` letters of the piece before, which must be so
    long (``with_context`` of :mod:`seqloom.sources.fasta_source`); a record's first piece has none.
    Each piece's transfer matrix is made apart, so a record is worked on by many tasks; a
    record's matrices, a few kilobytes each, are multiplied in the order of its pieces.
    """
    kinds = "model_id int, at long, matrix array<double>, exponent double, background double"
    id_type = pieces.schema["seq_id"].dataType.simpleString()
    deepest = max((p.spans[1] ** 2 for m in models for p in m.pieces), default=1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ats, seqs, befores = (part.column(i).to_pylist() for i in (1, 2, 3))
            alike: dict[tuple[int, int], list[int]] = {}
            for i, (s, b) in enumerate(zip(seqs, befores, strict=True)):
                alike.setdefault((len(b or ""), len(s or "")), []).append(i)
            rows: list[dict] = [{} for _ in range(part.num_rows * len(models))]
            for (context, letters), own in alike.items():
                size = max(1, SIDE_BY_SIDE // (context + letters + deepest))
                for some in (own[i : i + size] for i in range(0, len(own), size)):
                    before, x = (np.stack([encode(texts[i] or "") for i in some]) for texts in (befores, seqs))
                    for k, model in enumerate(models):
                        for i, matrix, exponent, background in zip(some, *transfers(before, x, model), strict=True):
                            rows[i * len(models) + k] = {"model_id": k, "at": ats[i], "matrix": matrix.ravel(), "exponent": exponent, "background": background}
            made = pa.RecordBatch.from_pylist(rows, pa.schema([("model_id", pa.int32()), ("at", pa.int64()), ("matrix", pa.list_(pa.float64())), ("exponent", pa.float64()), ("background", pa.float64())]))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(models))))
            yield pa.RecordBatch.from_arrays([ids, *made.columns], names=["seq_id", *made.schema.names])

    def multiplied(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by record and in order; a record may go on in the next batch."""
        now, state, total = None, np.empty(0), 0.0
        for part in parts:
            ids, kept, liks = part.column(0).to_pylist(), [], []
            for key, matrix, exponent, background in zip(zip(ids, part.column(1).to_pylist(), strict=True), *(part.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                if key != now:
                    if now is not None:
                        kept.append(now)
                        liks.append(total + float(np.log2(state[0])))
                    now, total, depth = key, 0.0, round(len(matrix) ** 0.5)
                    state = np.eye(depth)[0]
                state = np.array(matrix).reshape(depth, depth) @ state
                top = np.floor(np.log2(state.max()))
                state, total = state * np.exp2(-top), total + background + exponent + top
            yield as_batch(part.schema.field(0).type, kept, liks)
        if now is not None:
            yield as_batch(part.schema.field(0).type, [now], [total + float(np.log2(state[0]))])

    def as_batch(kind: pa.DataType, keys: list[tuple], liks: list[float]) -> pa.RecordBatch:
        columns = [pa.array([i for i, _ in keys], kind), pa.array([k for _, k in keys], pa.int32()), pa.array(liks, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["seq_id", "model_id", "log2_lik"])

    made = pieces.select("seq_id", "at", "seq", "before").mapInArrow(run, f"seq_id {id_type}, {kinds}")
    ordered = made.repartition("seq_id", "model_id").sortWithinPartitions("seq_id", "model_id", "at")
    return ordered.mapInArrow(multiplied, f"seq_id {id_type}, model_id int, log2_lik double")
