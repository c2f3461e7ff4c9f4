"""Toxicity by a linear-chain conditional random field over two tags, fine and toxic.

Labels mark documents, so tokens are labelled first: in a toxic training document a token is
toxic if one of its features (the word, its first 4 to 8 letters) is tied to toxic documents
by a likelihood-ratio test. The field is fitted to these by penalised likelihood with
gradients from forward-backward. A document's score is a logistic function of its tokens'
marginals, fitted on the same sample; runs of tokens with a marginal of 0.5 or more are its
offending spans. Fitting uses a bounded sample (see :func:`train`); scoring reads every text
whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import lean

WORD = re.compile(r"\w+")
#: Likelihood ratio (twice the log) beyond which a feature is tied to toxic documents.
LLR = 20.0
PREFIXES = (4, 5, 6, 7, 8)
#: Clean documents that the field is fitted to, if not more by the number of toxic ones.
MOST_CLEAN = 2400
#: Weights nearer to zero are left out of a model.
LEAST_WEIGHT = 0.01
#: Tokens before and after a block whose influence on the block's marginals is followed.
WARM, BLOCK, CHUNK = 64, 256, 400_000
_MEMO = 150_000
SPANS = "struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>"


def features(word: str) -> list[str]:
    """The word itself, its last 3 letters and its prefixes of 4 to 8 letters."""
    out = ["w=" + word, "s=" + word[-3:]]
    return out + [f"p{k}=" + word[:k] for k in PREFIXES if len(word) >= k]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def marginals(unary: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over concatenated sequences.

    ``unary``: log odds of the toxic tag by token. ``starts``: whether a token begins a
    sequence. ``trans``: 2 x 2 log potentials. Returns each token's marginal, and the forward
    odds, backward odds and transition odds that pair marginals are made of. Blocks run side
    by side; each first runs through the WARM tokens next to it, after which nothing is left
    of where it began (a 2 x 2 positive matrix contracts).
    """
    n = len(unary)
    e = np.exp(trans - trans.max())
    w = np.exp(np.clip(unary, -40, 40))
    cols = -(-n // BLOCK)

    def run(w: np.ndarray, cut: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Odds before each token's own factor; ``cut``: nothing comes before the token."""
        size = cols * BLOCK
        pad_w = np.ones(size + WARM)
        pad_w[WARM : WARM + n] = w
        pad_c = np.zeros(size + WARM, bool)
        pad_c[WARM : WARM + n] = cut
        pad_c[WARM] = True
        at = np.arange(cols) * BLOCK
        odds = np.ones(cols)
        out = np.empty((BLOCK, cols))
        for t in range(WARM + BLOCK):
            i = at + t
            inn = (odds * m[1, 1] + m[0, 1]) / (odds * m[1, 0] + m[0, 0])
            inn[pad_c[i]] = 1.0
            if t >= WARM:
                out[t - WARM] = inn
            odds = inn * pad_w[i]
        return out.T.ravel()[:n]

    before = run(w, starts, e)
    ends = np.append(starts[1:], True)
    after = run(w[::-1], ends[::-1], e.T)[::-1]
    odds = before * w * after
    return odds / (1 + odds), before, after, w


def pair_counts(before: np.ndarray, after: np.ndarray, w: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring tags."""
    to = np.flatnonzero(~starts)
    left, right = (before * w)[to - 1], (w * after)[to]
    e = np.exp(trans - trans.max())
    p = np.stack([e[0, 0] + 0 * left, e[0, 1] * right, e[1, 0] * left, e[1, 1] * left * right])
    return (p / p.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    head: list[float] = field(default_factory=lambda: [-6.0, 0.0, 0.0, 0.0])

    def unary(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def score_all(self, texts: list[str | None]) -> Iterator[tuple[float, list[dict]]]:
        """Score and spans (code points) of each text."""
        memo: dict[str, float] = {}
        lists, total = [], 0
        for i, text in enumerate(texts):
            words = WORD.findall(text.lower()) if text else []
            if len(memo) > _MEMO:
                memo.clear()
            u = np.empty(len(words))
            for j, x in enumerate(words):
                if (v := memo.get(x)) is None:
                    v = memo[x] = self.unary(x)
                u[j] = v
            lists.append(u)
            total += len(u)
            if total > CHUNK or i == len(texts) - 1:
                yield from self._finish(texts[i + 1 - len(lists) : i + 1], lists)
                lists, total = [], 0

    def _finish(self, texts: list[str | None], lists: list[np.ndarray]) -> Iterator[tuple[float, list[dict]]]:
        ps = token_marginals(lists, np.array(self.trans))
        for text, p in zip(texts, ps, strict=True):
            score = float(_sigmoid(document_features(p) @ np.array(self.head)))
            yield score, spans(text, p) if len(p) and p.max() >= 0.5 else []


def token_marginals(lists: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in lists], int)
    if not sizes.sum():
        return [np.empty(0) for _ in lists]
    at = np.cumsum(sizes)
    starts = np.zeros(at[-1], bool)
    starts[(at - sizes)[sizes > 0]] = True
    p = marginals(np.concatenate(lists), starts, trans)[0]
    return np.split(p, at[:-1])


def document_features(p: np.ndarray) -> np.ndarray:
    """One, the largest and second largest marginal, log of 1 plus the sum of those of 0.2 or more."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
    return np.array([1.0, top[1], top[0], np.log1p(p[p >= 0.2].sum())])


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of 0.5 or more, with their largest marginal.

    Where lower-casing changes a text's length, words are taken from the text as it is.
    """
    low = text.lower()
    out: list[dict] = []
    last = -2
    for j, m in enumerate(WORD.finditer(low if len(low) == len(text) else text)):
        if j < len(p) and p[j] >= 0.5:
            if last == j - 1:
                out[-1] |= {"end": m.end(), "marginal": max(out[-1]["marginal"], float(p[j]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "marginal": float(p[j])})
            last = j
    return out


def tied(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features occur in toxic documents more than chance allows (likelihood-ratio test).

    ``toxic`` and ``clean`` count the documents of either kind that have each feature.
    """
    a, b = toxic.astype(float), clean.astype(float)
    xlog = lambda k, n: np.where(k > 0, k * np.log(np.maximum(k, 1) / n), 0.0)
    full = xlog(a, n_toxic) + xlog(n_toxic - a, n_toxic) + xlog(b, n_clean) + xlog(n_clean - b, n_clean)
    both = xlog(a + b, n_toxic + n_clean) + xlog(n_toxic + n_clean - a - b, n_toxic + n_clean)
    return (a >= 3) & (a * n_clean > 4 * b * n_toxic) & (2 * (full - both) >= LLR)


def distinct(docs: list[np.ndarray], sketch: int = 16, least: int = 4) -> np.ndarray:
    """Numbers of the documents that aren't copies or near copies of an earlier one.

    Copies of one toxic document would tie all its words to toxicity. A copy shares ``least``
    or more of the ``sketch`` smallest hashes of its three-word sequences with one document;
    shorter documents are copies if they are equal.
    """
    owner: dict[int, int] = {}
    whole: set[bytes] = set()
    out = []
    for i, words in enumerate(docs):
        w = words.astype(np.uint64) + np.uint64(1)
        if (raw := words.tobytes()) in whole:
            continue
        if len(w) >= 3:
            h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (w[2:] * np.uint64(0x165667B19E3779F9))
            h = np.unique((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9))[:sketch].tolist()
            seen = [owner[x] for x in h if x in owner]
            if seen and max(map(seen.count, set(seen))) >= min(least, len(h)):
                continue
            for x in h:
                owner.setdefault(x, i)
        whole.add(raw)
        out.append(i)
    return np.array(out, int)


def _minimise(value, x: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        if past:
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y), al in zip(past, reversed(alphas), strict=True):
            q += s * (al - y @ q / (y @ s))
        step = 1.0
        while step > 1e-6:
            new = x - step * q
            fn, gn = value(new)
            if fn <= f - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            return x
        if (new - x) @ (gn - g) > 1e-12:
            past = [*past, (new - x, gn - g)][-8:]
        done = abs(f - fn) < 1e-6 * max(1.0, abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x


def fit(texts: list[str], toxic: list[int], prior: float, rounds: int = 40) -> Model:
    """A model from a sample; ``prior`` is the share of toxic documents among all labelled ones.

    Without both labels in the sample the model scores every text alike, by the prior.
    """
    y = np.array(toxic, bool)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    flat_model = Model(bias=-20.0, head=[float(np.log(prior / (1 - prior))), 0.0, 0.0, 0.0])
    if not 0 < y.sum() < len(y):
        return flat_model
    vocab: dict[str, int] = {}
    index = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
    once = distinct(index)
    index, y = [index[i] for i in once], y[once]
    if not 0 < y.sum() < len(y):
        return flat_model
    # Features are those of words in toxic documents.
    fid: dict[str, int] = {}
    of = np.full((len(vocab), 2 + len(PREFIXES)), -1, np.int32)
    toxic_words = np.zeros(len(vocab), bool)
    toxic_words[np.concatenate([i for i, t in zip(index, y, strict=True) if t])] = True
    for own in (True, False):
        for i, w in enumerate(vocab):
            if toxic_words[i] == own:
                for j, f in enumerate(features(w)):
                    of[i, j] = fid.setdefault(f, len(fid)) if own else fid.get(f, -1)
    counts = np.zeros((2, len(fid)), np.int64)
    for idx, t in zip(index, y, strict=True):
        here = np.unique(of[np.unique(idx)])
        counts[int(t), here[here >= 0]] += 1
    words = np.array([f[0] == "w" for f in fid], bool)
    usable = np.array([f[0] != "s" and not f[f.index("=") + 1 :].isdigit() for f in fid], bool)
    marked = np.append(tied(counts[1], counts[0], int(y.sum()), int((~y).sum())) & usable, False)
    if not marked.any():
        return flat_model
    bad = marked[of].any(axis=1)
    # All documents have been counted; the field is fitted to the toxic ones and not many more clean ones.
    some = np.flatnonzero(y | (np.cumsum(~y) <= max(MOST_CLEAN, int(1.5 * y.sum()))))
    index, y = [index[i] for i in some], y[some]
    kept = (np.bincount(of[of >= 0], minlength=len(fid)) >= 2) | words & (counts.sum(axis=0) >= 2)
    number = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)
    rows, place = np.nonzero(number[of] >= 0)
    cols = number[of][rows, place]
    names, nf = list(vocab), int(kept.sum())
    sizes = np.array([len(i) for i in index])
    flat = np.concatenate(index)
    starts = np.zeros(len(flat), bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    tag = bad[flat] & np.repeat(y, sizes)
    went = np.flatnonzero(~starts)
    seen_pairs = np.bincount(2 * tag[went - 1] + tag[went], minlength=4).reshape(2, 2).astype(float)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative penalised log likelihood and its gradient, a document's average."""
        w, bias, trans = x[:nf], x[nf], np.array([[0.0, x[nf + 1]], [x[nf + 2], x[nf + 3]]])
        by_word = bias + np.bincount(rows, w[cols], minlength=len(names))
        u = by_word[flat]
        p, before, after, ew = marginals(u, starts, trans)
        # log Z = sum of the logs of what normalises each forward step
        e = np.exp(trans)
        prev = np.where(starts, 0.0, np.roll(before * ew, 1))
        base = np.where(starts, 1.0, (e[0, 0] + e[1, 0] * prev) / (1 + prev))
        z = np.log(base).sum() + np.log1p(before * ew).sum()
        expected = pair_counts(before, after, ew, starts, trans)
        gold = u[tag].sum() + (seen_pairs * trans).sum()
        err = p - tag
        g = np.empty_like(x)
        g[:nf] = np.bincount(cols, np.bincount(flat, err, minlength=len(names))[rows], minlength=nf) + w
        g[nf] = err.sum()
        g[nf + 1 :] = (expected - seen_pairs).ravel()[1:] + 0.1 * x[nf + 1 :]
        f = z - gold + 0.5 * (w @ w) + 0.05 * (x[nf + 1 :] @ x[nf + 1 :])
        return f / len(y), g / len(y)

    start = np.zeros(nf + 4)
    start[nf] = -5.0
    x = _minimise(value, start, rounds)
    weights = {f: float(x[number[i]]) for f, i in fid.items() if kept[i] and abs(x[number[i]]) > LEAST_WEIGHT}
    model = Model(weights, float(x[nf]), [[0.0, float(x[nf + 1])], [float(x[nf + 2]), float(x[nf + 3])]])
    by_word = np.array([model.unary(w) for w in names])
    m = np.array([document_features(p) for p in token_marginals([by_word[i] for i in index], np.array(model.trans))])
    share = y.mean()
    weight = np.where(y, prior / share, (1 - prior) / (1 - share))

    def logistic(h: np.ndarray) -> tuple[float, np.ndarray]:
        s = m @ h
        f = (weight * (np.logaddexp(0, s) - y * s)).sum() + 0.05 * (h[1:] @ h[1:])
        g = m.T @ (weight * (_sigmoid(s) - y))
        g[1:] += 0.1 * h[1:]
        return f / len(y), g / len(y)

    model.head = [float(v) for v in _minimise(logistic, np.array([-3.0, 0.0, 0.0, 0.0]), 200)]
    return model


def held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 1200, clean_rows: int = 3600, max_chars: int = 10_000, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled rows, of at most ``max_chars`` characters each.

    The sample is that of the smallest hashes of the id, held-out ids left out. Of several
    labels of one id the larger counts; rows without label, id or text are left out. Ids of
    labelled rows are integers.
    """
    rows = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("id is not null and toxic is not null").filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    counts = rows.groupBy("toxic").count().collect()
    total = sum(r["count"] for r in counts)
    prior = sum(r["count"] for r in counts if r["toxic"] == 1) / total if total else 0.0
    order = F.xxhash64("id")
    ids = [r for t, n in ((0, clean_rows), (1, toxic_rows)) for r in rows.filter(F.col("toxic") == t).orderBy(order, "id").limit(n).collect()]
    if not ids:
        return fit([], [], prior)
    picked = docs.sparkSession.createDataFrame(pd.DataFrame({"id": [r["id"] for r in ids], "toxic": [r["toxic"] for r in ids]}), "id long, toxic int")
    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= max_chars).join(F.broadcast(picked), "id").select("id", "toxic", "text")
    )

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {(r["id"], r["text"]): r["toxic"] for b in batches for r in b.to_pylist()}
        order = sorted(rows)
        model = fit([t for _, t in order], [rows[k] for k in order], prior)
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(vars(model))]})

    # The sample is bounded, so one task fits the model and the driver stays small.
    return Model(**json.loads(sample.repartition(1).mapInArrow(lean(one), "model string").first()["model"]))


def judge(docs: DataFrame, model: Model, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``to``: struct of score and offending spans (code points, marginal).

    Null and empty texts have no tokens and score as a text without toxic tokens.
    """

    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = list(model.score_all(list(texts)))
            yield pd.DataFrame({"score": [s for s, _ in found], "spans": [x for _, x in found]}, columns=["score", "spans"])

    @F.pandas_udf(SPANS)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(parts)

    return docs.withColumn(to, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, held_out, score, predicted, spans.

    Repeated rows are scored alike; an empty table gives an empty result; without labels all
    scores are equal.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    slim = docs.select(F.col(id_col), F.col(text_col))
    return judge(slim, model, text_col, "found").select(
        id_col, held_out(id_col).alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= threshold).cast("int").alias("predicted"), F.col("found.spans").alias("spans"),
    )
