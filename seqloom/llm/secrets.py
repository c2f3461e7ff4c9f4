"""Secret scans by grammar inference.

Credentials found by fixed patterns serve as labels. For each kind a prefix tree of their
strings, over character classes, has its statistically compatible states merged (Hoeffding
bound) into a probabilistic automaton: first those of equal depth, which keeps what is known
of lengths, then any. Every other token of a text is scored by how much likelier its format
is under an automaton than under one inferred from ordinary tokens, and by whether it is as
likely as the credentials that the automaton comes from. The automata are fitted to a bounded
sample; all texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored, tidy

# Fixed patterns: kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "format")
#: Tokens that the automata score: characters of an assigned secret, a full stop at neither end.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]", re.A)
#: Parts of a kind's credentials, each scored by an automaton of the others, that its floor comes from.
FOLDS = 4
#: Nats by which a token as a whole may fall below the floor: about half a step that no credential of the sample takes.
MARGIN = 2.0
#: Standard deviations by which two states' ends may differ.
ENDS = 3.0
#: Largest part of all other tokens that may be hidden credentials of a kind.
HIDDEN = 1 / 3
#: Tokens whose judgement a task keeps.
_MEMO = 100_000


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, secret)`` of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS) or not text.isascii():
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _class_of(c: str) -> str:
    return "d" if c.isdigit() else "a" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "u" if "A" <= c <= "Z" else "p"


_CLASSES = {i: _class_of(chr(i)) for i in range(128)}


def symbols(token: str) -> str:
    """Character classes: a hex letter, l other lower, u upper, d digit, p the rest; the first four characters as they are if upper."""
    out = token.translate(_CLASSES) if token.isascii() else "".join(map(_class_of, token))
    return "".join(c if "A" <= c <= "Z" else x for c, x in zip(token[:4], out, strict=False)) + out[4:]


@dataclass
class State:
    count: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    times: Counter = field(default_factory=Counter)


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states: of equal depth, then by red and blue sets."""

    def __init__(self, strings: list[str], confidence: float = 0.05) -> None:
        self.confidence = confidence
        self.overall = Counter(c for s in strings for c in [*s, ""])
        self.size = self.overall.total()
        self.states = [State()]
        for s in strings:
            at = 0
            for c in s:
                state = self.states[at]
                state.count += 1
                state.times[c] += 1
                if c not in state.next:
                    state.next[c] = len(self.states)
                    self.states.append(State())
                at = state.next[c]
            self.states[at].count += 1
            self.states[at].ends += 1
        self._into = list(range(len(self.states)))
        #: Steps by state and symbol, as far as they have been asked for.
        self._steps: dict[tuple[int, str], tuple[float, int]] = {}
        self._level()
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.confidence))
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    @staticmethod
    def _end_apart(x: State, y: State) -> bool:
        """Whether the parts of strings that end differ by more than ENDS standard deviations of their common mean.

        Formats are told apart by length above all, and this sees it from six strings on, the Hoeffding bound only from fifteen.
        """
        p = (x.ends + y.ends) / (x.count + y.count)
        return abs(x.ends / x.count - y.ends / y.count) > ENDS * math.sqrt(p * (1 - p) * (1 / x.count + 1 / y.count))

    def _at(self, i: int) -> int:
        """The state that ``i`` has been merged into."""
        while self._into[i] != i:
            self._into[i] = self._into[self._into[i]]
            i = self._into[i]
        return i

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no two states reached alike from both differ in how often a string ends or goes on by a symbol."""
        todo, seen = [(a, b)], set()
        while todo:
            pair = tuple(map(self._at, todo.pop()))
            if pair in seen or pair[0] == pair[1]:
                continue
            seen.add(pair)
            x, y = (self.states[i] for i in pair)
            if self._end_apart(x, y):
                return False
            for c in x.next.keys() | y.next.keys():
                if self._differ(x.times[c], x.count, y.times[c], y.count):
                    return False
                if c in x.next and c in y.next:
                    todo.append((x.next[c], y.next[c]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Make ``b`` one with ``a``, and so on with what both lead to by the same symbol, so that a string has one way."""
        todo = [(a, b)]
        while todo:
            i, j = map(self._at, todo.pop())
            if i == j:
                continue
            x, y = self.states[i], self.states[j]
            self._into[j] = i
            x.count += y.count
            x.ends += y.ends
            x.times.update(y.times)
            for c, to in y.next.items():
                if c in x.next:
                    todo.append((x.next[c], to))
                else:
                    x.next[c] = to

    def _level(self) -> None:
        """Merge compatible states of equal depth, the largest first, from the root down.

        Strings of random characters part ways after a few steps, and states with a handful of
        strings look alike at any depth; merged level by level they show where strings end.
        """
        level = [0]
        while level:
            below = sorted({self._at(to) for i in level for to in self.states[i].next.values()}, key=lambda i: (-self.states[i].count, i))
            kept: list[int] = []
            for b in below:
                for r in kept:
                    if self._compatible(r, b):
                        self._merge(r, b)
                        break
                else:
                    kept.append(b)
            level = kept

    def _infer(self) -> None:
        """Red states are settled; the largest state next to them is merged with a red one or settled itself."""
        red = [0]
        while True:
            blue = {self._at(to) for i in red for to in self.states[i].next.values()} - set(red)
            if not blue:
                break
            b = min(blue, key=lambda i: (-self.states[i].count, i))
            for r in red:
                if self._compatible(r, b):
                    self._merge(r, b)
                    red = list(dict.fromkeys(map(self._at, red)))
                    break
            else:
                red.append(b)
        number = {i: k for k, i in enumerate(red)}
        for s in (kept := [self.states[i] for i in red]):
            s.next = {c: number[self._at(to)] for c, to in s.next.items()}
        self.states = kept
        del self._into

    def _chance(self, times: int, count: int, c: str) -> float:
        """Chance of a symbol, "" at the end, seen ``times`` of ``count``: 16 more are dealt as the symbols of all strings, with half of one for each of 32."""
        return (times + 16 * (self.overall[c] + 0.5) / (self.size + 16)) / (count + 16)

    def _step(self, at: int, c: str) -> tuple[float, int]:
        """Log chance of a symbol in a state, and where it leads; "" is the end."""
        state = self.states[at]
        if not c:
            step = math.log(self._chance(state.ends, state.count, "")), at
        else:
            to = state.next[c] if c in state.next else state.next[max(state.times, key=lambda x: (state.times[x], x))] if state.next else 0
            step = math.log(self._chance(state.times[c], state.count, c)), to
        self._steps[at, c] = step
        return step

    def score(self, s: str) -> float:
        """Log likelihood of a string; an unseen step is as likely as its symbol is in all strings and leads where most steps lead, or to the start."""
        steps, at, total = self._steps, 0, 0.0
        for c in s:
            chance, at = steps.get((at, c)) or self._step(at, c)
            total += chance
        return total + (steps.get((at, "")) or self._step(at, ""))[0]


def _floor(strings: list[str]) -> float:
    """Likelihood a character that 19 of 20 credentials reach under an automaton of others of their kind."""
    each = []
    for f in range(FOLDS):
        rest = [s for i, s in enumerate(strings) if i % FOLDS != f]
        a = Automaton(rest or strings)
        each += [a.score(s) / len(s) for s in strings[f::FOLDS]]
    return sorted(each)[len(each) // 20]


@dataclass
class Grammars:
    """``kinds``: automaton of each kind; ``plain``: that of ordinary tokens; ``floors``: likelihood a character that 19 of
    20 of each kind's credentials reach, where known; a format counts from ``gain`` nats a character on.
    """

    kinds: dict[str, Automaton]
    plain: Automaton | None
    gain: float = 0.25
    floors: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, strings: dict[str, list[str]], plain: list[str]) -> Grammars:
        """Grammars of every kind that has a credential, from symbols of credentials by kind and of other tokens.

        Other tokens are ordinary ones and credentials that no fixed pattern finds. Those that
        are typical of a kind are left out of the ordinary tokens' grammar, unless they are
        more than HIDDEN of all, when it is the kind that looks like ordinary tokens.
        """
        kinds = {k: Automaton(v) for k, v in strings.items() if v}
        floors = {k: _floor(strings[k]) for k in kinds}
        for k, a in kinds.items():
            alike = {s for s in set(plain) if a.score(s) >= floors[k] * len(s) - MARGIN}
            if sum(s in alike for s in plain) <= HIDDEN * len(plain):
                plain = [s for s in plain if s not in alike]
        return cls(kinds, Automaton(plain) if plain else None, floors=floors)

    def _beats(self, s: str, scores: dict[str, float]) -> float:
        plain = self.plain.score(s) if self.plain else 0.0
        return (max(scores.values()) - plain) / len(s) if scores else -1.0

    def likely(self, token: str) -> float:
        """Nats a character by which the best kind beats ordinary tokens."""
        s = symbols(token)
        return self._beats(s, {k: a.score(s) for k, a in self.kinds.items()})

    def found(self, s: str) -> bool:
        """Whether a token of these symbols is likely, and typical of some kind: about as likely as the credentials that it was inferred from.

        Each automaton is walked once for both.
        """
        scores = {k: a.score(s) for k, a in self.kinds.items()}
        return any(k not in self.floors or x >= self.floors[k] * len(s) - MARGIN for k, x in scores.items()) and self._beats(s, scores) >= self.gain

    def spans(self, text: str, memo: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
        """All spans: those of the fixed patterns, and tokens apart from them that a grammar finds likely and typical.

        ``memo`` keeps what was found of the symbols of tokens.
        """
        base = base_spans(text)
        out = [(s, e, k) for s, e, k, _ in base]
        memo = {} if memo is None else memo
        for m in CANDIDATE.finditer(text):
            if base and any(s < m.end() and m.start() < e for s, e, _, _ in base):
                continue
            of = symbols(m[0])
            if (found := memo.get(of)) is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                found = memo[of] = self.found(of)
            if found:
                out.append((m.start(), m.end(), "format"))
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, tokens = [], []
        for text in batch.column(0):
            t = text.as_py() or ""
            base = base_spans(t)
            for s, e, kind, secret in base:
                kinds.append(kind), tokens.append(secret)
            for m in CANDIDATE.finditer(t):
                if not any(s < m.end() and m.start() < e for s, e, _, _ in base):
                    kinds.append("plain"), tokens.append(m[0])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tokens, pa.string())], names=["kind", "token"])


@tidy
def infer(docs: DataFrame, per_kind: int = 2000, share: float = 1.0, text_col: str = "text") -> Grammars:
    """Grammars from a sample: at most ``per_kind`` distinct tokens of each kind, those of the smallest hashes,
    from all texts; a caller may ask for a smaller ``share`` of them, by hash.

    Every kind with a credential gets a grammar; where there is no credential of any kind nothing
    is added to the base spans.
    """
    texts = docs.select(F.col(text_col).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(10_000)) < int(share * 10_000))
    tokens = stored(texts.mapInArrow(_sample, "kind string, token string").distinct(), "tokens")
    order = F.xxhash64("token")
    strings = {
        kind: sorted(symbols(r["token"]) for r in tokens.filter(F.col("kind") == kind).orderBy(order, "token").limit(per_kind).collect())
        for kind in (*KINDS[:3], "plain")
    }
    plain = strings.pop("plain", [])
    return Grammars.fit(strings, plain)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, grammars: Grammars, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, code points).

    Null texts are empty; repeated rows are scanned alike; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = grammars.spans(text.as_py() or "", memo)
                n = Counter(k for _, _, k in found)
                join = lambda x: ",".join(f"{k}:{s}:{e}" for s, e, k in x)
                base = hashlib.sha256(join([x for x in found if x[2] != "format"]).encode()).hexdigest()
                out.append({"doc_id": i, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": base, "spans": join(found)})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, kinds).withColumnRenamed("doc_id", id_col)
