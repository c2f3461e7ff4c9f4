"""The prefix trie against a plain one, and the vector search against a full scan."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import nearest, queries, trie
from seqloom.llm.common import table

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(convs):
    """Nodes by prefix, from ``{conv_id: [(role, text), ...]}``."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    sha = lambda p, own: hashlib.sha256(",".join(str(c) for c in own if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((own[0], len(p), members[p[:-1]][0] if p else None, len(own), kids[p], leaves[p], saved[p], sha(p, own)) for p, own in members.items())


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + -c % 20
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def turns_of(convs):
    return [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]


def nodes(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed, block", [(1, 50_000), (2, 3), (3, 1)])
def test_random_trees(spark, monkeypatch, seed, block):
    """Few distinct turns, so that many prefixes, whole conversations and depths are shared; small blocks make several levels."""
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(-40, 400), 150):
        start = convs[rng.choice(list(convs))] if convs and rng.random() < 0.6 else []
        cut = start[: rng.randint(0, len(start))]
        convs[c] = cut + [(rng.choice("ua"), " ".join(["w"] * rng.randint(0, 3))) for _ in range(rng.choice([1, 1, 2, 4, 9]))]
    got = nodes(trie.prefix_trie(spark.createDataFrame(turns_of(convs), TURNS)))
    assert got == sorted(plain_trie(rebuilt(convs)), key=lambda r: (r[0], r[1]))


def test_same_as_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = duck.sql(queries.OP11)
    want = sorted((tuple(r[rel.columns.index(c)] for c in NODE) for r in rel.fetchall()), key=lambda r: (r[0], r[1]))
    assert nodes(queries.op11_prefix_trie(spark, SF)) == want


def test_odd_conversations(spark):
    """Null turns come first, null roles and texts are empty, equal turns go by role; turnless and repeated conversations are members."""
    rows = [
        (5, None, "user", "first"), (5, 1, None, None), (5, 1, "a", "x  y"), (None, 0, "user", "nobody"),
        (8, 0, "user", "gone"), (25, 0, "u", "p"), (25, 1, "u", "q"), (25, 2, "u", "r"), (25, 3, "u", "s"), (25, 3, "u", "s"),
    ]
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit("clash").alias("words"), F.lit("clash").alias("seq"))
    convs = {5: [("user", "first"), ("", ""), ("a", "x  y")], 8: [("user", "gone")], 25: [("u", "p"), ("u", "q"), ("u", "r"), ("u", "s"), ("u", "s")]}
    assert nodes(trie.prefix_trie(df)) == sorted(plain_trie(rebuilt(convs)), key=lambda r: (r[0], r[1]))
    assert any(not t for t in rebuilt(convs).values())
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    (one,) = nodes(trie.trie(spark.createDataFrame([(7, [])], "conv_id long, turns array<struct<digest:string,words:long>>")))
    assert one[:7] == (7, 0, None, 1, 0, 1, 0) and one[7] == hashlib.sha256(b"7").hexdigest()


def test_one_conversation_many_times(spark):
    """A third of all conversations are the same long one; each piece of its members' ids is hashed in order."""
    same = [("u", f"turn {i}") for i in range(30)]
    convs = {c: same if c % 3 == 0 else [("u", str(c))] for c in range(300)}
    frame = trie.sequences(spark.createDataFrame(turns_of(convs), TURNS))
    assert nodes(trie.trie(frame)) == sorted(plain_trie(convs), key=lambda r: (r[0], r[1]))


VECS = "vec_id long, embedding array<float>, label int"


def exact(rows, k=10, every=100):
    """Full scan: ``{query: [(d, id), ...]}``."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(float(d[j]), int(ids[j])) for j in order]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_recall_on_a_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want, got = exact(rows), found(queries.op12_nearest(spark, "/root/testdata/sf0.1"))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    true = {(q, i): d for q, v in want.items() for d, i in v}
    assert sum((q, i) in true for q, v in got.items() for _, i in v) >= 0.9 * len(true)
    assert all(abs(true[q, i] - d) < 1e-12 for q, v in got.items() for d, i in v if (q, i) in true)


def test_hot_copies_and_ties(spark):
    """A third of all rows are one vector, queries among them; equal distances go by id. One list holds all, so the result is exact."""
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(60, 260)]
    rows = [(i, v if any(v) else hot) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECS).select("*", *[F.lit(9).alias(c) for c in ("id", "list", "q", "rep", "h1", "n")])
    want, got = exact(rows, every=10), found(nearest.nearest(df, every=10, recall=1.0))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=0, atol=1e-12)


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 16)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(400)]
    got = found(nearest.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECS), every=2, recall=1.0))
    want = exact(rows, every=2)
    assert sum(i in {j for _, j in want[q]} for q, v in got.items() for _, i in v) >= 0.98 * 10 * len(want)
    assert all(len(v) == 10 for v in got.values())


def test_odd_vectors(spark):
    """Null, zero, non-finite and partly null vectors take no part; other lengths are apart; ids that repeat are one."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 1.0, 1.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (100, [5.0, 0.0]), (-100, [1.0, 0.0]), (200, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECS)
    assert found(nearest.nearest(df)) == {
        0: [(0.0, -100), (1.0, 8), (4.0, 100)], -100: [(0.0, 0), (1.0, 8), (4.0, 100)], 100: [(3.0, 8), (4.0, -100), (4.0, 0)], 200: [(pytest.approx(12**0.5), 7)],
    }
    assert nearest.nearest(spark.createDataFrame([], VECS)).count() == 0
    assert found(nearest.nearest(spark.createDataFrame([(0, [1.0], 0)], VECS))) == {}
    twice = found(nearest.nearest(spark.createDataFrame([(0, [1.0], 0), (0, [2.0], 0), (3, [4.0], 0)], VECS)))
    assert twice in ({0: [(3.0, 3)]}, {0: [(2.0, 3)]})


def test_graph_reaches_all():
    rng = np.random.default_rng(3)
    centers = np.concatenate([rng.normal(size=(60, 4)) + 50 * i for i in range(4)])
    graph = nearest.Graph(centers)
    x = np.concatenate([rng.normal(size=(20, 4)) + 50 * i for i in range(4)])
    true = np.sqrt(((x[:, None] - centers) ** 2).sum(axis=2))
    d, ids = graph.nearest(x)
    assert (ids[:, 0] == true.argmin(axis=1)).mean() >= 0.95
    met = [(set(np.flatnonzero(row <= 2 * row.min() * (1 - 1e-4))), set(near.tolist())) for row, near in zip(true, graph.within(x, 2.0), strict=True)]
    assert sum(len(want & near) for want, near in met) >= 0.95 * sum(len(want) for want, _ in met)
