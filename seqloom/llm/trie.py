"""The prefix trie of conversations, from their sorted order.

Each conversation becomes the sequence of its turns' digests. Distinct sequences are sorted over
the cluster; ``lcp[i]`` is the number of first turns that the sequences at i - 1 and i share. A
trie node that branches, or where a sequence ends, is an interval of that order: from the nearest
smaller ``lcp`` on its left up to the one on its right, the Cartesian tree of the array with its
equal values merged. Blocks of the order are worked on apart, each by one pass with a stack; what a
block can't decide are the minima of its beginnings and ends, a few rows, which the next level
treats as an array of its own, until one block holds all. Depths between a node and its parent have
one child each and are filled in. All counts of a subtree are sums over its interval:

* members: the sum of the copies of the sequences;
* childless nodes: the sequences that no other one continues;
* saved words: over the members, all their words; less, over the distinct sequences, the words past
  ``lcp``, which is every node of the subtree once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import sized, stored, tidy

#: Distinct sequences in a block, about; rows that one task of a later level takes.
BLOCK = 50_000
#: Conversation ids in one piece of a node's list of ends.
PIECE = 10_000
#: Bytes of a turn's digest within a sequence.
WIDE = 16

_WORD = r"[^\x20\x09-\x0D]+"


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: per conversation its turns in order as ``(digest, words)``.

    Turns go by number, a null one first, those of one number by role, then by digest. Null roles
    and texts are empty. Rows without conv_id are of no conversation. The digest is half of the
    SHA-256 of role and text; texts themselves are not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * WIDE))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("x"),
    )
    turns = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def shared_starts(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with its first h turns replaced by the first h turns of conversation c - c % ``group``.

    h is the unsigned crc32 of the decimal c modulo ``most``. A start that is absent gives no
    turns, a shorter one all it has. This makes shared prefixes as forked chats have them.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    start = F.when(h > 0, F.slice("start", F.lit(1), F.greatest(h, F.lit(1))))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(F.coalesce(start, F.slice("turns", 1, 0)), rest).alias("turns"))


class _Place:
    """A place of the array with what follows it up to the next place.

    ``lcp`` is its value, ``id`` the name of its node, ``at`` its position in the order, ``same``
    how many places of its value it stands for. ``n`` copies, ``words`` of all copies, childless
    ``leaves``, ``new`` words past each ``lcp`` and the ``least`` id are those of the sequences from
    it on; ``base`` (words up to ``lcp``), ``length``, ``key`` and ``one`` (the class, or the only
    id of it) are of its first sequence.
    """

    __slots__ = ("lcp", "id", "at", "same", "n", "words", "leaves", "new", "least", "base", "length", "key", "one")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values, strict=True):
            setattr(self, name, value)


class _Open:
    """A node whose right end is not known: its ``id``, first and last place, the least ids before (``head``) and from (``tail``) its last place on."""

    __slots__ = ("depth", "id", "first", "last", "same", "head", "tail", "kids")

    def __init__(self, depth: int, name: int, place: int, same: int, head: int | None, tail: int):
        self.depth, self.id, self.first, self.last, self.same, self.head, self.tail, self.kids = depth, name, place, place, same, head, tail, []


_SUMS = ("n", "words", "leaves", "new")
_PLACE = ["lcp", "id", "at", "same", *_SUMS, "least", "base", "length"]
_NODE = ["depth", "up", "own", "at", "parent", "parent_least", "n_convs", "words", "leaves", "new", "least", "n_children", "base"]
_FIELDS = pa.schema(
    [("kind", pa.string()), ("block", pa.int64()), ("place", pa.int64()), *[(c, pa.int64()) for c in dict.fromkeys([*_PLACE, *_NODE])], ("one", pa.int64()), ("key", pa.string()), ("before", pa.list_(pa.int64()))]
)
_DDL = ", ".join(f"{f.name} " + {"string": "string", "int64": "long"}.get(str(f.type), "array<long>") for f in _FIELDS)


class _Out:
    """Rows of ``_FIELDS``, by columns."""

    def __init__(self):
        self.columns: dict[str, list] = {c: [] for c in _FIELDS.names}

    def add(self, **row) -> int:
        for c, values in self.columns.items():
            values.append(row.get(c))
        return len(self.columns["kind"]) - 1

    def table(self) -> pa.Table:
        return pa.table([pa.array(self.columns[f.name], f.type) for f in _FIELDS], schema=_FIELDS)


class _Block:
    """One pass over a block's places with a stack of open nodes."""

    def __init__(self, places: list[_Place], out: _Out, before: Callable[[int, int, int], list[int]] | None = None):
        self.places, self.out, self.before = places, out, before
        self.stack: list[_Open] = []
        self.left: list[tuple[_Open, int]] = []  # nodes without a left end in this block, and where their right end is
        self.sums = {c: np.concatenate([[0], np.cumsum([getattr(p, c) for p in places], dtype=np.int64)]).tolist() for c in _SUMS}

    def between(self, i: int, k: int) -> dict[str, int]:
        return {c: s[k] - s[i] for c, s in self.sums.items()}

    def close(self, k: int, value: int, name: int | None) -> list[int]:
        """End the nodes deeper than ``value``, that of place ``k``; returns the nodes whose parent is the one that place ``k``, ``name``, opens."""
        orphans: list[int] = []
        while self.stack and self.stack[-1].depth > value:
            node = self.stack.pop()
            if not self.stack:
                self.left.append((node, k))
                continue
            below = self.stack[-1]
            i = below.last
            least = min(node.head, node.tail)
            below.tail = min(below.tail, least)
            start = self.places[i]
            up, inside = max(below.depth, value), below.depth >= value
            ends = start.length == node.depth
            sums = self.between(i, k)
            row = self.out.add(
                kind="node", depth=node.depth, up=up, own=node.id, at=start.at, parent=below.id if inside else name, n_convs=sums["n"], words=sums["words"], leaves=sums["leaves"], new=sums["new"],
                least=least, n_children=node.same + (not ends), base=start.base, one=start.one if ends else None, key=start.key if ends else None, before=self.before and self.before(i, up, node.depth),
            )
            for x in node.kids:
                self.out.columns["parent_least"][x] = least
            (below.kids if inside else orphans).append(row)
        return orphans

    def open(self, k: int) -> _Open:
        """Take place ``k``; returns its node, the top of the stack."""
        p = self.places[k]
        orphans = self.close(k, p.lcp, p.id)
        if self.stack and self.stack[-1].depth == p.lcp:
            top = self.stack[-1]
            if p.id != top.id and not self.before:  # in the first level nothing names a later place of a node
                self.out.add(kind="alias", own=p.id, parent=top.id)
            top.head = top.tail if top.head is None else min(top.head, top.tail)
            top.tail, top.last, top.same = p.least, k, top.same + p.same
        else:
            self.stack.append(_Open(p.lcp, p.id, k, p.same, self.stack[-1].tail if self.stack else None, p.least))
        self.stack[-1].kids += orphans
        return self.stack[-1]

    def undecided(self, block: int) -> None:
        """Write the places that the next level needs, in order."""
        m = len(self.places)
        marks = [(node.first, node.id, node.same) for node, _ in self.left]
        if self.stack:
            low, *rest = self.stack
            marks.append((low.first, low.id, low.same))
            if low.last > low.first:
                marks.append((low.last, low.id, 0))
            marks += [(node.last, node.id, node.same) for node in rest]
        for place, (i, name, same) in enumerate(marks):
            k = marks[place + 1][0] if place + 1 < len(marks) else m
            p = self.places[i]
            least = min(x.least for x in self.places[i:k])
            self.out.add(kind="place", block=block, place=place, lcp=p.lcp, id=name, at=p.at, same=same, least=least, base=p.base, length=p.length, key=p.key, one=p.one, **self.between(i, k))


def _shared(a: bytes, b: bytes) -> int:
    """The number of first turns that two sequences share."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // WIDE


def _sorted_block(table: pa.Table) -> pa.Table:
    """A block of sorted sequences, with the last one before it and the first one after it: its nodes and places."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["place"], r["at"]))
    own = [r for r in rows if r["place"] == 0]
    last = next((r["seq"] for r in rows if r["place"] < 0), None)
    after = next((r for r in rows if r["place"] > 0), None)
    out, places, sums, lcps = _Out(), [], [], []
    for r in own:
        lcps.append(-1 if last is None else _shared(last, r["seq"]))
        last = r["seq"]
    lcps.append(_shared(last, after["seq"]) if after else -1)
    for r, lcp, further in zip(own, lcps, lcps[1:], strict=False):
        # the words of the first d - 1 turns, at d
        c = [0, 0, *np.cumsum(r["words"], dtype=np.int64).tolist()]
        sums.append(c)
        length = len(r["seq"]) // WIDE
        base = c[lcp + 1]
        places.append(_Place(lcp, r["at"], r["at"], 1, r["n"], r["n"] * c[-1], int(further < length), c[-1] - base, r["least"], base, length, r["key"] if r["n"] > 1 else None, None if r["n"] > 1 else r["least"]))
    block = _Block(places, out, lambda i, up, depth: sums[i][up + 1 : depth + 1])
    orphans: list[int] = []
    for k, (p, further) in enumerate(zip(places, lcps[1:], strict=True)):
        top = block.open(k)
        top.kids += orphans
        orphans = []
        up = max(p.lcp, further)
        if p.length > up:
            inside = p.lcp >= further
            name = top.id if inside else places[k + 1].id if k + 1 < len(places) else after["at"]
            row = out.add(
                kind="node", depth=p.length, up=up, own=-1 - p.at, at=p.at, parent=name, n_convs=p.n, words=p.words, leaves=1, new=p.new, least=p.least, n_children=0,
                base=p.base, one=p.one, key=p.key, before=sums[k][up + 1 : p.length + 1],
            )
            (top.kids if inside else orphans).append(row)
    block.undecided(own[0]["block"])
    return out.table()


def _place_block(last: bool):
    """A block of undecided places; the ``last`` one ends the array and decides all."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["place"]))
        places = [_Place(*[r[c] for c in _Place.__slots__]) for r in rows]
        out = _Out()
        block = _Block(places, out)
        for k in range(len(places)):
            block.open(k)
        if last:
            block.close(len(places), -1, None)
        else:
            block.undecided(rows[0]["to"])
        return out.table()

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, conv_id)`` rows as pieces ``(key, first, ids)`` of at most PIECE ids."""
    key, ids = None, []
    row = lambda: pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "ids": [",".join(map(str, ids))]})
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE):
                yield row()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as ``(key, ends_sha256)``; a hash goes over its ids in order, so one task reads a key's pieces, one at a time."""
    key, sha = None, None
    row = lambda: pa.RecordBatch.from_pydict({"key": [key], "ends": [sha.hexdigest()]})
    for batch in batches:
        for k, text in zip(batch.column(0), batch.column(1), strict=True):
            if k.as_py() != key:
                if sha:
                    yield row()
                key, sha = k.as_py(), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.as_py().encode())
    if sha:
        yield row()


def _ends(convs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, ends)`` of the classes with several members."""
    many = sized(stored(classes.filter("n > 1").select("key"), "classes-many"))
    members = convs.select("key", "conv_id").join(many, "key")
    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key string, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key string, ends string")


def _sorted(convs: DataFrame, classes: DataFrame, turns: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences in order, ``at`` being their position, and the neighbours that each block needs."""
    spark = convs.sparkSession
    reps = convs.select("conv_id", "seq", "words").join(classes, F.col("conv_id") == F.col("least")).drop("conv_id")
    order = reps.repartitionByRange(max(1, -(-turns // (4 * BLOCK))), "seq").sortWithinPartitions("seq")
    # A row's position: its partition, and its number there.
    order = order.withColumn("block", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id())
    order = stored(order, "sorted")
    ends = sorted(tuple(r) for r in order.groupBy("block").agg(F.min("at"), F.max("at")).collect())
    near = [(last, block, -1) for (_, _, last), (block, _, _) in zip(ends, ends[1:], strict=False)]
    near += [(first, block, 1) for (block, _, _), (_, first, _) in zip(ends, ends[1:], strict=False)]
    at = spark.createDataFrame(near, "at long, to long, place long")
    return order, order.join(F.broadcast(at), "at").withColumn("block", F.col("to")).drop("to")


def _nodes(convs: DataFrame, classes: DataFrame, turns: int) -> DataFrame:
    """All decided nodes, with the parent's least id and the words ``before`` each depth that they fill."""
    order, near = _sorted(convs, classes, turns)
    rows = order.withColumn("place", F.lit(0).cast("long")).unionByName(near)
    level = stored(rows.groupBy("block").applyInArrow(_sorted_block, _DDL), "level")
    levels = []
    while True:
        levels.append(level)
        places = level.filter("kind = 'place'")
        size, blocks = places.agg(F.count("*"), F.max("block")).first()
        if not size:
            break
        fan = max(2, BLOCK * (blocks + 1) // size)
        last = fan > blocks
        to = F.lit(0).cast("long") if last else F.floor(F.col("block") / fan).cast("long")
        level = stored(places.withColumn("to", to).groupBy("to").applyInArrow(_place_block(last), _DDL), "level")
    nodes = [x.filter("kind = 'node'").select(*_NODE, "one", "key", "before") for x in levels]
    # What later levels decide is a few rows a block: the parents that nodes of earlier ones wait for.
    late = stored(reduce(DataFrame.unionByName, nodes[1:], nodes[0].limit(0)).drop("before"), "late")
    for_late = order.join(sized(stored(late.select("at").distinct(), "late-at")), "at").select("at", F.col("words").alias("each"))
    sums = F.aggregate(F.slice("each", F.lit(1), F.col("depth").cast("int")), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))
    full = late.join(for_late, "at").withColumn("before", F.slice(sums, (F.col("up") + 2).cast("int"), (F.col("depth") - F.col("up")).cast("int")))
    every = nodes[0].unionByName(full.select(*nodes[0].columns))
    waits = every.filter("parent_least is null")
    for x in levels[1:]:
        alias = sized(stored(x.filter("kind = 'alias'").select(F.col("own").alias("parent"), F.col("parent").alias("real")).distinct(), "alias"))
        waits = waits.join(alias, "parent", "left").withColumn("parent", F.coalesce("real", "parent")).drop("real")
    found = sized(stored(late.select(F.col("own").alias("parent"), F.col("least").alias("found")), "parents"))
    waits = waits.join(found, "parent", "left").withColumn("parent_least", F.col("found")).select(*every.columns)
    return every.filter("parent_least is not null").unionByName(waits)


@tidy
def trie(convs: DataFrame) -> DataFrame:
    """Per trie node of ``convs`` (:func:`sequences`): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every distinct sequence of the first d turns of some conversation is a node of depth d, down
    from the root, of depth 0, in which all are. ``conv_id`` is the smallest of those that start
    with it, ``n_leaves`` counts the childless nodes below it and itself, ``saved_tokens`` sums the
    words that its subtree says again. A turnless conversation is in the root alone; repeated
    conversations share all nodes; an empty table gives an empty result. The digests of one
    conversation's turns, 16 bytes each, must fit in a row.
    """
    hexes = F.array_join("turns.digest", "")
    convs = stored(convs.select("conv_id", F.unhex(hexes).alias("seq"), F.col("turns.words").alias("words"), F.left(F.sha2(hexes.cast("binary"), 256), F.lit(32)).alias("key")), "convs")
    classes = stored(convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")), "classes")
    turns = convs.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    nodes = _nodes(convs, classes, turns)
    ends = sized(stored(_ends(convs, classes), "ends"))
    nodes = nodes.filter("key is null").withColumn("ends", F.lit(None).cast("string")).unionByName(nodes.filter("key is not null").join(ends, "key").select(*nodes.columns, "ends"))
    each = nodes.select("*", F.posexplode("before").alias("i", "p")).withColumn("d", F.col("up") + 1 + F.col("i"))
    top = F.col("d") == F.col("depth")
    ids = F.coalesce("ends", F.sha2(F.col("one").cast("string").cast("binary"), 256), F.sha2(F.lit("").cast("binary"), 256))
    return each.select(
        F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("least")).otherwise(F.col("parent_least")).alias("parent_conv_id"),
        "n_convs", F.when(top, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("words") - F.col("new") - F.col("base") - (F.col("n_convs") - 1) * F.col("p")).alias("saved_tokens"),
        F.when(top, ids).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


@tidy
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of the conversations with :func:`shared_starts`.

    Conversations are known by rows with a conv_id; their rows may be null in all other columns.
    """
    return trie(shared_starts(stored(sequences(conversations), "sequences")))
