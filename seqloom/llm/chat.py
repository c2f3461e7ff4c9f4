"""Chat formatting of reply trees.

Messages form trees by their parents. Self-joins that double their reach find, for every leaf,
the path from its root; branches are ranked by score, and each chosen path is formatted as one
conversation. The template marks turns as ``<|im_start|>role``, line feed, text, ``<|im_end|>``,
line feed. In texts a ``<``, any backslashes and a ``|`` get one more backslash, so no control
string is left and the escape can be undone; roles also escape backslash and line feed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import stored, tidy

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of each turn; start and end are code points of the escaped text."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def mask(formatted: str) -> list[tuple[int, int]]:
    """Code-point spans that count for the loss: the assistant's texts, without markers."""
    return [(s, e) for role, _, s, e in parse(formatted) if role == "assistant"]


def paths(nodes: DataFrame) -> DataFrame:
    """``(tree, leaf, node, depth)`` for every node on the way from a leaf to its root; depth counts from the leaf.

    ``nodes`` is ``(tree, node, parent)``, ``(tree, node)`` being a key. A null parent, or one
    that isn't there, makes a root. Nodes of a ring of parents have no root: they, and all
    that reply to them, appear in no path. The joins reach twice as far each time.
    """
    up = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("to"))
    known = nodes.select(F.col("tree").alias("kt"), F.col("node").alias("kn"))
    up = stored(up.join(known, F.col("t").eqNullSafe(F.col("kt")) & (F.col("to") == F.col("kn")), "left").select("t", "n", F.col("kn").alias("to")), "up")
    inner = up.filter("to is not null").select(F.col("t").alias("kt"), F.col("to").alias("kn")).distinct()
    leaf = F.col("t").eqNullSafe(F.col("kt")) & (F.col("n") == F.col("kn"))
    found = up.join(inner, leaf, "left_anti").select(F.col("t").alias("tree"), F.col("n").alias("leaf"), F.col("n").alias("node"), F.lit(0).alias("depth"))
    reach, left = 1, -1
    while True:
        # Nodes with an ancestor so far up. One that leads to a root has ancestors at every
        # smaller depth, some of which drop out now: if none did, only rings are left.
        jump = up.filter("to is not null")
        before, left = left, jump.count()
        if left == before:
            lost = jump.select(F.col("t").alias("kt"), F.col("n").alias("kn"))
            return found.join(lost, F.col("tree").eqNullSafe(F.col("kt")) & (F.col("leaf") == F.col("kn")), "left_anti") if left else found
        if not left:
            return found
        further = (
            found.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
            .select("tree", "leaf", F.col("to").alias("node"), (F.col("depth") + reach).alias("depth"))
        )
        found = stored(found.unionByName(further), "paths")
        mid = up.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("to").alias("to2"))
        up = stored(
            jump.join(mid, F.col("t").eqNullSafe(F.col("t2")) & (F.col("to") == F.col("n2"))).select("t", "n", F.col("to2").alias("to")), "up"
        )
        reach *= 2


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """``(tree, rank, leaf, n_turns, formatted)``: each chosen path as one conversation.

    ``nodes`` is ``(tree, node, parent, role, text, score)``. A path's score is the sum of its
    nodes' (null: 0); of each tree the ``branches`` best are taken (None: all), ties by the
    leaf. Null roles and texts are empty.
    """
    rows = nodes.select("tree", "node", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    on = paths(nodes)
    if branches is not None:
        sums = on.join(rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        best = sums.groupBy("tree", "leaf").agg(F.sum("score").alias("sum"))
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("sum"), "leaf"))).filter(F.col("rank") <= branches)
        best = best.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank")
        on = on.join(best, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).drop("t", "l")
    else:
        on = on.withColumn("rank", F.lit(None).cast("int"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.concat(F.lit(START), escape_role(blank("role")), F.lit("\n"), escape(blank("text")), F.lit(END + "\n"))
    texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), turn.alias("turn"))
    full = on.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "turn")))
    return (
        full.groupBy("tree", "rank", "leaf").agg(turns.alias("turns"))
        .select("tree", "rank", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.turn", "").alias("formatted"))
    )


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations ``(conv_id, turn, role, text)`` as trees in which each turn replies to the one before it.

    Turns of equal number follow each other by role, then text; a null turn comes first.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(None).cast("double"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for batch in batches:
        out = []
        for conv, formatted in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = formatted.as_py()
            turns = parse(text)
            loss = "".join(unescape(text[s:e]) for s, e in mask(text))
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(text)))
        yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, x, strict=True)) for x in out], schema=_FIELDS)


_FIELDS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`format_trees` wrote, read back: turns and loss text by parsing ``formatted``."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col("tree").cast("long"), "formatted").mapInArrow(_digests, kinds)


@tidy
def chats(conversations: DataFrame) -> DataFrame:
    """The best branch of every conversation formatted and read back.

    A conversation without replies to one turn is a tree of one branch, so that branch is all
    of it. Null roles and texts are empty, repeated rows are turns of their own. An empty
    table gives an empty result; a null conv_id is a conversation of its own.
    """
    return digests(format_trees(stored(linear(conversations.select("conv_id", "turn", "role", "text")), "turns"), branches=1))
