"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent and normalised. The
exponent is found by bisection, 16 parts at a time: the least one (the flattest mixture) under
a limit on how often any source repeats, or the one of a target entropy. The weights are
realised as block permutations: a source's rows are dealt by hash into blocks of about
``block_tokens`` tokens; every epoch takes the blocks in a new order, and the last, partial
epoch stops where the source's budget ends, inside a block if need be. DataFrame functions
only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import sized, stored, tidy

PARTS, ROUNDS, STEEPEST = 16, 6, 64.0


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")).cast("long")


def exponent(totals: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None) -> float:
    """The least exponent that keeps to the limit.

    Repeats are limited by exponents from 0 to 1, and 1 is taken where none does; an entropy
    below that of the sources themselves needs a larger one, up to STEEPEST.

    ``totals`` has ``share``. Exactly one of ``max_repeats`` (most passes over a source) and
    ``entropy`` (in nats, at most) is given. Without ``budget`` the budget is the least one
    that passes over each source once.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    log = F.ln("share")
    tokens = totals.agg(F.sum("t")).first()[0]
    low, high, left = 0.0, 1.0, ROUNDS
    while left:
        step = (high - low) / PARTS
        tries = [low + step * j for j in range(PARTS + 1)]
        sums = []
        for j, a in enumerate(tries):
            power = F.exp(a * log)
            passes = F.exp((a - 1) * log)
            sums += [F.sum(power).alias(f"z{j}"), F.sum(power * log).alias(f"l{j}"), F.max(passes).alias(f"m{j}"), F.min(passes).alias(f"n{j}")]
        r = totals.agg(*sums).first()

        def keeps(j: int) -> bool:
            z = r[f"z{j}"]
            if entropy is not None:
                return math.log(z) - tries[j] * r[f"l{j}"] / z <= entropy + 1e-12
            most = r[f"m{j}"] * budget / tokens / z if budget else r[f"m{j}"] / r[f"n{j}"]
            return most <= max_repeats * (1 + 1e-12)

        if low == 0.0 and keeps(0):
            return 0.0
        if entropy is not None and not keeps(PARTS) and high < STEEPEST:
            low, high = high, 4 * high
            continue
        left -= 1
        first = next((j for j in range(1, PARTS + 1) if keeps(j)), PARTS)
        low, high = tries[first - 1], tries[first]
    return high


@dataclass
class Mixture:
    """``rows``: (id, source, tokens, h). ``sources``: (source, t, share, weight, quota, full, rest, blocks). ``blocks``: (source, block, copies, cut)."""

    alpha: float
    rows: DataFrame
    sources: DataFrame
    blocks: DataFrame
    seed: int

    def order(self, epoch: Column) -> Column:
        """The place of a row in its block in an epoch."""
        return F.xxhash64("h", epoch, F.lit(self.seed))


def _block_order(epoch: Column, seed: int) -> list[Column]:
    return [F.xxhash64("source", "block", epoch, F.lit(seed)), F.col("block")]


def _starts(blocks: DataFrame, by: list[str], epoch: Column, seed: int) -> DataFrame:
    """Stored ``blocks`` ``(*by, block, b)`` with ``start``: the tokens of those before each in the epoch's order, within ``by``.

    Sums in two levels, as one source may have most of the blocks: within 1024 ranges of the
    order, and over the ranges.
    """
    o, block = _block_order(epoch, seed)
    rows = blocks.withColumn("o", o).withColumn("range", F.shiftright("o", 54))
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "range").agg(F.sum("b").alias("sum")).withColumn("head", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    heads = stored(sums.select(*[F.col(c).alias(f"{c}_") for c in [*by, "range"]], "head"), "heads")
    within = W.partitionBy(*by, "range").orderBy("o", block).rowsBetween(W.unboundedPreceding, -1)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*by, "range"]])
    own = rows.withColumn("inner", F.coalesce(F.sum("b").over(within), F.lit(0)))
    return own.join(sized(heads), same).withColumn("start", F.col("head") + F.col("inner")).select(*blocks.columns, "start")


def plan(
    docs: DataFrame,
    max_repeats: float | None = 4.0,
    entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = 500_000,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> Mixture:
    """Weigh the sources and settle how often each block is taken.

    A null source is a source of its own. A source without tokens has weight 0 and its rows
    are taken once. Rows of equal id and text share their fate.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_tokens(F.col(text_col)).alias("tokens"),
            F.xxhash64(id_col, text_col).alias("h"),
        ),
        "tokens",
    )
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "totals")
    total = totals.agg(F.sum("t")).first()[0] or 0
    shares = totals.withColumn("share", F.col("t") / F.lit(float(max(1, total))))
    live = shares.filter("t > 0")
    alpha = exponent(live, max_repeats, entropy, budget) if total else 1.0
    power = F.when(F.col("t") > 0, F.exp(alpha * F.ln("share"))).otherwise(0.0)
    z = live.agg(F.sum(F.exp(alpha * F.ln("share")))).first()[0] or 1.0
    weighted = shares.withColumn("weight", power / z)
    spend = budget or (weighted.filter("t > 0").agg(F.max(F.col("t") / F.col("weight"))).first()[0] or 0.0)
    sources = stored(
        weighted.withColumn("quota", F.round(F.col("weight") * spend).cast("long"))
        .withColumn("full", F.when(F.col("t") > 0, F.floor(F.col("quota") / F.greatest("t", F.lit(1)))).otherwise(1))
        .withColumn("rest", F.when(F.col("t") > 0, F.col("quota") - F.col("full") * F.col("t")).otherwise(0))
        .withColumn("blocks", F.greatest(F.ceil(F.col("t") / block_tokens), F.lit(1))),
        "sources",
    )
    placed = _placed(rows, sources)
    sums = stored(placed.groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("b")), "blocks")
    blocks = stored(_starts(sums, ["source"], F.col("full"), seed).withColumn("left", F.col("rest") - F.col("start")), "blocks")
    # The block in which a source's last epoch ends: its rows up to a place in its order.
    edge = blocks.filter("left > 0 and left < b").select("source", "block", "left")
    own = Mixture(alpha, rows, sources, blocks, seed)
    upto = W.partitionBy("source", "block").orderBy("o").rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = placed.alias("p").join(sized(edge).alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.block") == F.col("e.block"))).select("p.*", "left")
    cuts = (
        inside.withColumn("o", own.order(F.col("full"))).withColumn("c", F.sum("tokens").over(upto)).filter("c <= left")
        .groupBy("source", "block").agg(F.max("o").alias("cut"))
    )
    own.blocks = stored(
        blocks.alias("b").join(cuts.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.block") == F.col("c.block")), "left")
        .select(
            "b.source", "b.block", "b.b", "b.full",
            F.when((F.col("left") > 0) & (F.col("left") >= F.col("b.b")), F.lit((1 << 63) - 1)).otherwise(F.col("cut")).alias("cut"),
        ),
        "blocks",
    )
    return own


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their block, and their source's ``full`` and ``rest``."""
    s = sized(sources.select(F.col("source").alias("s"), "full", "rest", "blocks"))
    return rows.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks"))).drop("blocks")


def _taken(placed: DataFrame, mix: Mixture) -> DataFrame:
    """``placed`` with ``copies``: how often each row is taken."""
    b = sized(mix.blocks.select(F.col("source").alias("s"), F.col("block").alias("k"), "cut"))
    more = F.coalesce(mix.order(F.col("full")) <= F.col("cut"), F.lit(False)).cast("int")
    return placed.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).drop("s", "k").withColumn("copies", F.col("full").cast("int") + more)


def schedule(mix: Mixture) -> DataFrame:
    """One row per time a row is taken: ``id``, source, n_tokens, weight, epoch, block, position, progress.

    ``position`` counts the source's tokens before it over all epochs; ``progress`` is that as
    a part of the source's budget, so that reading in the order of progress mixes the sources
    to their weights all along. Tokenless sources have progress 0.
    """
    taken = _taken(_placed(mix.rows, mix.sources), mix).filter("copies > 0")
    epochs = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    within = W.partitionBy("source", "block", "epoch").orderBy("o", "id").rowsBetween(W.unboundedPreceding, -1)
    rows = epochs.withColumn("o", mix.order(F.col("epoch").cast("long"))).withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    turns = mix.blocks.select("source", "block", "b", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))).alias("epoch"))
    starts = _starts(stored(turns, "turns"), ["source", "epoch"], F.col("epoch").cast("long"), mix.seed)
    starts = stored(starts.select(F.col("source").alias("s"), F.col("block").alias("k"), F.col("epoch").alias("e"), "start"), "starts")
    per = mix.sources.select(F.col("source").alias("s2"), "t", "weight", "quota")
    position = F.col("epoch") * F.col("t") + F.col("start") + F.col("inner")
    return (
        rows.join(sized(starts), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")) & (F.col("epoch") == F.col("e")))
        .join(sized(per), F.col("source").eqNullSafe(F.col("s2")))
        .select(
            "id", "source", F.col("tokens").alias("n_tokens"), "weight", "epoch", "block", position.cast("long").alias("position"),
            F.when(F.col("quota") > 0, position / F.col("quota")).otherwise(0.0).alias("progress"),
        )
    )


def realise(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with their own columns."""
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(source_col).cast("string").alias("source"), F.xxhash64(id_col, text_col).alias("h"))
    taken = _taken(_placed(rows, mix.sources), mix).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


@tidy
def mixed(docs: DataFrame, max_repeats: float = 4.0, id_col: str = "doc_id", **options) -> DataFrame:
    """:func:`schedule` of a mixture that passes over every row at least once; an empty table gives an empty result."""
    return schedule(plan(docs, max_repeats, id_col=id_col, **options)).withColumnRenamed("id", id_col)
