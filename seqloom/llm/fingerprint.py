"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they occur. For each of the samples,
a term of weight S has gamma draws r and c and a uniform b that depend on term and sample
only; with ``t = floor(ln S / r + b)`` the term whose ``ln c - r (t + 1 - b)`` is least is
drawn, and the sample is a hash of term and t. Two documents agree in a sample with a
probability equal to their generalised Jaccard similarity. DataFrame functions only: the
draws are computed from 192 bits of hashes of term and sample. Those of the most frequent
words are computed once and looked up, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import lower_word, raw_words, sized, stored, tidy

SAMPLES = 64
#: Samples of one row of the aggregate: the JVM compiles no method as long as one for all samples would be.
BLOCK = 16
#: Words whose draws are looked up, for weights up to COUNTS: with 64 samples at most 17 MB.
FREQUENT = 16_384
COUNTS = 2
#: Of these, only words that occur once in so many characters are ranked: at most half as many, as a word and a gap take two.
RARE = 1 << 23


def _uniform(h: Column, shift: int) -> Column:
    """32 bits of ``h``, from bit ``shift`` on, as a number between 0 and 1, both left out."""
    bits = F.shiftrightunsigned(h, shift) if shift else h
    return (bits.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) * F.lit(2.0**-32)


def _gamma(h: Column) -> Column:
    """-ln(u v) of the two halves of ``h``: a draw of Gamma(2, 1)."""
    return -F.ln(_uniform(h, 0) * _uniform(h, 32))


def _draw(d: int, weight: str) -> Column:
    """The draw of sample ``d`` of a row's block as one number: ``ln a`` in the upper bits, 16 bits that stand for term and t below.

    The hashes and gamma draws are the same for every ``weight``, so Spark computes them once a term.
    Null, and without any computation, where the draws are known from ``near``.
    """
    h = [F.when(F.col("near").isNull(), F.xxhash64(F.lit(3 * d + i), "cell")) for i in range(3)]
    r = _gamma(h[0])
    c = F.ln(_gamma(h[1]))
    b = _uniform(h[2], 32)
    t = F.floor(F.col(weight) / r + b)
    low = c - r * (t.cast("double") + 1.0 - b)
    # ln a lies well within 2000 of zero
    high = ((low + 2000.0) * F.lit(float(1 << 34))).cast("long")
    # Bits of the hash, changed by t, stand for the pair of term and t.
    own = h[2].bitwiseXOR(t * 40503).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(high, 16).bitwiseOR(own)


#: Begins a pseudo-word that carries a part of a text's hash; no word holds this character.
MARK = "#"
#: Parts of a hash of 64 hexadecimal digits.
PARTS = 8


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fp`` (array of ``samples`` 16-bit numbers) of each row ``(keys, text)``.

    ``keys`` identify the rows. A null or wordless text has no row.
    """
    words = texts.select(*keys, F.explode(raw_words(F.col("text"))).alias("w"))
    return _least(words.select(*keys, F.lit(0).alias("v"), F.xxhash64(lower_word(F.col("w"))).alias("term")), keys, 1, samples).withColumnRenamed("fp0", "fp")


def _blocks(samples: int) -> Column:
    return F.array(*[F.lit(j) for j in range(-(-samples // BLOCK))])


def known_draws(texts: DataFrame, chars: int, most: int, samples: int = SAMPLES) -> DataFrame:
    """``(term, near)`` of the ``most`` frequent words of ``(text)`` with ``chars`` characters: the draws for weights 1 to COUNTS, block by block."""
    words = texts.select(F.explode(raw_words(F.col("text"))).alias("w"))
    counts = words.groupBy(F.xxhash64(lower_word(F.col("w"))).alias("term")).agg(F.count("*").alias("n"))
    top = stored(counts.filter(F.col("n") >= chars // RARE).orderBy(F.col("n").desc(), "term").limit(most).select("term"), "frequent")
    each = top.select("term", F.explode(F.array(*[F.lit(n) for n in range(1, COUNTS + 1)])).alias("n")).select("*", F.explode(_blocks(samples)).alias("block"))
    ready = each.select("*", F.ln("n").alias("weight"), F.xxhash64("term", "block").alias("cell"), F.lit(None).cast("array<bigint>").alias("near"))
    drawn = ready.select("term", F.struct("n", "block", F.array(*[_draw(d, "weight") for d in range(BLOCK)]).alias("m")).alias("draws"))
    return stored(drawn.groupBy("term").agg(F.flatten(F.transform(F.array_sort(F.collect_list("draws")), lambda x: x["m"])).alias("near")), "draws")


def _least(terms: DataFrame, keys: list[str], texts: int, samples: int, parts: int = 0, known: DataFrame | None = None) -> DataFrame:
    """``keys`` and, from exploded ``(keys, v, term)``, ``fp0`` and on of the texts, whose terms have that number as
    ``v``, null where there is no term; then ``p0`` and on, the terms of the ``v`` that follow. ``known`` is a result
    of :func:`known_draws`, which saves time only.
    """
    v, part = F.col("v"), F.greatest("v", F.lit(texts - 1))
    # The texts of one row share their terms; ln 0 is null, which no minimum counts.
    counted = terms.groupBy(*keys, part.alias("part"), "term").agg(*[F.count_if(v == i).alias(f"n{i}") for i in range(texts)])
    near = F.lit(None).cast("array<bigint>")
    if known is not None:
        # At most FREQUENT rows of known width.
        counted = counted.join(F.broadcast(known), "term", "left")
        near = F.when(F.greatest(*[F.col(f"n{i}") for i in range(texts)], F.lit(0)) <= COUNTS, F.col("near"))
    weights = [F.ln(f"n{i}").alias(f"weight{i}") for i in range(texts)]
    weighted = counted.select(*keys, "part", "term", *[f"n{i}" for i in range(texts)], *weights, near.alias("near"))
    every = _blocks(samples)
    # What stands for no word needs no draws, so one block carries it.
    blocks = F.explode(F.when(F.col("part") < texts, every).otherwise(F.array(F.lit(0))) if parts else every)
    starts = [((F.col(f"n{i}") - 1) * (-(-samples // BLOCK) * BLOCK) + F.col("block") * BLOCK).cast("int").alias(f"at{i}") for i in range(texts)]
    # Either the draw known from before or the new one is null.
    either = lambda d, i: F.greatest(F.get("near", F.col(f"at{i}") + d), _draw(d, f"weight{i}"))
    mins = [F.min(either(d, i)).alias(f"m{i}_{d}") for d in range(BLOCK) for i in range(texts)]
    own = [F.max(F.when(F.col("part") == texts + i, F.col("term"))).alias(f"p{i}") for i in range(parts)]
    ready = weighted.select("*", blocks.alias("block")).select("*", F.xxhash64("term", "block").alias("cell"), *starts)
    least = ready.groupBy(*keys, "block").agg(*mins, *own)
    some = lambda i: F.array(*[F.col(f"m{i}_{d}").bitwiseAND(F.lit(0xFFFF)).cast("int") for d in range(BLOCK)])
    fps = [F.when(F.col(f"m{i}_0").isNotNull(), some(i)).alias(f"s{i}") for i in range(texts)]
    rows = least.select(*keys, "block", *fps, *[f"p{i}" for i in range(parts)])
    in_block = lambda i, j: F.max(F.when(F.col("block") == j, F.col(f"s{i}")))
    fp = lambda i: F.slice(F.concat(*[in_block(i, j) for j in range(-(-samples // BLOCK))]), 1, samples)
    return rows.groupBy(*keys).agg(*[fp(i).alias(f"fp{i}") for i in range(texts)], *[F.max(f"p{i}").alias(f"p{i}") for i in range(parts)])


def _with_hash(text: Column) -> Column:
    """The words of a text and, as pseudo-words, the parts of its SHA-256, so that one pass over the texts gives both."""
    sha = F.sha2(text, 256)
    width = 64 // PARTS
    return F.concat(raw_words(text), F.array(*[F.concat(F.lit(f"{MARK}{i}"), F.substring(sha, i * width + 1, width)) for i in range(PARTS)]))


def as_text(fp: Column) -> Column:
    """Four hexadecimal digits a sample; of a text without words, empty."""
    return F.coalesce(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree: 1 for two texts without words, 0 if just one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def next_in_order(ids: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """``ids`` ``(id, k, h, n)`` with ``nk``, ``nh`` of the next row by descending id, then h; the first follows the last."""
    n = ids.count()
    down = [F.col("id").desc_nulls_last(), F.col("h")]
    parts = stored(ids.repartitionByRange(max(1, -(-n // rows_per_part)), *down).select("*", F.spark_partition_id().alias("part")), "ordered")
    rank = F.struct(F.col("id").isNull(), F.bitwise_not("id"), "h")
    firsts = parts.groupBy("part").agg(F.min_by(F.struct("k", "h"), rank).alias("first"))
    # One row for each part, so few enough for one task.
    every = W.orderBy("part")
    following = firsts.select(F.col("part"), F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(W.unboundedPreceding, W.currentRow))).alias("wrap"))
    own = W.partitionBy("part").orderBy(*down)
    after = parts.withColumn("nk", F.lead("k").over(own)).withColumn("nh", F.lead("h").over(own))
    return after.join(sized(stored(following, "firsts")), "part").select("id", "k", "h", "n", F.coalesce("nk", "wrap.k").alias("nk"), F.coalesce("nh", "wrap.h").alias("nh"))


@tidy
def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per document: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as many of the first characters of the
    next document, by descending id (ties by a hash of the text); after the last comes the
    first. Null texts are empty; rows of equal id and text are one document; an empty table
    gives an empty result; a null id comes last. The draws of the ``frequent`` commonest words
    are looked up; results don't depend on it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h.alias("h"), F.xxhash64(F.col(id_col), h, F.lit(1)).alias("k"))
    ids = stored(rows.groupBy("id", "k", "h").agg(F.first(F.length("text")).alias("n"), F.count("*").alias("m")), "ids")
    if ids.filter("m > 1").limit(1).count():
        rows = rows.dropDuplicates(["k", "h"])
    chain = stored(next_in_order(ids.drop("m")), "chain")
    third = F.floor(F.col("n") / 3).cast("int")
    heads = (
        rows.select("k", "h", "text")
        .join(chain.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("ok"), F.col("h").alias("oh"), "n"), ["k", "h"])
        .select(F.col("ok").alias("k"), F.col("oh").alias("h"), F.substring("text", F.lit(1), third).alias("head"))
    )
    both = (
        rows.select("k", "h", "text").join(chain.select("k", "h", "n"), ["k", "h"]).join(heads, ["k", "h"])
        .select("k", "h", "text", F.concat(F.substring("text", F.lit(1), F.col("n") - third), "head").alias("edited"))
    )
    # Kind 0 is the text, 1 the edited text, 2 and on are the parts of the edited text's hash.
    kinds = F.posexplode(F.array(raw_words(F.col("text")), _with_hash(F.col("edited")))).alias("v", "ws")
    each = both.select("k", "h", kinds).select("k", "h", "v", F.explode("ws").alias("w"))
    marked = F.col("w").startswith(MARK)
    terms = each.select(
        "k", "h", F.when(marked, F.substring("w", 2, 1).cast("int") + 2).otherwise(F.col("v")).alias("v"),
        F.when(marked, F.conv(F.substring("w", 3, 64 // PARTS), 16, 10).cast("long")).otherwise(F.xxhash64(lower_word(F.col("w")))).alias("term"),
    )
    chars = ids.agg(F.sum("n")).first()[0] or 0
    known = known_draws(rows.select("text"), chars, frequent, samples) if frequent else None
    found = _least(terms, ["k", "h"], 2, samples, PARTS, known).withColumnsRenamed({"fp0": "fp", "fp1": "efp"})
    found = stored(found, "fingerprints")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"p{i}"), 64 // PARTS, "0") for i in range(PARTS)]))
    other = found.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("fp").alias("nfp"))
    return (
        chain.join(found, ["k", "h"]).join(other, ["nk", "nh"], "left")
        .select(
            F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), sha.alias("edited_sha256"),
            as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        )
    )
