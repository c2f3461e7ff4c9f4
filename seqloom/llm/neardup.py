"""Near duplicates by MinHash, banding, signature check, exact check and connected components.

Texts with equal shingle sets form a class, of which one document goes on. Members of a
band's bucket are first compared with one leader each, the one with the fewest shingles of
its own, so a large group of near copies costs a few comparisons a member rather than all
pairs. Where a bucket still holds several components, every pair across them is a candidate;
bounds from the shingles that no other document has and a long signature of one bit a hash
leave those that may reach the threshold, and these are compared in full, so no link that
could join two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import arrow_bytes, lean, sized, stored, tidy
from seqloom.llm.components import components

#: Rows of each band; with 5 a pair at 0.8 shares a band with probability 0.33.
ROWS = 5
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-5
#: Standard deviations below the threshold at which a signature's estimate still counts.
SLACK = 5.0
#: Words of 64 bits of the long signature.
LONG = 32
_MEMO = 150_000


class _Hashes(dict):
    """Word to its 64-bit hash, kept for words seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text, A-Z in lower case.

    Words are split at ASCII white space; a text of fewer words is one shingle; null or
    wordless texts have none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240601)
    top = np.iinfo(np.uint64).max
    return draw.integers(1, top, n, np.uint64) | np.uint64(1), draw.integers(0, top, n, np.uint64)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes ``(a * x + b) mod 2**64``, upper 32 bits."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        np.minimum(least, (items[i : i + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(k: int, bands: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        a, b = _multipliers(bands * ROWS)
        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py(), k, memo)
                n.append(len(items))
                if not len(items):
                    digest.append(None), sig.append(None), keys.append(None)
                    continue
                s = signature(items, a, b)
                digest.append(xxhash.xxh3_128_digest(items.tobytes()))
                sig.append((s & np.uint32(255)).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh3_64_intdigest(s[i : i + ROWS].tobytes(), seed=i) - 2**63 for i in range(0, len(s), ROWS)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            found = [shingles(t.as_py(), k, memo) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            items = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))
            digest = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), digest, items], names=["of", "dig", "items"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest bit of each of 64 * LONG minima, packed."""
    draw = np.random.default_rng(20240602)
    a, b = (draw.integers(0, 1 << 32, 64 * LONG, np.uint32) for _ in "ab")
    a |= np.uint32(1)
    for batch in batches:
        out = []
        for row in batch.column("items"):
            x = row.values.to_numpy().view(np.uint64)
            x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
            least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
            for i in range(0, len(x), 256):
                np.minimum(least, (x[i : i + 256, None] * a + b).min(axis=0), out=least)
            # the lowest bits of a product are weak, so a middle one is mixed in
            low = ((least >> np.uint32(3)) ^ (least >> np.uint32(11)) ^ (least >> np.uint32(17))) & np.uint32(1)
            out.append(np.packbits(low.astype(bool)).view(np.int64))
        cols = np.array(out, np.int64).reshape(-1, LONG)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(cols[:, j]) for j in range(LONG)]], names=["id", *[f"s{j}" for j in range(LONG)]])


def _alike(least: float):
    """Pairs whose signatures agree in ``least`` of their places at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sa", "sb"))
            same = (sa == sb).reshape(batch.num_rows, -1).mean(axis=1) >= least if batch.num_rows else np.empty(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(same))

    return run


def _confirm(percent: int):
    """Pairs with ``100 * intersection >= percent * union`` on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                p, q = (z.values.to_numpy() for z in (x, y))
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


@tidy
def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of distinct ``k``-word
    shingles is ``percent`` / 100 or more; a shorter text is one shingle, and null or
    wordless texts are linked with nothing. ``component_id`` is the smallest id reachable,
    the own one included; ``kept`` says whether it is the own one. Rows of one id are one
    document: it has the links of all its texts, and its rows get the same answer but for
    n_shingles, which is that of the row's text. A row with a null id links with nothing and
    is kept. An empty table gives an empty result. Ids are integers.
    """
    with arrow_bytes(docs.sparkSession):
        return _near_duplicates(docs, k, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    share = percent / 100
    bands = bands_for(share)
    table = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, n long, digest binary, sig binary, keys array<long>"
    sketch = stored(table.mapInArrow(lean(_sketch(k, bands)), kinds), "sketches")
    full = sketch.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    # A node stands for a class of texts with equal sets; ``rep`` is the least id that has one.
    classes = full.groupBy("digest").agg(F.min("id").alias("rep")).select("digest", "rep", F.monotonically_increasing_id().alias("node"))
    classes = stored(classes, "classes")
    again = stored(sketch.filter("id is not null").groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"), "repeated")
    repeated = not again.isEmpty()
    owners = classes.withColumnsRenamed({"digest": "dig"})
    reps = full.join(owners, (F.col("digest") == F.col("dig")) & (F.col("id") == F.col("rep"))).select(F.col("node").alias("id"), "rep", "dig", F.col("n").cast("int").alias("n"), "sig", "keys")
    # Rows of one id and text are alike in all of this, so any of them will do.
    reps = stored(reps.dropDuplicates(["id"]) if repeated else reps, "nodes")
    rows = reps.select("id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("of")).filter("of > 1").select("key")
    found = stored(rows.join(shared, "key"), "buckets")
    members = stored(found.select("id").distinct(), "members")
    small = sized(members)
    wanted = stored(reps.join(small, "id", "left_semi").select("id", "rep", "dig"), "wanted")
    whose = sized(stored(wanted.select(F.col("rep").alias("id")).distinct(), "whose"))
    read = table.join(whose, "id", "left_semi").mapInArrow(lean(_sets(k)), "of long, dig binary, items array<long>")
    read = read.join(sized(wanted), (F.col("of") == F.col("rep")) & (read["dig"] == wanted["dig"])).select("id", "items")
    sets = stored(read.dropDuplicates(["id"]) if repeated else read, "sets")
    # A shingle that no other member has is in no intersection: what is left bounds a similarity from above.
    shingle = sets.select("id", F.explode("items").alias("x"))
    alone = shingle.groupBy("x").agg(F.count("*").alias("of"), F.min("id").alias("id")).filter("of = 1").groupBy("id").agg(F.count("*").alias("own"))
    alone = stored(alone, "alone")
    buckets = found.join(alone, "id", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0)))
    buckets = stored(buckets.filter(100 * F.col("c") >= percent * F.col("n")).select("key", "id", "n", "c"), "buckets")
    best = F.struct(-F.col("c") / F.col("n"), F.xxhash64("id", "key"))
    heads = buckets.groupBy("key").agg(F.min_by(F.struct("id", "n"), best).alias("head"))

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = stored(
        buckets.join(heads, "key").filter((F.col("id") != F.col("head.id")) & fits(F.col("n"), F.col("head.n")))
        .select(*pair(F.col("id"), F.col("head.id"))).distinct(),
        "leaders",
    )
    sigs = stored(reps.join(small, "id", "left_semi").select("id", "sig"), "signatures")
    least = share - SLACK * math.sqrt(share * (1 - share) / (bands * ROWS))

    def side(df: DataFrame, col: str, to: str) -> DataFrame:
        return df.select(F.col("id").alias(to), F.col(col).alias({"sig": "s", "items": "x"}[col] + to))

    def links(pairs: DataFrame) -> DataFrame:
        true = pairs.join(side(sets, "items", "a"), "a").join(side(sets, "items", "b"), "b").mapInArrow(lean(_confirm(percent)), "a long, b long")
        return stored(true.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    likely = stored(first.join(side(sigs, "sig", "a"), "a").join(side(sigs, "sig", "b"), "b").mapInArrow(lean(_alike(least)), "a long, b long"), "likely")
    edges = links(likely)
    if repeated:
        # Texts of one id are linked by it, each with the first of them.
        texts = stored(full.join(sized(again), "id", "left_semi").select("id", "digest").distinct().join(classes, "digest").select("id", "digest", "node"), "texts")
        hubs = texts.groupBy("id").agg(F.min("node").alias("u"))
        edges = stored(edges.unionByName(texts.join(hubs, "id").select("u", F.col("node").alias("v")).filter("u <> v")), "links")
    comp = components(edges)
    # Buckets that still hold several components.
    placed = buckets.join(comp, "id", "left").select("key", "id", "n", "c", F.coalesce("component", "id").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("of"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("of", "comp")).alias("main")).filter("comps > 1").select("key", "main")
    open_ = stored(placed.join(mixed, "key"), "open")
    open_ids = stored(open_.select("id").distinct(), "open-ids")
    those = sized(open_ids)
    long = [f"s{j}" for j in range(LONG)]
    bits = stored(sets.join(those, "id", "left_semi").mapInArrow(lean(_bits), ", ".join(["id long", *[f"{c} long" for c in long]])), "bits")
    bands_of = reps.join(those, "id", "left_semi").select("id", "keys")
    known = stored(open_.join(bits, "id").join(bands_of, "id"), "known")
    rest = known.filter("comp <> main").select("key", *[F.col(x).alias(f"{x}_") for x in ("id", "n", "c", "comp", "keys", *long)])
    common = F.least("c", "c_")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in long), F.lit(0))
    half = (1 - share) / 2
    across = stored(
        rest.join(known, "key")
        .filter(
            (F.col("comp_") != F.col("comp"))
            & ((F.col("comp") == F.col("main")) | (F.col("id_") < F.col("id")))
            & (100 * common >= percent * (F.col("n") + F.col("n_") - common))
            & (apart <= int(64 * LONG * half + SLACK * math.sqrt(64 * LONG * half * (1 - half))))
            & (F.array_min(F.array_intersect("keys", "keys_")) == F.col("key"))  # each pair in one of its buckets
        )
        .select(*pair(F.col("id_"), F.col("id"))),
        "across",
    )
    more = links(across.join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        comp = components(edges.unionByName(more))
    # The least id of each component of more than one node.
    linked = comp.select(F.col("id").alias("node"), "component").unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
    least_id = classes.join(linked, "node").groupBy("component").agg(F.min("rep").alias("reached"))
    placed_nodes = linked.join(least_id, "component").select("node", "reached")
    reached = stored(classes.join(placed_nodes, "node", "left").select("digest", F.coalesce("reached", "rep").alias("reached")), "reached")
    out = stored(sketch.select("id", "n", "digest"), "rows").join(reached, "digest", "left")
    if repeated:
        # A wordless row of an id that has other texts goes with these.
        by_id = texts.join(reached, "digest").groupBy(F.col("id").alias("own")).agg(F.min("reached").alias("other"))
        out = out.join(sized(stored(by_id, "by-id")), F.col("id") == F.col("own"), "left").withColumn("reached", F.coalesce("reached", "other"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("reached", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
