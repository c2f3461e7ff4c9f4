"""Benchmark decontamination with a distributed positional inverted index.

One pass over the texts stores the postings ``(term, doc, position)`` of all training tokens
that any test window holds, and each document's length under a term of its own. A window's
two rarest terms fetch their lists, which are shifted by the terms' offsets and intersected;
what remains is compared word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import ascii_words, lower_word, raw_words, sized, stored, tidy

#: Stands for a document's end; no word holds this character.
END = "#"
#: Words of one part of a document that is compared with windows.
PART = 4096


def windows(bench: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, win, n, wwords)``: each window of ``size`` consecutive words of each item.

    An item of fewer words, but not none, is one window. Equal windows share ``win``.
    """
    words = bench.select(F.col(id_col).alias("item"), ascii_words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        words.filter(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("wwords"))
        .select("item", F.md5(F.concat_ws(" ", "wwords")).alias("win"), F.size("wwords").alias("n"), "wwords")
        .distinct()
    )


def vocabulary(wins: DataFrame) -> DataFrame:
    """``(term, t)``: the words of all windows, each with a number; END has -1."""
    words = wins.select(F.explode("wwords").alias("term")).distinct()
    end = wins.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("long").alias("t"))
    return stored(words.select("term", F.monotonically_increasing_id().alias("t")).unionByName(end), "vocabulary")


def postings(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index ``(t, doc, pos)``: every place of every word of the vocabulary, and the length of each row as END's place.

    The texts are split into words here and nowhere else but in the documents that a window may occur in.
    """
    tokens = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.array_append(raw_words(F.col(text_col)), END)).alias("pos", "term"))
    tokens = tokens.select("doc", "pos", lower_word(F.col("term")).alias("term"))
    return stored(tokens.join(sized(vocabulary), "term").select("t", "doc", "pos"), "postings")


class Index:
    """Test windows against the training postings of ``docs``; see the functions below."""

    def __init__(self, docs: DataFrame, wins: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.items = stored(wins, "windows")
        self.wins = self.items.select("win", "n", "wwords").distinct()
        terms = vocabulary(self.items)
        self.index = postings(docs, terms, id_col, text_col)
        # Pre-aggregated by term, so a word that fills a third of all texts is a few rows of the shuffle.
        counts = stored(self.index.groupBy("t").agg(F.count("*").alias("cnt")), "counts")
        offsets = self.wins.select("win", "n", F.posexplode("wwords").alias("off", "term")).join(sized(terms), "term")
        rare = W.partitionBy("win").orderBy("cnt", "off")
        # A window with a term that never occurs cannot occur.
        self.keys = stored(
            offsets.join(sized(counts), "t", "left")
            .withColumn("rank", F.row_number().over(rare))
            .withColumn("least", F.min(F.coalesce("cnt", F.lit(0))).over(W.partitionBy("win")))
            .filter((F.col("rank") <= 2) & (F.col("least") > 0))
            .select("win", "n", "off", "t", "rank"),
            "keys",
        )

    def lengths(self) -> DataFrame:
        """``(doc, n_words)``, one row per row of the documents."""
        return self.index.filter("t = -1").select("doc", F.col("pos").cast("long").alias("n_words"))

    def _texts(self, found: DataFrame, at: str, before: int, after: int) -> DataFrame:
        """``found`` ``(doc, at, ...)`` as ``(doc, first, words, found)``: parts of the documents with any row, from word ``first`` on.

        A part holds the rows that are ``at`` one of PART words, and ``before`` words more in
        front and ``after`` behind, so no row grows with the document or its matches.
        """
        rest = [c for c in found.columns if c != "doc"]
        part = F.floor(F.col(at) / PART).cast("int").alias("part")
        lists = stored(found.groupBy("doc", part).agg(F.collect_list(F.struct(*rest)).alias("found")), "candidates")
        ids = sized(stored(lists.select("doc").distinct(), "ids"))
        docs = self.docs.select(F.col(self.id_col).alias("d"), F.col(self.text_col).alias("t"))
        words = docs.join(ids, docs["d"].eqNullSafe(ids["doc"]), "left_semi").select("d", ascii_words(F.col("t")).alias("words"))
        first = lambda p: F.greatest(p * PART - before, F.lit(0))
        cut = lambda p: F.slice("words", first(p) + 1, p * PART - first(p) + PART + after)
        # Cut inside the row, so that no copy of a long text is made for each of its parts.
        cuts = F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / PART).cast("int")), lambda p: F.struct(p.alias("p"), first(p).alias("first"), cut(p).alias("words")))
        parts = words.select("d", F.explode(cuts).alias("x")).select("d", "x.*")
        return parts.join(lists, F.col("d").eqNullSafe(lists["doc"]) & (F.col("p") == lists["part"])).select("doc", "first", "words", "found")

    def phrases(self) -> DataFrame:
        """``(doc, start, n, win)``: every exact occurrence of a window; start counts words from 0."""
        lists = self.index.join(sized(self.keys), "t").select("doc", (F.col("pos") - F.col("off")).alias("start"), "win", "n")
        both = (
            lists.filter(F.col("start") >= 0).groupBy("doc", "start", "win", "n").agg(F.count("*").alias("c"))
            .filter(F.col("c") >= F.least(F.lit(2), "n")).drop("c")
        )
        longest = self.wins.agg(F.max("n")).first()[0] or 1
        texts = self._texts(both, "start", 0, longest)
        own = lambda f: F.slice("words", f["start"] - F.col("first") + 1, f["n"])
        same = F.filter("found", lambda f: (F.size(own(f)) == f["n"]) & (F.md5(F.concat_ws(" ", own(f))) == f["win"]))
        return texts.select("doc", F.explode(same).alias("f")).select("doc", "f.start", "f.n", "f.win").distinct()

    def near(self, slop: int) -> DataFrame:
        """``(doc, at, n, win)``: the window's rarest term at ``at``, all its terms within ``n + slop - 1`` words of it.

        An exact occurrence is also such a match.
        """
        keys = sized(stored(self.keys.filter("rank = 1").join(self.wins, ["win", "n"]), "rarest"))
        reach = (self.wins.agg(F.max("n")).first()[0] or 1) + slop - 1
        found = self.index.join(keys, "t").select("doc", F.col("pos").alias("at"), "win", "n", "wwords")
        texts = self._texts(found, "at", reach, reach)

        def close(f):
            own = f["n"] + slop - 1
            left = F.greatest(f["at"] - own - F.col("first"), F.lit(0))
            return F.size(F.array_except(f["wwords"], F.slice("words", left + 1, f["at"] - F.col("first") - left + own + 1))) == 0

        return texts.select("doc", F.explode(F.filter("found", close)).alias("f")).select("doc", "f.at", "f.n", "f.win").distinct()


@tidy
def contamination(
    docs: DataFrame, bench: DataFrame, size: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a test window is hit; a document with a hit is
    contaminated if at least ``percent`` of its words are. Null or wordless texts have no
    words and no hits; wordless test items match nothing; rows of equal id share their hits;
    a null id is an id like others. Empty tables give empty results or no hits.
    """
    index = Index(docs, windows(bench, size), id_col, text_col)
    hits = stored(index.phrases(), "hits")
    covered = (
        hits.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct()
        .groupBy("doc").agg(F.count("*").alias("n_hit"))
    )
    items = (
        hits.select("doc", "win").distinct().join(index.items.select("win", "item"), "win").select("doc", "item").distinct()
        .groupBy("doc").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list(F.col("item").cast("string")))).alias("list"))
    )
    found = covered.select(F.col("doc").alias("d1"), "n_hit").join(items.select(F.col("doc").alias("d2"), "n_items", "list"), F.col("d1").eqNullSafe(F.col("d2")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        stored(index.lengths(), "lengths").join(stored(found, "found"), F.col("doc").eqNullSafe(F.col("d1")), "left")
        .select(
            F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
        )
    )
