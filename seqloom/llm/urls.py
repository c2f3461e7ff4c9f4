"""URL filters by association rules.

Labelled URLs are turned into sets of tokens, with the label as one more; tokens that always
occur together count as one; FP-growth finds the frequent sets, and rules from sets to a label
are pruned by confidence and support, and where a smaller set says the same as surely. An
inverted index from each rule's rarest token finds the rules that a URL may fit. Rules set by hand come first: what they decide
stands, and serves as the labels.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import sized, stored, tidy

#: Rules set by hand: (host and path, verdict).
SET_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Begins the item that stands for a row's verdict.
VERDICT = "verdict:"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or without ``://``: empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def set_rule(host: Column, path: Column, rules=SET_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host (the last as suffix), path segments and file ending, query keys.

    Digits in a token become ``0``.
    """
    tag = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), F.regexp_replace(x, r"\d+", "0")))
    labels = F.split(host, r"\.")
    segments = F.split(path, "[/.]")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    scheme = F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(\w*)://", 1))
    suffix = F.array(F.element_at(labels, -1))
    return F.array_distinct(F.concat(tag("scheme", scheme), tag("host", labels), tag("suffix", suffix), tag("path", segments), tag("query", keys)))


def alike(labelled: DataFrame, least: float) -> DataFrame:
    """``(item, alike)``: tokens that ``least`` rows or more have, those of exactly the same rows as one item by the name of the first.

    A rule with two tokens of one item says no more than the smaller one without the second,
    which pruning keeps in its place, so only sets of items can be rules. Rows are told apart
    by 128 bits of hashes of their tokens.
    """
    marks = [F.sum(F.xxhash64(F.lit(i), "tokens").cast("decimal(38,0)")).alias(f"m{i}") for i in range(2)]
    seen = labelled.select("tokens", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"), *marks)
    same = seen.filter(F.col("n") >= least).groupBy("n", "m0", "m1").agg(F.array_sort(F.collect_list("token")).alias("alike"))
    return same.select(F.col("alike")[0].alias("item"), "alike")


def single(held: DataFrame, total: int, least: int) -> DataFrame:
    """``(item, verdict, freq, of, open)`` of ``held`` ``(item, verdict)``: the items that ``least`` rows of a verdict or more have, and whether more items can make a rule of it surer.

    That is not so where all of the item's rows have the verdict, or where all ``total`` rows
    have the item, which then tells nothing beside another.
    """
    counts = held.groupBy("item", "verdict").agg(F.count("*").alias("freq"))
    of = counts.groupBy("item").agg(F.sum("freq").alias("of"))
    return counts.join(of, "item").filter(F.col("freq") >= least).withColumn("open", (F.col("freq") < F.col("of")) & (F.col("of") < total))


def frequent(rows: DataFrame, least_support: float, longest: int | None) -> DataFrame:
    """``(items, freq)``: by FP-growth, the sets of items and a verdict that enough of ``rows`` ``(items)`` hold, items sorted; of any size, or at most ``longest`` items if given."""
    found = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=1.0).fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    return found.filter(F.size(F.filter("items", lambda x: ~x.startswith(VERDICT))) <= longest) if longest else found


def mine(labelled: DataFrame, least_support: float = 0.005, least_confidence: float = 0.8, longest: int | None = None) -> DataFrame:
    """Rules ``(rule, items, alike, n, verdict, confidence, support)`` from ``labelled`` ``(tokens, verdict)``.

    A rule has any number of items, at most ``longest`` if given. An item is a token, or one of the tokens ``alike``
    that always occur together. Only :func:`single` items that are open can be in a kept rule of
    several, so FP-growth gets no others; it lists all frequent sets of those that a row has. ``support`` is the share of labelled URLs that have the rule's
    items and verdict. A rule is kept if no rule of fewer items, all among its own, has the
    same verdict and at least its confidence. No labelled URLs give no rules.
    """
    schema = "rule string, items array<string>, alike array<array<string>>, n int, verdict string, confidence double, support double"
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    total = labelled.count()
    classes = stored(alike(labelled, least_support * total), "alike")
    item_of = sized(stored(classes.select("item", F.explode("alike").alias("token")), "items"))
    numbered = stored(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled")
    held = stored(numbered.select("row", "verdict", F.explode("tokens").alias("token")).join(item_of, "token").select("row", "verdict", "item").distinct(), "held")
    alone = stored(single(held, total, math.ceil(least_support * total)), "single")
    open_items = sized(stored(alone.filter("open").select("item").distinct(), "open"))
    sets_of = held.join(open_items, "item").groupBy("row").agg(F.collect_set("item").alias("items"))
    says_so = F.concat(F.lit(VERDICT), "verdict")
    rows = stored(numbered.join(sets_of, "row", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), says_so).alias("items")), "transactions")
    sets = stored(frequent(rows, least_support, longest), "itemsets")
    says = F.filter("items", lambda x: x.startswith(VERDICT))
    whole = sets.filter((F.size(says) == 1) & (F.size("items") > 2))
    several = whole.select(F.array_except("items", says).alias("items"), F.substring(says[0], len(VERDICT) + 1, 99).alias("verdict"), "freq")
    body = sets.select(F.col("items").alias("b"), F.col("freq").alias("of"))
    counted = alone.select(F.array("item").alias("items"), "verdict", "freq", "of").unionByName(several.join(body, F.col("items") == F.col("b")).drop("b"))
    known = stored(
        counted.select(
            F.concat_ws(" ", "items").alias("rule"), "items", F.size("items").alias("n"), "verdict",
            (F.col("freq") / F.col("of")).alias("confidence"), (F.col("freq") / F.lit(total)).alias("support"),
        ),
        "rules",
    )
    # All parts of a frequent set are frequent, so the best of all smaller sets comes up by one item a step.
    level = known.filter("n = 1").withColumn("below", F.lit(0.0))
    levels = [level]
    for n in range(2, (known.agg(F.max("n")).first()[0] or 0) + 1):
        own = known.filter(F.col("n") == n)
        part = own.select("rule", "verdict", F.explode(F.transform("items", lambda x: F.concat_ws(" ", F.array_remove("items", x)))).alias("p"))
        best = level.select(F.col("rule").alias("p"), "verdict", F.greatest("confidence", "below").alias("c"))
        below = part.join(best, ["p", "verdict"]).groupBy("rule", "verdict").agg(F.max("c").alias("below"))
        level = stored(own.join(below, ["rule", "verdict"]).select(*known.columns, "below"), "level")
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)
    kept = found.filter((F.col("confidence") >= least_confidence) & (F.col("below") < F.col("confidence"))).drop("below")
    tokens_of = kept.select("rule", "verdict", F.posexplode("items").alias("at", "item")).join(sized(classes), "item")
    lists = tokens_of.groupBy("rule", "verdict").agg(F.array_sort(F.collect_list(F.struct("at", "alike"))).alias("x"))
    return kept.join(lists.select("rule", "verdict", F.col("x.alike").alias("alike")), ["rule", "verdict"]).select("rule", "items", "alike", "n", "verdict", "confidence", "support")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, mined, verdict, confidence)`` of the best rule of each ``(key, tokens)`` that fits any.

    A rule fits a set with a token of each of its items. It is indexed under the tokens of the
    one of its items that the fewest sets hold. Best is the most confident, then best
    supported, then longest, then first by name.
    """
    held = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    lists = rules.select("rule", "verdict", F.posexplode("alike").alias("at", "tokens_")).select("rule", "verdict", "at", F.explode("tokens_").alias("token"))
    size = lists.join(held, "token", "left").groupBy("rule", "verdict", "at").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"), F.collect_list("token").alias("own"))
    rarest = size.groupBy("rule", "verdict").agg(F.min(F.struct("df", "at", "own")).alias("least")).filter("least.df > 0").select("rule", "verdict", F.explode("least.own").alias("token"))
    index = stored(rarest.join(rules, ["rule", "verdict"]), "index")
    hits = (
        sets.select("key", "tokens", F.explode("tokens").alias("token")).join(sized(index), "token")
        .filter(F.forall("alike", lambda a: F.arrays_overlap(a, F.col("tokens"))))
    )
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.col("n"), "rule", "verdict")
    best = hits.groupBy("key").agg(F.min(F.struct(order.alias("o"), "confidence")).alias("x"))
    return best.select("key", F.col("x.o.rule").alias("mined"), F.col("x.o.verdict").alias("verdict"), F.col("x.confidence").alias("confidence"))


@tidy
def judge(pages: DataFrame, least_support: float = 0.005, least_confidence: float = 0.8, longest: int | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, mined, confidence.

    What neither a set rule nor a mined one decides is allowed. Null and odd urls have empty
    host and path. Equal token sets are matched once; repeated rows are judged alike; an empty
    table gives an empty result.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rule, says = set_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), F.array_sort(tokens(url, F.col("host"), F.col("path"))).alias("tokens"))
    rows = stored(rows.withColumn("key", F.md5(F.concat_ws(" ", "tokens"))), "urls")
    rules = stored(mine(rows.filter("says is not null").select("tokens", F.col("says").alias("verdict")), least_support, least_confidence, longest), "rules")
    sets = rows.filter("says is null").select("key", "tokens").dropDuplicates(["key"])
    found = stored(match(stored(sets, "sets"), rules), "matches")
    open_ = F.col("says").isNull()
    return (
        rows.join(sized(found), "key", "left")
        .select(
            "page_id", "host", "path", "rule", F.coalesce("says", "verdict", F.lit("allow")).alias("verdict"),
            F.when(open_, F.col("mined")).alias("mined"), F.when(open_, F.col("confidence")).alias("confidence"),
        )
    )
