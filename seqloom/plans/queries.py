"""Queries over the driver's tables, with the SQL that says the same.

``documents`` serve as the corpus (their letters A, C, G and T), ``embeddings`` as motifs
(each four numbers, made positive and normalised, one position), ``events`` as intervals and
as tables of likelihoods.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bases as B
from seqloom.functions import gaps as G
from seqloom.functions import motifs as M
from seqloom.operators import corpus as C
from seqloom.operators import compare, intervals, likelihood, mixture, quantiles, sampler, scan, synth
from seqloom.sources import fasta, fasta_source
from seqloom.sources.folders import new_folder

MOTIF = M.kmer_to_pwm("TATAAT")
SECOND = M.kmer_to_pwm("CCAAT")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common to the SQL of most queries.
CORPUS = "corpus AS (SELECT doc_id AS seq_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_documents(table(spark, sf_dir, "documents"))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus for work that is long for each document, by all cores whatever the file's row groups."""
    return C.from_documents(_dealt_texts(spark, sf_dir))


def _dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _windows(k: int, where: str = "") -> str:
    return f"w AS (SELECT seq_id, i - 1 AS pos, substring(seq, i, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM corpus){where})"


RC = "reverse(translate(kmer, 'ACGT', 'TGCA'))"


@query(f"WITH {CORPUS} SELECT seq_id, CAST(length(seq) AS BIGINT) AS length FROM corpus")
def seq_lengths(spark, d):
    return corpus(spark, d).select("seq_id", *_long("length"))


@query(f"WITH {CORPUS} SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM corpus")
def revcomp(spark, d):
    return corpus(spark, d).select("seq_id", B.reverse_complement(F.col("seq")).alias("rc"))


@query(
    """SELECT doc_id AS seq_id, reverse(translate(regexp_replace(upper(t), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc
    FROM (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTNRY]', '', 'g') AS t FROM documents)"""
)
def revcomp_unknown(spark, d):
    letters = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTNRY]", "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), B.reverse_complement(letters).alias("rc"))


@query(
    f"""WITH {CORPUS} SELECT c AS base, count(*) AS cnt, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
    FROM (SELECT unnest(string_split(seq, '')) AS c FROM corpus WHERE seq <> '') GROUP BY c"""
)
def base_composition(spark, d):
    counts = C.count_kmers(corpus(spark, d), 1, strands=1)
    return counts.select(F.col("kmer").alias("base"), "cnt", F.round(F.col("cnt") / F.sum("cnt").over(W.partitionBy()), 6).alias("share"))


@query(
    f"""WITH {CORPUS} SELECT round(CASE WHEN sum(length(seq)) > 0 THEN
    CAST(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) AS DOUBLE) / sum(length(seq)) ELSE 0.5 END, 6) AS gc FROM corpus"""
)
def gc_content(spark, d):
    return C.gc_content(corpus(spark, d)).select(F.round("gc", 6).alias("gc"))


@query(f"WITH {CORPUS}, {_windows(4)} SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer")
def kmer_counts(spark, d):
    return C.count_kmers(corpus(spark, d), 4, strands=1)


@query(f"WITH {CORPUS}, {_windows(6)} SELECT kmer, count(*) AS cnt FROM (SELECT kmer FROM w UNION ALL SELECT {RC} FROM w) GROUP BY kmer")
def kmer_counts_both_strands(spark, d):
    return C.count_kmers(corpus(spark, d), 6)


@query(f"WITH {CORPUS}, {_windows(21)} SELECT kmer, count(*) AS cnt FROM (SELECT kmer FROM w UNION ALL SELECT {RC} FROM w) GROUP BY kmer")
def kmer_counts_21(spark, d):
    return C.count_kmers(dealt(spark, d), 21)


@query(f"WITH {CORPUS}, {_windows(5)} SELECT least(kmer, {RC}) AS canon, count(*) AS cnt FROM w GROUP BY 1")
def kmer_canonical_counts(spark, d):
    return C.canonical_kmers(corpus(spark, d), 5).select("canon", *_long("cnt"))


@query(
    f"""WITH {CORPUS}, {_windows(8)},
    c AS (SELECT kmer, count(*) AS cnt FROM (SELECT kmer FROM w UNION ALL SELECT {RC} FROM w) GROUP BY kmer HAVING count(*) >= 5),
    s AS (SELECT CAST(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) AS DOUBLE) / sum(length(seq)) AS gc, sum(greatest(length(seq) - 7, 0) * 2) AS p FROM corpus),
    r AS (SELECT kmer, cnt, cnt / greatest(pow(gc / 2, length(regexp_replace(kmer, '[^GC]', '', 'g')))
      * pow((1 - gc) / 2, 8 - length(regexp_replace(kmer, '[^GC]', '', 'g'))) * p, 1.0) AS ratio FROM c, s),
    o AS (SELECT *, row_number() OVER (PARTITION BY least(kmer, {RC}) ORDER BY ratio DESC, kmer) AS n FROM r)
    SELECT kmer, cnt, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY ratio DESC, kmer) AS rnk FROM o WHERE n = 1
    QUALIFY row_number() OVER (ORDER BY ratio DESC, kmer) <= 25"""
)
def kmer_enrichment_topk(spark, d):
    return C.enriched(corpus(spark, d), 8, 25).select("kmer", *_long("cnt"), F.round("ratio", 6).alias("ratio"), *_long("rnk"))


@query(
    SQL["kmer_enrichment_topk"].replace("<= 25", "<= 5").replace("SELECT kmer, cnt, round(ratio, 6) AS ratio, row_number()", ", b AS (SELECT kmer, row_number()").replace("FROM o WHERE n = 1", "FROM o WHERE n = 1", 1)
    + """)
    SELECT rnk, kmer, p AS pos, round(log2(CASE WHEN l = 'A' THEN h ELSE m END + CAST(1e-10 AS DOUBLE)), 6) AS a, round(log2(CASE WHEN l = 'C' THEN h ELSE m END + CAST(1e-10 AS DOUBLE)), 6) AS c,
      round(log2(CASE WHEN l = 'G' THEN h ELSE m END + CAST(1e-10 AS DOUBLE)), 6) AS g, round(log2(CASE WHEN l = 'T' THEN h ELSE m END + CAST(1e-10 AS DOUBLE)), 6) AS t
    FROM (SELECT rnk, kmer, p, substring(kmer, p + 1, 1) AS l, CAST(0.7 AS DOUBLE) AS h, CAST(0.1 AS DOUBLE) AS m FROM b, range(8) x(p))"""
)
def seed_pwms(spark, d):
    rows = C.seed_pwms(corpus(spark, d), 5, 8).select("rnk", "kmer", F.posexplode("pwm").alias("pos", "r"))
    return rows.select(*_long("rnk"), "kmer", *_long("pos"), *[F.round(F.col("r")[i], 6).alias(c) for i, c in enumerate("acgt")])


def _background_sql(order: int) -> str:
    index = " + ".join(f"(instr('ACGT', substring(kmer, {i + 1}, 1)) - 1) * {4 ** (order - i)}" for i in range(order + 1))
    return f"""WITH {CORPUS}, {_windows(order + 1)}, s AS (SELECT {index} AS id, count(*) AS cnt FROM w GROUP BY 1),
    f AS (SELECT g.id // 4 AS ctx, g.id % 4 AS base, coalesce(cnt, 0) AS cnt FROM range({4 ** (order + 1)}) g(id) LEFT JOIN s ON s.id = g.id)
    SELECT ctx, base, cnt, round(log2((cnt + CAST(0.01 AS DOUBLE)) / (sum(cnt) OVER (PARTITION BY ctx) + CAST(0.04 AS DOUBLE)) + CAST(1e-10 AS DOUBLE)), 6) AS logp FROM f"""


def _background(order: int) -> Query:
    def run(spark, d):
        return C.background(corpus(spark, d), order).select(*_long("ctx", "base", "cnt"), F.round("logp", 6).alias("logp"))

    run.__name__ = f"markov_bg_order{order}"
    return run


for _order in range(6):
    query(_background_sql(_order))(_background(_order))


@query(
    f"""WITH {CORPUS}, c AS (SELECT unnest(string_split(substring(seq, 1, 3), '')) AS c FROM corpus WHERE seq <> ''),
    n AS (SELECT instr('ACGT', c) - 1 AS base, count(*) AS cnt FROM c GROUP BY 1)
    SELECT g.base, round((coalesce(cnt, 0) + CAST(0.01 AS DOUBLE)) / sum(coalesce(cnt, 0) + CAST(0.01 AS DOUBLE)) OVER (), 6) AS p
    FROM range(4) g(base) LEFT JOIN n ON n.base = g.base"""
)
def init_base_probs(spark, d):
    return C.initial_bases(corpus(spark, d), 3).select(*_long("base"), F.round("p", 6).alias("p"))


@query(
    f"""WITH {CORPUS}, {_windows(1)}, s AS (SELECT instr('ACGT', kmer) - 1 AS base, count(*) AS cnt FROM w GROUP BY 1),
    p AS (SELECT base, (cnt + CAST(0.01 AS DOUBLE)) / (sum(cnt) OVER () + CAST(0.04 AS DOUBLE)) + CAST(1e-10 AS DOUBLE) AS p FROM s)
    SELECT round(max(p) FILTER (base = 0), 6) AS a, round(max(p) FILTER (base = 1), 6) AS c, round(max(p) FILTER (base = 2), 6) AS g,
      round(max(p) FILTER (base = 3), 6) AS t, round(max(p) FILTER (base = 1) + max(p) FILTER (base = 2), 6) AS gc FROM p"""
)
def background_summary(spark, d):
    return C.background_stats(C.background(corpus(spark, d), 0)).select(*[F.round(c, 6).alias(c) for c in ("a", "c", "g", "t", "gc")])


@query(
    """WITH corpus AS (SELECT doc_id AS seq_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') AS seq FROM documents),
    """ + _windows(5) + " SELECT seq_id, count(*) AS known FROM w WHERE NOT contains(kmer, 'N') GROUP BY seq_id"
)
def n_window_filter(spark, d):
    letters = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN]", "")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.size(B.kmers(letters, 5)).cast("long").alias("known"))
    return docs.filter("known > 0")


@query(f"""WITH {CORPUS}, {_windows(3)} SELECT DISTINCT kmer, CAST((instr('ACGT', substring(kmer, 1, 1)) - 1) * 16 + (instr('ACGT', substring(kmer, 2, 1)) - 1) * 4
    + instr('ACGT', substring(kmer, 3, 1)) - 1 AS BIGINT) AS idx FROM w""")
def context_index(spark, d):
    return C.count_kmers(corpus(spark, d), 3, strands=1).select("kmer", B.context_index(F.col("kmer")).alias("idx"))


@query(f"WITH {CORPUS}, {_windows(2)} SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer")
def dinucl_counts(spark, d):
    return C.dinucleotides(corpus(spark, d))


@query(
    f"""WITH {CORPUS} SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS total, round(avg(length(seq)), 6) AS mean,
    round(log2(1 - least(2 / avg(length(seq)), CAST(0.9999 AS DOUBLE))), 6) AS stay, round(log2(1 / avg(length(seq))), 6) AS enter,
    greatest(50, CAST(floor(50 * log10(greatest(sum(length(seq)), 100))) AS BIGINT)) AS ensemble FROM corpus"""
)
def mean_len_transition(spark, d):
    r = C.lengths(corpus(spark, d)).first()
    mean = float(r["mean"] or 1.0)
    stay, enter = C.transitions(mean, 2)
    row = (r["n"], r["total"], round(mean, 6), round(stay, 6), round(enter, 6), C.ensemble_size(r["total"] or 0))
    return spark.createDataFrame([row], "n long, total long, mean double, stay double, enter double, ensemble long")


@query(f"WITH {CORPUS} SELECT seq_id, translate(seq, 'ACGT', '0123') AS codes FROM corpus")
def base_codes(spark, d):
    return corpus(spark, d).select("seq_id", F.array_join(F.transform(B.encode(F.col("seq")), lambda c: c.cast("string")), "").alias("codes"))


@query(
    """WITH corpus AS (SELECT doc_id AS seq_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTNRY]', '', 'g') AS seq FROM documents),
    """ + _windows(4) + " SELECT kmer, count(*) AS cnt FROM w WHERE NOT contains(kmer, 'N') GROUP BY kmer"
)
def kmer_counts_without_n(spark, d):
    """Windows of any letters but N."""
    letters = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTNRY]", "")
    return table(spark, d, "documents").select(F.explode(B.kmers(letters, 4, only_n=True)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))


@query(
    """SELECT event_id, round(greatest(x, y) + log2(1 + pow(CAST(2 AS DOUBLE), -abs(x - y))), 6) AS total
    FROM (SELECT event_id, -value / 10 AS x, CAST(event_id % 40 AS DOUBLE) - 20 AS y FROM events WHERE value IS NOT NULL)"""
)
def log2_add(spark, d):
    e = table(spark, d, "events").filter("value is not null")
    return e.select("event_id", F.round(B.log2_add(-F.col("value") / 10, (F.col("event_id") % 40).cast("double") - 20), 6).alias("total"))


@query(
    f"""WITH {CORPUS}, c AS (SELECT i AS pos, substring(seq, i + 1, 1) AS b FROM corpus, range(12) t(i) WHERE length(seq) > i),
    n AS (SELECT pos, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t FROM c GROUP BY pos)
    SELECT pos, round((a + CAST(0.1 AS DOUBLE)) / (a + c + g + t + CAST(0.4 AS DOUBLE)), 6) AS a, round((c + CAST(0.1 AS DOUBLE)) / (a + c + g + t + CAST(0.4 AS DOUBLE)), 6) AS c,
      round((g + CAST(0.1 AS DOUBLE)) / (a + c + g + t + CAST(0.4 AS DOUBLE)), 6) AS g, round((t + CAST(0.1 AS DOUBLE)) / (a + c + g + t + CAST(0.4 AS DOUBLE)), 6) AS t FROM n"""
)
def pwm_of_first_letters(spark, d):
    """A motif from the counts of bases at the first twelve places of all sequences."""
    letters = corpus(spark, d).select(F.posexplode(B.encode(F.substring("seq", 1, 12))).alias("pos", "b"))
    counts = letters.groupBy("pos").agg(F.array(*[F.count_if(F.col("b") == i) for i in range(4)]).alias("n"))
    rows = counts.select("pos", M.column_from_counts(F.array("n"))[0].alias("p"))
    return rows.select(*_long("pos"), *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate("acgt")])


def score_sql(pwm) -> str:
    return " + ".join(
        "CASE substring(kmer, %d, 1) %s END" % (i + 1, " ".join(f"WHEN '{b}' THEN CAST({float(x)!r} AS DOUBLE)" for b, x in zip(B.BASES, r, strict=True))) for i, r in enumerate(pwm)
    )


_FWD, _REV = score_sql(MOTIF), score_sql(M.reverse(MOTIF))
_SCAN = f"WITH {CORPUS}, {_windows(6)}, s AS (SELECT seq_id, pos, {_FWD} AS score FROM w)"
_DUAL = f"WITH {CORPUS}, {_windows(6)}, s AS (SELECT seq_id, pos, greatest({_FWD}, {_REV}) AS score FROM w)"


@query(f"{_SCAN} SELECT seq_id, pos, round(score, 6) AS score FROM s WHERE score >= -10")
def pwm_scan_fwd(spark, d):
    return scan.scan(corpus(spark, d), MOTIF).filter("score >= -10").select("seq_id", *_long("pos"), F.round("score", 6).alias("score"))


@query(f"{_DUAL} SELECT seq_id, pos, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, pos) = 1")
def pwm_scan_dual_best(spark, d):
    return scan.best_hits(corpus(spark, d), MOTIF).select("seq_id", *_long("pos"), F.round("score", 6).alias("score"))


_SECOND = score_sql(SECOND)


@query(
    f"""WITH {CORPUS}, {_windows(6)}, {_windows(5).replace("w AS", "v AS")},
    s AS (SELECT seq_id, pos - 2 AS pos, CAST(0.5 AS DOUBLE) * ({_FWD}) AS score FROM w UNION ALL SELECT seq_id, pos + 1 AS pos, CAST(2 AS DOUBLE) * ({_SECOND}) FROM v)
    SELECT seq_id, pos, round(sum(score), 6) AS score FROM s GROUP BY seq_id, pos HAVING count(*) = 2 AND sum(score) >= -20"""
)
def weighted_matrices(spark, d):
    """Sites of two matrices at fixed places of each other, one of half and one of double weight."""
    sites = scan.summed_sites(dealt(spark, d), [scan.Matrix("first", MOTIF, 2, 0.5), scan.Matrix("second", SECOND, -1, 2.0)], -20.0)
    return sites.select("seq_id", *_long("pos"), F.round("score", 6).alias("score"))


@query(
    """WITH c AS (SELECT DISTINCT event_type AS component, CASE WHEN event_type < 'm' THEN 'early' ELSE 'late' END AS grp, CAST(length(event_type) AS DOUBLE) AS weight FROM events
      UNION ALL SELECT DISTINCT event_type, 'all', NULL FROM events)
    SELECT user_id, grp, count(*) AS n, round(sum(value * coalesce(weight, 1)), 4) AS total FROM events JOIN c ON component = event_type WHERE value IS NOT NULL GROUP BY user_id, grp"""
)
def component_groups(spark, d):
    """Each user as a datum, event types as components of groups."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    own = e.select(kind.alias("component"), F.when(kind < "m", "early").otherwise("late").alias("grp"), F.length(kind).cast("double").alias("weight")).distinct()
    every = e.select(kind.alias("component"), F.lit("all").alias("grp"), F.lit(None).cast("double").alias("weight")).distinct()
    out = scan.group_contributions(e.select(F.col("user_id").alias("seq_id"), kind.alias("component"), "value"), own.unionByName(every))
    return out.select(F.col("seq_id").alias("user_id"), "grp", *_long("n"), F.round("total", 4).alias("total"))


def _rule_sql(letters: str, hit, miss) -> str:
    """A window's score where a base in a position's set weighs ``hit`` and any other ``miss``, by the size of the set."""
    return " + ".join(f"CASE WHEN instr('{of}', substring(kmer, {i + 1}, 1)) > 0 THEN log2({hit(len(of))}) ELSE log2({miss(len(of))}) END" for i, of in enumerate(letters.split()))


#: TATAWAWR spelt out.
_IUPAC = _rule_sql("T A T A AT A AT AG", lambda n: f"CAST(0.95 AS DOUBLE) / {n} + CAST(0.0125 AS DOUBLE)", lambda n: "CAST(0.0125 AS DOUBLE)")
_SOLID = _rule_sql("G A T T A C A", lambda n: "CAST(0.85 AS DOUBLE)", lambda n: "CAST(0.05 AS DOUBLE)")


@query(f"WITH {CORPUS}, {_windows(8)}, s AS (SELECT seq_id, pos, round({_IUPAC}, 6) AS score FROM w) SELECT seq_id, max(score) AS score FROM s GROUP BY seq_id")
def iupac_scan_best(spark, d):
    return scan.best_hits(corpus(spark, d), np.log2(M.iupac_pwm("TATAWAWR")), both_strands=False).select("seq_id", F.round("score", 6).alias("score"))


@query(f"WITH {CORPUS}, {_windows(7)}, s AS (SELECT seq_id, pos, round({_SOLID}, 6) AS score FROM w) SELECT seq_id, max(score) AS score FROM s GROUP BY seq_id")
def consensus_scan_best(spark, d):
    """A consensus of strength 0.8: each base weighs 0.85, the others 0.05."""
    return scan.best_hits(corpus(spark, d), np.log2(M.consensus_pwm("GATTACA", 0.8)), both_strands=False).select("seq_id", F.round("score", 6).alias("score"))


@query("SELECT conv_id AS seq_id, arg_max(text, turn) AS seq, min(turn) AS ord FROM conversations GROUP BY conv_id")
def last_record_wins(spark, d):
    """Conversations as records of one id: the last one's text at the first one's place."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("text").alias("seq"), F.col("turn").alias("ord"))
    return C.last_wins(rows)


@query(f"{_DUAL} SELECT seq_id, count(*) AS hits FROM s WHERE score >= -6 GROUP BY seq_id")
def pwm_hits_per_sequence(spark, d):
    return scan.hits(corpus(spark, d), MOTIF, -6.0)


@query(f"{_SCAN} SELECT seq_id, round(log2(sum(pow(CAST(2 AS DOUBLE), score))), 6) AS total FROM s GROUP BY seq_id")
def scan_log2sumexp(spark, d):
    return scan.log2_sums(dealt(spark, d), MOTIF).select("seq_id", F.round("total", 6).alias("total"))


@query(
    f"""{_SCAN}, t AS (SELECT seq_id, log2(sum(pow(CAST(2 AS DOUBLE), score))) + 12 AS x FROM s GROUP BY seq_id),
    {_windows(5).replace("w AS", "v AS")}, u AS (SELECT seq_id, log2(sum(pow(CAST(2 AS DOUBLE), {score_sql(SECOND)}))) + 10 AS x FROM v GROUP BY seq_id),
    e AS (SELECT corpus.seq_id, CAST(0.5 AS DOUBLE) * coalesce(t.x, 0) - CAST(0.25 AS DOUBLE) * coalesce(u.x, 0) AS eta FROM corpus LEFT JOIN t USING (seq_id) LEFT JOIN u USING (seq_id))
    SELECT seq_id, round(eta, 6) AS eta, round(1 / (1 + exp(-eta)), 6) AS p,
      round(log2(CASE WHEN quality = 1 THEN 1 / (1 + exp(-eta)) ELSE 1 - 1 / (1 + exp(-eta)) END), 6) AS log2_lik
    FROM e JOIN labels ON doc_id = seq_id"""
)
def logistic_facet(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), (F.col("quality") == 1).alias("label"))
    out = scan.logistic_facet(corpus(spark, d), labels, [MOTIF, SECOND], [0.5, -0.25])
    return out.select("seq_id", *[F.round(c, 6).alias(c) for c in ("eta", "p", "log2_lik")])


def motif_table(spark: SparkSession, d: str) -> DataFrame:
    """``(motif_id, pwm)``: probabilities."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("motif_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = F.transform(F.sequence(F.lit(0), (F.size("e") / 4).cast("int") - 1), lambda i: F.transform(F.slice("e", i * 4 + 1, 4), lambda x: F.abs(x) + 0.01))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    return e.filter("size(e) >= 4").select("motif_id", F.transform(rows, lambda r: F.transform(r, lambda x: x / total(r))).alias("pwm"))


#: The motif table, one row a position.
MOTIFS = """m0 AS (SELECT vec_id AS motif_id, p, [abs(CAST(embedding[4*p+1] AS DOUBLE)) + CAST(0.01 AS DOUBLE), abs(CAST(embedding[4*p+2] AS DOUBLE)) + CAST(0.01 AS DOUBLE),
    abs(CAST(embedding[4*p+3] AS DOUBLE)) + CAST(0.01 AS DOUBLE), abs(CAST(embedding[4*p+4] AS DOUBLE)) + CAST(0.01 AS DOUBLE)] AS r
    FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 4)) AS p FROM embeddings)),
    m AS (SELECT motif_id, p, list_transform(r, lambda x: x / list_sum(r)) AS r FROM m0)"""
_LETTER = "substring('ACGT', CAST(list_position(r, list_max(r)) AS BIGINT), 1)"


@query(f"WITH {MOTIFS} SELECT motif_id, string_agg({_LETTER}, '' ORDER BY p) AS consensus FROM m GROUP BY motif_id")
def pwm_consensus(spark, d):
    return motif_table(spark, d).select("motif_id", M.column_consensus(F.col("pwm")).alias("consensus"))


@query(f"WITH {MOTIFS} SELECT motif_id, round(sum(2 + list_sum(list_transform(r, lambda x: x * log2(greatest(x, CAST(1e-10 AS DOUBLE)))))), 6) AS bits FROM m GROUP BY motif_id")
def pwm_information_content(spark, d):
    return motif_table(spark, d).select("motif_id", F.round(M.column_information(F.col("pwm")), 6).alias("bits"))


@query(f"WITH {MOTIFS} SELECT motif_id, string_agg({_LETTER.replace('(r', '(list_reverse(r)')}, '' ORDER BY p DESC) AS consensus FROM m GROUP BY motif_id".replace("list_max(list_reverse(r))", "list_max(r)"))
def pwm_revcomp(spark, d):
    return motif_table(spark, d).select("motif_id", M.column_consensus(M.column_reverse(F.col("pwm"))).alias("consensus"))


@query(f"WITH {MOTIFS} SELECT motif_id, round(avg(list_max(r)), 6) AS chance FROM m GROUP BY motif_id")
def pwm_dominant(spark, d):
    return motif_table(spark, d).select("motif_id", F.round(M.column_dominant(F.col("pwm")), 6).alias("chance"))


@query(
    f"""WITH {MOTIFS}, x AS (SELECT motif_id, p, list_transform(r, lambda x: greatest(pow(CAST(2 AS DOUBLE), 40 * x - 40), CAST(1e-10 AS DOUBLE))) AS w FROM m)
    SELECT motif_id, p AS pos, round(w[1] / list_sum(w), 6) AS a, round(w[2] / list_sum(w), 6) AS c, round(w[3] / list_sum(w), 6) AS g, round(w[4] / list_sum(w), 6) AS t FROM x"""
)
def pwm_perturb(spark, d):
    """Log2 weights of up to 40 bits back to probabilities, floored and normalised."""
    weights = F.transform("pwm", lambda r: F.transform(r, lambda x: 40 * x - 40))
    rows = motif_table(spark, d).select("motif_id", F.posexplode(M.column_perturb(weights)).alias("pos", "r"))
    return rows.select("motif_id", *_long("pos"), *[F.round(F.col("r")[i], 6).alias(c) for i, c in enumerate("acgt")])


_PAIRS = f"""WITH {MOTIFS}, c AS (SELECT q.motif_id AS query_id, o.motif_id AS other_id, q.p, q.r AS a, o.r AS b
    FROM m q JOIN m o ON q.p = o.p AND q.motif_id <> o.motif_id WHERE q.motif_id % 50 = 0),
    k AS (SELECT query_id, other_id, p, list_sum(a) AS sa, list_sum(b) AS sb, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb,
      sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM c)"""


def _best(spark, d, measure):
    """Every motif whose id is divisible by 50 against all others."""
    all_ = motif_table(spark, d)
    return compare.best_matches(all_.filter("motif_id % 50 = 0"), all_, measure)


_FIRST = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, other_id) = 1"


@query(
    f"""{_PAIRS}, s AS (SELECT query_id, other_id, round(avg((ab - sa * sb / 4) / sqrt((aa - sa * sa / 4) * (bb - sb * sb / 4))), 6) AS value FROM k GROUP BY 1, 2)
    SELECT query_id, other_id, value FROM s {_FIRST}"""
)
def pwm_pearson_best_match(spark, d):
    return _best(spark, d, compare.pearson)


@query(f"{_PAIRS}, s AS (SELECT query_id, other_id, round(-sqrt(sum(dist * dist)), 6) AS value FROM k GROUP BY 1, 2) SELECT query_id, other_id, value FROM s {_FIRST}")
def pwm_euclidean(spark, d):
    return _best(spark, d, compare.euclidean)


@query(
    f"""{_PAIRS}, s AS (SELECT query_id, other_id, round(-sum(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * log2(z[1] / z[2])))), 6) AS value FROM c GROUP BY 1, 2)
    SELECT query_id, other_id, value FROM s {_FIRST}"""
)
def pwm_kl(spark, d):
    return _best(spark, d, compare.kullback_leibler)


@query(
    f"""{_PAIRS}, s AS (SELECT query_id, other_id, avg((ab - sa * sb / 4) / sqrt((aa - sa * sa / 4) * (bb - sb * sb / 4))) AS f FROM k GROUP BY 1, 2),
    n AS (SELECT motif_id, max(p) AS top FROM m GROUP BY 1),
    t AS (SELECT q.motif_id AS query_id, o.motif_id AS other_id, q.r AS a, list_reverse(o.r) AS b FROM m q JOIN m o ON q.motif_id <> o.motif_id JOIN n ON n.motif_id = o.motif_id AND o.p = top - q.p WHERE q.motif_id % 50 = 0),
    u AS (SELECT query_id, other_id, list_sum(a) AS sa, list_sum(b) AS sb, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM t),
    v AS (SELECT query_id, other_id, avg((ab - sa * sb / 4) / sqrt((aa - sa * sa / 4) * (bb - sb * sb / 4))) AS r FROM u GROUP BY 1, 2),
    z AS (SELECT query_id, other_id, round(greatest(f, r), 6) AS value FROM s JOIN v USING (query_id, other_id)) SELECT query_id, other_id, value FROM z {_FIRST}"""
)
def pwm_either_strand(spark, d):
    return _best(spark, d, compare.either_strand)


@query(f"{_PAIRS}, s AS (SELECT query_id, other_id, round(-sqrt(sum(dist * dist)), 6) AS value FROM k WHERE p < 5 GROUP BY 1, 2) SELECT query_id, other_id, value FROM s {_FIRST}")
def pwm_distance_of_shorter(spark, d):
    """The first five positions of each query motif against as many of all others."""
    all_ = motif_table(spark, d)
    return compare.best_matches(all_.filter("motif_id % 50 = 0").withColumn("pwm", F.slice("pwm", 1, 5)), all_, compare.shorter)


@query(
    """WITH e AS (SELECT user_id AS grp, event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)
    SELECT grp, id, s AS start FROM e WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.grp = e.grp AND o.id % 2 = 1 AND abs(o.s - e.s) < 3600)"""
)
def interval_free(spark, d):
    """Hours that begin with the events of even number and overlap none of those of odd number."""
    e = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))
    e = e.withColumn("end", F.col("start") + 3600)
    return intervals.free(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), 7200).select("grp", "id", "start")


@query(
    """WITH e AS (SELECT user_id AS grp, event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)
    SELECT a.grp, a.id AS a_id, b.id AS b_id, least(a.s, b.s) + 3600 - greatest(a.s, b.s) AS overlap FROM e a JOIN e b ON a.grp = b.grp AND a.id < b.id AND abs(a.s - b.s) < 3600"""
)
def interval_overlap(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))
    e = e.withColumn("end", F.col("start") + 3600)
    return intervals.overlaps(e, e, 7200).filter("a_id < b_id")


_LSE = "SELECT {0}, round(m + log2(sum(pow(CAST(2 AS DOUBLE), value / 10 - m))), 6) AS total FROM (SELECT {0}, value, max(value / 10) OVER (PARTITION BY {0}) AS m FROM events WHERE value IS NOT NULL) GROUP BY {0}, m"


@query(_LSE.format("user_id"))
def log2sumexp_sql(spark, d):
    """The aggregate from SQL text."""
    B.register(spark)
    table(spark, d, "events").createOrReplaceTempView(name := f"events_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT user_id, round(log2sumexp(value / 10), 6) AS total FROM {name} WHERE value IS NOT NULL GROUP BY user_id")


@query(_LSE.format("event_type"))
def log2sumexp_groups(spark, d):
    """The same for a few large groups, by partial sums."""
    return B.log2_sum_by(table(spark, d, "events").withColumn("x", F.col("value") / 10), ["event_type"], "x").select("event_type", F.round("total", 6).alias("total"))


@query("SELECT event_type, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY event_type")
def likelihood_iqr(spark, d):
    q = quantiles.quantiles(table(spark, d, "events"), "event_type", "value", [0.25, 0.75])
    return q.groupBy("event_type").agg(F.round(F.max(F.when(F.col("share") > 0.5, F.col("value"))) - F.max(F.when(F.col("share") < 0.5, F.col("value"))), 6).alias("iqr"))


def _dead(spark, d):
    """Dead points from the events: likelihoods rise with their rank by value, 100 live points."""
    e = table(spark, d, "events").filter("value is not null").groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("c"))
    step = F.row_number().over(W.orderBy("m", "event_type"))
    width = (F.log(F.lit(0.5)) - F.col("step") / 100 + F.log(F.exp(F.lit(0.01)) - F.exp(F.lit(-0.01)))) / F.log(F.lit(2.0))
    return e.select(step.alias("step"), (F.col("m") / 10).alias("log2_lik")).withColumn("log2_width", width)


_DEAD = """WITH e AS (SELECT event_type, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY 1),
    d AS (SELECT row_number() OVER (ORDER BY m, event_type) AS step, m / 10 AS log2_lik FROM e),
    t AS (SELECT *, log2_lik + (ln(CAST(0.5 AS DOUBLE)) - step / CAST(100 AS DOUBLE) + ln(exp(CAST(0.01 AS DOUBLE)) - exp(CAST(-0.01 AS DOUBLE)))) / ln(CAST(2 AS DOUBLE)) AS x FROM d),
    r AS (SELECT step, log2_lik, max(x) OVER () + log2(sum(pow(CAST(2 AS DOUBLE), x - (SELECT max(x) FROM t))) OVER (ORDER BY step)) AS z FROM t)"""


@query(f"{_DEAD} SELECT step, round(log2_lik, 6) AS log2_lik, round(z, 6) AS log2_evidence FROM r")
def evidence_running(spark, d):
    return sampler.running_evidence(_dead(spark, d)).select(*_long("step"), *[F.round(c, 6).alias(c) for c in ("log2_lik", "log2_evidence")])


@query(f"{_DEAD} SELECT round(greatest(0, max(log2_lik) - max_by(z, step)), 6) AS remaining, round(max_by(z, step) - avg(log2_lik), 6) AS information FROM r")
def remaining_info(spark, d):
    r = sampler.running_evidence(_dead(spark, d)).orderBy("step").collect()
    z, liks = r[-1]["log2_evidence"], [x["log2_lik"] for x in r]
    return spark.createDataFrame([(round(sampler.remaining(z, liks), 6), round(sampler.information(z, liks), 6))], "remaining double, information double")


@query(
    """WITH p AS (SELECT user_id, event_id % 4 AS thread, value / 10 AS lik, event_id, 5 + event_id % 4 AS live FROM events WHERE value IS NOT NULL),
    a AS (SELECT *, live - (row_number() OVER (PARTITION BY user_id, thread ORDER BY lik DESC, event_id DESC) = 1)::INT AS after,
      row_number() OVER (PARTITION BY user_id, thread ORDER BY lik, event_id) AS k FROM p),
    n AS (SELECT *, sum(CASE WHEN k = 1 THEN live ELSE 0 END) OVER (PARTITION BY user_id) + sum(after - live) OVER o AS then_, row_number() OVER o AS step FROM a WINDOW o AS (PARTITION BY user_id ORDER BY lik, thread, event_id)),
    x AS (SELECT *, CAST(then_ - after + live AS DOUBLE) AS now_, sum(1 / CAST(then_ - after + live AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY step) AS log_x FROM n),
    w AS (SELECT *, (ln(0.5) - log_x + 1 / now_ + ln(1 - CASE WHEN then_ > 0 THEN exp(-1 / now_ - 1 / CAST(then_ AS DOUBLE)) ELSE 0 END)) / ln(2) AS width FROM x)
    SELECT user_id, step, thread, round(lik, 6) AS log2_lik, round(width, 6) AS log2_width,
      round(max(lik + width) OVER (PARTITION BY user_id) + log2(sum(pow(CAST(2 AS DOUBLE), lik + width - m)) OVER (PARTITION BY user_id ORDER BY step)), 6) AS log2_evidence
    FROM (SELECT *, max(lik + width) OVER (PARTITION BY user_id) AS m FROM w)"""
)
def evidence_merged(spark, d):
    """Each user's events as the deaths of four threads, which lose a live point at the end."""
    e = table(spark, d, "events").filter("value is not null").select("user_id", (F.col("event_id") % 4).alias("thread"), (F.col("value") / 10).alias("log2_lik"), "event_id")
    last = F.row_number().over(W.partitionBy("user_id", "thread").orderBy(F.desc("log2_lik"), F.desc("event_id"))) == 1
    live = F.col("thread") + 5
    rows = e.withColumn("live", live).withColumn("after", live - last.cast("int"))
    return sampler.merged_evidence(rows, ["user_id"]).select("user_id", *_long("step", "thread"), *[F.round(c, 6).alias(c) for c in ("log2_lik", "log2_width", "log2_evidence")])


@query(
    """WITH s AS (SELECT row_number() OVER (ORDER BY event_type) AS n, sum(value) / 100 AS logz FROM events GROUP BY event_type),
    g AS (SELECT n, logz, logz - lag(logz) OVER (ORDER BY n) AS gain FROM s)
    SELECT n, round(logz, 4) AS logz, round(gain, 4) AS gain, sum(CASE WHEN gain IS NULL OR gain > 5 THEN 0 ELSE 1 END) OVER (ORDER BY n) = 0 AS accepted FROM g"""
)
def bayes_factor_lag(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg((F.sum("value") / 100).alias("logz"))
    s = s.select(F.row_number().over(W.orderBy("event_type")).alias("n"), "logz")
    return sampler.accepted(s, 5.0).select(*_long("n"), F.round("logz", 4).alias("logz"), F.round("gain", 4).alias("gain"), "accepted")


_PRIORS = {"uniform": G.GapConfig(prior="uniform", shortest=3, longest=12), "geometric": G.GapConfig(param=0.3, shortest=1, longest=10), "poisson": G.GapConfig(prior="poisson", param=4.0, shortest=0, longest=15)}
_RAW = {"uniform": "CAST(0 AS DOUBLE)", "geometric": "g * ln(CAST(0.7 AS DOUBLE))", "poisson": "g * ln(CAST(4 AS DOUBLE)) - coalesce((SELECT sum(ln(i)) FROM range(1, g + 1) t(i)), 0)"}


def _gap(kind: str) -> Query:
    def run(spark, d):
        """The prior of each document's length, folded to gap lengths of which some are out of range."""
        c = _PRIORS[kind]
        gap = (F.col("length") % (c.longest + 3)).cast("int")
        return corpus(spark, d).select("seq_id", gap.cast("long").alias("gap"), F.round(G.prior_column(gap, c), 6).alias("logp"))

    run.__name__ = f"gap_prior_{kind}"
    return run


for _kind, _c in _PRIORS.items():
    query(
        f"""WITH {CORPUS}, r AS (SELECT g AS of, {_RAW[_kind]} AS x FROM range({_c.shortest}, {_c.longest + 1}) s(g)), p AS (SELECT of, x - ln(sum(exp(x)) OVER ()) AS logp FROM r)
        SELECT seq_id, gap, round(logp, 6) AS logp FROM (SELECT seq_id, length(seq) % {_c.longest + 3} AS gap FROM corpus) LEFT JOIN p ON of = gap"""
    )(_gap(_kind))


def _mean(spark, d) -> float:
    """Of the lengths; 1 where there are no sequences."""
    return float(C.lengths(corpus(spark, d)).first()["mean"] or 1.0)


def _uniform_models(spark, d, both):
    return [likelihood.Model.plain([MOTIF], np.full((1, 4), -2.0), _mean(spark, d), both)]


def _learned(spark, d, order: int) -> np.ndarray:
    bg = np.full((4**order, 4), -2.0)
    for r in C.background(corpus(spark, d), order).collect():
        bg[r["ctx"], r["base"]] = r["logp"]
    return bg


#: The chances of entering a motif and of staying in the background, for one motif.
_K = "c AS (SELECT 1 / avg(length(seq)) AS e FROM corpus), k AS MATERIALIZED (SELECT log2(1 - least(e, CAST(0.9999 AS DOUBLE))) AS stay, log2(e) AS enter FROM c)"


def _dp_sql(score: str, base: str = "-2", more: str = "", tables: str = "") -> str:
    """The recursion over positions: each row carries its last six values, the newest last; ``base`` weighs the base at place ``i + 1``."""
    return f"""WITH RECURSIVE {CORPUS}, {_K}{more},
    f(seq_id, seq, i, v) AS (SELECT seq_id, seq, 0, [CAST(0 AS DOUBLE)] FROM corpus
      UNION ALL SELECT seq_id, seq, i + 1, list_append(CASE WHEN len(v) >= 6 THEN v[2:] ELSE v END,
        CASE WHEN len(v) < 6 THEN b ELSE greatest(b, m) + log2(1 + pow(CAST(2 AS DOUBLE), -abs(b - m))) END)
      FROM (SELECT *, v[len(v)] + ({base}) + stay AS b, v[1] + enter + ({score}) AS m FROM (SELECT f.*, k.*, substring(seq, i - 4, 6) AS kmer{tables} WHERE i < length(seq))))
    SELECT seq_id, round(v[len(v)], 4) AS log2_lik FROM f WHERE i = length(seq)"""


def _plain_dp_sql(score: str) -> str:
    return _dp_sql(score, tables=" FROM f, k")


@query(_plain_dp_sql(_FWD))
def dp_likelihood_fwd(spark, d):
    out = likelihood.score_sequences(corpus(spark, d), _uniform_models(spark, d, False))
    return out.select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


@query(_plain_dp_sql(f"greatest({_FWD}, {_REV})"))
def dp_likelihood_dual(spark, d):
    out = likelihood.score_sequences(corpus(spark, d), _uniform_models(spark, d, True))
    return out.select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


@query(SQL["dp_likelihood_dual"])
def dp_likelihood_pieces(spark, d):
    """The same from pieces of 256 letters, each by a task's transfer matrix."""
    models = _uniform_models(spark, d, True)
    pieces = fasta_source.with_context(fasta_source.cut(dealt(spark, d), 256), likelihood.context_letters(models))
    return likelihood.score_pieces(pieces, models).select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


#: The weights of a learned background of order 3 as one list, by the number of four letters.
_BG3 = ", " + _background_sql(3).replace(f"WITH {CORPUS}, ", "").replace("SELECT ctx, base, cnt, round(", ", g AS (SELECT ctx * 4 + base AS id, (").replace(", 6) AS logp FROM f", ") AS logp FROM f)").replace("f AS (SELECT g.id", "f0 AS (SELECT g.id").replace("FROM f)", "FROM f0)") + ", bg AS MATERIALIZED (SELECT list(logp ORDER BY id) AS bgl FROM g)"
_CODE = lambda at: f"(instr('ACGT', substring(seq, {at}, 1)) - 1)"
_AT3 = f"CASE WHEN i < 3 THEN -2 ELSE bgl[CAST(1 + {_CODE('i - 2')} * 64 + {_CODE('i - 1')} * 16 + {_CODE('i')} * 4 + {_CODE('i + 1')} AS BIGINT)] END"


@query(_dp_sql(f"greatest({_FWD}, {_REV})", _AT3, _BG3, ", bgl FROM f, k, bg"))
def dp_likelihood_bg3(spark, d):
    """A motif on either strand over the corpus's own background of order 3."""
    model = likelihood.Model.plain([MOTIF], _learned(spark, d, 3), _mean(spark, d))
    return likelihood.score_sequences(corpus(spark, d), [model]).select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


#: Likelihood of every sequence as background of order 3 alone; the first three bases weigh 2 bits each.
_ALONE = f"""WITH {CORPUS}{_BG3}, l AS (SELECT seq_id, coalesce(sum(bgl[CAST(1 + {_CODE('i')} * 64 + {_CODE('i + 1')} * 16 + {_CODE('i + 2')} * 4 + {_CODE('i + 3')} AS BIGINT)]), 0) AS x
    FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM corpus), bg GROUP BY seq_id),
    a AS (SELECT corpus.seq_id, coalesce(x, 0) - 2 * least(length(seq), 3) AS log2_lik FROM corpus LEFT JOIN l USING (seq_id))"""


@query(f"{_ALONE} SELECT seq_id, round(log2_lik, 4) AS log2_lik FROM a")
def background_likelihood(spark, d):
    model = likelihood.Model([], _learned(spark, d, 3), _mean(spark, d))
    return likelihood.score_sequences(corpus(spark, d), [model]).select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


@query(f"{_ALONE} SELECT CAST(0 AS BIGINT) AS model_id, round(sum(log2_lik), 2) AS log2_lik FROM a")
def corpus_likelihood(spark, d):
    model = likelihood.Model([], _learned(spark, d, 3), _mean(spark, d))
    return likelihood.score_models(corpus(spark, d), [model]).select(*_long("model_id"), F.round("log2_lik", 2).alias("log2_lik"))


@query(
    f"""{_ALONE}, {_windows(6).replace("w AS", "y AS")}, z AS (SELECT seq_id, log2(sum(pow(CAST(2 AS DOUBLE), {_FWD}))) + 12 AS x FROM y GROUP BY seq_id),
    e AS (SELECT corpus.seq_id, CAST(0.5 AS DOUBLE) * coalesce(x, 0) AS eta FROM corpus LEFT JOIN z USING (seq_id)),
    q AS (SELECT e.seq_id, log2(CASE WHEN quality = 1 THEN 1 / (1 + exp(-eta)) ELSE 1 - 1 / (1 + exp(-eta)) END) AS y FROM e JOIN labels ON doc_id = e.seq_id)
    SELECT a.seq_id, round(a.log2_lik + coalesce(y, 0), 4) AS log2_lik FROM a LEFT JOIN q USING (seq_id)"""
)
def facets_sum(spark, d):
    """Two facets of each document: its sequence as background, and its label by a logistic model."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), (F.col("quality") == 1).alias("label"))
    model = likelihood.Model([], _learned(spark, d, 3), _mean(spark, d))
    rows = dealt(spark, d)
    one = likelihood.score_sequences(rows, [model])
    out = scan.sum_facets(one, scan.logistic_facet(rows, labels, [MOTIF], [0.5]))
    return out.select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


_GAPPED = [G.GapConfig(prior="uniform", shortest=0, longest=4), G.GapConfig(shortest=0, longest=4), G.GapConfig(prior="uniform", shortest=0, longest=0)]


@query(
    _dp_sql(_FWD, tables=", log2(1 - least(CAST(1 AS DOUBLE) / length(seq), CAST(0.9999 AS DOUBLE))) AS stay, log2(CAST(1 AS DOUBLE) / length(seq)) AS enter FROM f").replace("k.*, ", "")
    .replace("SELECT seq_id, round(v[len(v)], 4)", "SELECT seq_id, round(CASE WHEN seq_id % 2 = 0 THEN v[len(v)] ELSE -2 * length(seq) END, 4)")
)
def mixture_likelihood(spark, d):
    """A motif that is active in the documents of even number, entered once a sequence on average."""
    rows = corpus(spark, d).withColumn("active", F.array(F.col("seq_id") % 2 == 0))
    return mixture.likelihoods(rows, [MOTIF]).select("seq_id", F.round("log2_lik", 4).alias("log2_lik"))


@query(f"WITH {CORPUS} SELECT length(seq) AS length, count(*) AS n FROM corpus GROUP BY 1")
def length_histogram(spark, d):
    learned = synth.learned_lengths(corpus(spark, d))
    return spark.createDataFrame(list(zip(learned.values, learned.counts, strict=True)), "length long, n long")


def _gapped_sql(both: bool = True) -> str:
    """The recursion with two blocks of three bases and 0 to 4 bases between them; rows carry their last ten values, and letters are looked up in a window of the last ten."""
    raw = {0: ["1"] * 5, 1: [f"pow(CAST(0.9 AS DOUBLE), {g})" for g in range(5)], 2: ["1"]}
    priors = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS model_id, [" + ", ".join(f"log2(CAST({x} AS DOUBLE) / ({' + '.join(r)}))" for x in r) + "] AS pr" for k, r in raw.items())
    first, last, rev_first, rev_last = (score_sql(m) for m in (MOTIF[:3], MOTIF[3:], M.reverse(MOTIF[3:]), M.reverse(MOTIF[:3])))
    terms = []
    for g in range(5):
        a, z = f"substring(w, {5 - g}, 3)", "substring(w, 8, 3)"
        at = lambda s, w: f"({s.replace('kmer', w)})"
        fwd = f"{at(first, a)} + {at(last, z)}"
        best = f"greatest({fwd}, {at(rev_first, a)} + {at(rev_last, z)})" if both else fwd
        terms.append(f"CASE WHEN len(v) >= {6 + g} AND len(pr) > {g} THEN v[len(v) - {5 + g}] + enter + pr[{g + 1}] - {2 * g} + {best} ELSE -1e9 END AS m{g}")
    return f"""WITH RECURSIVE {CORPUS}, {_K}, cfg AS MATERIALIZED ({priors}),
    f(model_id, pr, seq_id, seq, n, i, v) AS (SELECT model_id, pr, seq_id, '##########' || seq, length(seq), 0, [CAST(0 AS DOUBLE)] FROM corpus, cfg
      UNION ALL SELECT model_id, pr, seq_id, seq, n, i + 1, list_append(CASE WHEN len(v) >= 10 THEN v[2:] ELSE v END, top + log2({" + ".join(f"pow(CAST(2 AS DOUBLE), {x} - top)" for x in ("b", "m0", "m1", "m2", "m3", "m4"))}))
      FROM (SELECT *, greatest(b, m0, m1, m2, m3, m4) AS top FROM (SELECT *, {", ".join(terms)}
        FROM (SELECT f.*, enter, v[len(v)] - 2 + stay AS b, substring(seq, i + 2, 10) AS w FROM f, k WHERE i < n))))
    SELECT seq_id, model_id, round(v[len(v)], 4) AS log2_lik FROM f WHERE i = n"""


def _gapped(spark, d, both: bool) -> DataFrame:
    mean = _mean(spark, d)
    models = [likelihood.Model([likelihood.Piece([MOTIF[:3], MOTIF[3:]], c)], np.full((1, 4), -2.0), mean, both) for c in _GAPPED]
    out = likelihood.score_sequences(corpus(spark, d), models)
    return out.select("seq_id", *_long("model_id"), F.round("log2_lik", 4).alias("log2_lik"))


@query(_gapped_sql())
def gapped_dp(spark, d):
    """Likelihood of each sequence under a motif of two blocks, for three priors of the gap between them."""
    return _gapped(spark, d, True)


@query(_gapped_sql(both=False))
def gapped_dp_fwd(spark, d):
    return _gapped(spark, d, False)


@query(f"WITH {CORPUS} SELECT CAST(seq_id AS VARCHAR) AS seq_id, CAST(i AS BIGINT) AS at, CAST(least(length(seq) - i, 512) AS BIGINT) AS length, md5(substring(seq, CAST(i AS BIGINT) + 1, 512)) AS letters FROM corpus, unnest(range(0, greatest(length(seq), 1), 512)) t(i)")
def fasta_source_pieces(spark, d):
    """All documents written as FASTA and read back by byte ranges, in pieces of 512 letters."""
    folder = new_folder(spark, "fasta")
    fasta.write_fasta(corpus(spark, d), folder)
    fasta_source.register(spark)
    rows = spark.read.format("fasta").option("rangeBytes", 1 << 16).option("pieceLetters", 512).load(folder)
    return rows.select("seq_id", "at", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("letters"))


@query()
def nested_sampling_run(spark, d):
    """A search over all documents, with the operator's own settings."""
    return sampler.running_evidence(sampler.Search(corpus(spark, d), seed=1).run().table())


@query()
def synthetic_generate(spark, d):
    """As many sequences as there are documents, of lengths and a background learned from these, with the motifs of a preset."""
    like = corpus(spark, d)
    return replace(synth.PRESETS["multi"], n=like.count(), lengths=synth.learned_lengths(like), background=synth.Markov.learned(like, 3)).generate(spark)


@query("SELECT concat('seq_', i) AS seq_id, 200 AS length, true AS found FROM (SELECT unnest(range(0, count(*))) AS i FROM documents)")
def synthetic_truth(spark, d):
    """Whether all that was planted, in a background learned from the documents, stands where the truth says."""
    like = corpus(spark, d)
    made = replace(synth.PRESETS["gapped"], n=like.count(), background=synth.Markov.learned(like, 1)).generate(spark)
    there = F.forall("planted", lambda p: F.substring(F.col("seq"), p["start"] + 1, p["end"] - p["start"]) == p["sequence"])
    return made.select("seq_id", "length", there.alias("found"))


@query()
def dinucl_shuffle(spark, d):
    """Each document's letters in another order with the same neighbours."""
    return synth.shuffle_texts(_dealt_texts(spark, d), 7)


@query(f"WITH {CORPUS}, {_windows(2)} SELECT seq_id, kmer, count(*) AS cnt FROM w GROUP BY seq_id, kmer")
def dinucl_shuffle_counts(spark, d):
    """Neighbours in the shuffled documents, which are those of the documents themselves."""
    return synth.count_shuffled(_dealt_texts(spark, d), 7)
