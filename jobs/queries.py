"""The jobs as queries: each runs twice into a new folder under ``spark.checkpoint.dir`` and returns what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import kmer_census, motif_sites
from seqloom.functions.motifs import reverse
from seqloom.plans.queries import CORPUS, score_sql
from seqloom.sources.folders import new_folder


def job1_kmer_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "kmer-census")
    for _ in range(2):
        out = kmer_census.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return out.select(F.col("grp").alias("source"), "kmer", "cnt", F.round("ratio", 6).alias("ratio"), F.col("rnk").cast("long").alias("rnk"))


def job2_motif_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites; the letters at each place of a motif's sites are output too."""
    at = new_folder(spark, "motif-sites")
    for _ in range(2):
        sites, _places = motif_sites.run(spark, f"{sf_dir}/documents.parquet", at)
    return sites.select(F.col("seq_id").alias("doc_id"), "motif", "pos", "strand", F.round("score", 6).alias("score"), "site")


def _census_sql() -> str:
    c = kmer_census.DEFAULTS
    k, rc = c["k"], "reverse(translate(kmer, 'ACGT', 'TGCA'))"
    gc_n = "length(regexp_replace(kmer, '[^GC]', '', 'g'))"
    return f"""WITH d AS (SELECT nullif(source, '') AS source, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents),
    w AS (SELECT source, substring(seq, i, {k}) AS kmer FROM (SELECT source, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM d)),
    c AS (SELECT source, kmer, count(*) AS cnt FROM (SELECT source, kmer FROM w UNION ALL SELECT source, {rc} FROM w) GROUP BY ALL HAVING count(*) >= {c["least"]}),
    s AS (SELECT source AS of, CAST(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) AS DOUBLE) / sum(length(seq)) AS gc, sum(greatest(length(seq) - {k - 1}, 0) * 2) AS p FROM d GROUP BY source),
    r AS (SELECT source, kmer, cnt, cnt / greatest(pow(gc / 2, {gc_n}) * pow((1 - gc) / 2, {k} - {gc_n}) * p, 1.0) AS ratio FROM c JOIN s ON source IS NOT DISTINCT FROM of),
    o AS (SELECT *, row_number() OVER (PARTITION BY source, least(kmer, {rc}) ORDER BY ratio DESC, kmer) AS n FROM r)
    SELECT source, kmer, cnt, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY source ORDER BY ratio DESC, kmer) AS rnk FROM o WHERE n = 1
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY ratio DESC, kmer) <= {c["top"]}"""


def _sites_sql() -> str:
    c, parts = motif_sites.DEFAULTS, []
    least = motif_sites.bounds(c)
    for name, m in motif_sites.matrices(c).items():
        w = len(m)
        parts.append(f"""SELECT seq_id, '{name}' AS motif, pos, kmer, round({score_sql(m)}, 9) AS plus, round({score_sql(reverse(m))}, 9) AS minus, CAST({least[name]!r} AS DOUBLE) AS least
        FROM (SELECT seq_id, i - 1 AS pos, substring(seq, i, {w}) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {w - 2})) AS i FROM corpus))""")
    return f"""WITH {CORPUS}, s AS ({" UNION ALL ".join(parts)}),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY seq_id, motif ORDER BY greatest(plus, minus) DESC, pos) = 1)
    SELECT seq_id AS doc_id, motif, CAST(pos AS BIGINT) AS pos, CASE WHEN plus >= minus THEN '+' ELSE '-' END AS strand, round(greatest(plus, minus), 6) AS score,
      CASE WHEN plus >= minus THEN kmer ELSE reverse(translate(kmer, 'ACGT', 'TGCA')) END AS site FROM b WHERE greatest(plus, minus) >= least"""


QUERIES = {"job1_kmer_census": job1_kmer_census, "job2_motif_sites": job2_motif_sites}
SQL = {"job1_kmer_census": _census_sql(), "job2_motif_sites": _sites_sql()}
