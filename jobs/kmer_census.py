"""Census of k-mers over a growing table of texts or sequences, with the most enriched ones of each group.

    python -m jobs.kmer_census --input TABLE --output FOLDER --checkpoint FOLDER [--config FILE]

A file stream takes the files that have arrived since the last run and stops. Each batch's counts
are written under its number, so a batch that is taken again after a failure replaces what it
wrote; the report is made anew from the counts of all batches. Running again without new files
changes nothing. Files are told apart by their path and are read once.

Output, as Parquet: ``counts/batch=N`` (grp, kmer, cnt) and ``letters/batch=N`` (grp, seqs, g, l, p)
of one batch, ``report/grp=G`` (kmer, cnt, ratio, rnk). A null or empty group is null.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.bases import clean
from seqloom.operators import corpus

log = logging.getLogger("kmer_census")
DEFAULTS = json.loads(Path(__file__).with_suffix(".json").read_text())
COUNTS = "grp string, kmer string, cnt long, batch long"
LETTERS = "grp string, seqs long, g long, l long, p long, batch long"
REPORT = "kmer string, cnt long, ratio double, rnk int, grp string"


def take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """Write one batch's counts in place of what an earlier attempt at it wrote."""
    k = config["k"]
    rows = batch.select(F.nullif(F.col(config["group"]).cast("string"), F.lit("")).alias("grp"), clean(F.col(config["text"])).alias("seq"))
    for name, part in (("counts", corpus.count_kmers(rows, k, strands=1, by=("grp",))), ("letters", corpus.composition(rows, k, ("grp",)))):
        part = part.withColumn("batch", F.lit(number).cast("long"))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/{name}")
    done = batch.sparkSession.read.schema(LETTERS).parquet(f"{output}/letters").filter(F.col("batch") == number).agg(F.count("*"), F.coalesce(F.sum("seqs"), F.lit(0))).first()
    log.info("batch %d: read %d rows, wrote the counts of %d groups", number, done[1], done[0])


def report(spark: SparkSession, output: str, config: dict) -> DataFrame:
    """``(grp, kmer, cnt, ratio, rnk)``: each group's most enriched k-mers on both strands, over all batches."""
    k, by = config["k"], ("grp",)
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts").groupBy("grp", "kmer").agg(F.sum("cnt").alias("cnt"))
    letters = spark.read.schema(LETTERS).parquet(f"{output}/letters").groupBy(F.col("grp").alias("of")).agg(*[F.sum(c).alias(c) for c in "glp"])
    both = corpus.other_strand(counts, by).filter(F.col("cnt") >= config["least"])
    rated = both.join(letters, F.col("grp").eqNullSafe(F.col("of"))).withColumn("ratio", corpus.enrichment(k))
    order = W.partitionBy("grp").orderBy(F.desc("ratio"), "kmer")
    best = corpus.one_spelling(rated, by).withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= config["top"])
    return best.select("kmer", "cnt", "ratio", "rnk", "grp")


def watched(table: DataFrame, source: str) -> str:
    """``source`` as a file stream takes it: a single file must be given as a pattern, a folder as it is."""
    row = table.select("_metadata.file_path").first()
    folder, _, name = unquote(row[0]).rpartition("/") if row else ("", "", "")
    return f"{source[:-1]}[{source[-1]}]" if source.endswith(f"/{name}") and not folder.endswith(source) else source


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new at ``source``, write to ``output`` and return the report as it stands."""
    config = DEFAULTS | (config or {})
    there = spark.read.format(config["format"]).load(source)
    # Without a bound on their age, files older than a week before the newest one would be passed over.
    files = spark.readStream.format(config["format"]).schema(there.schema).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d").load(watched(there, source))
    stream = files.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, config)).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    report(spark, output, config).write.mode("overwrite").partitionBy("grp").parquet(f"{output}/report")
    out = spark.read.schema(REPORT).parquet(f"{output}/report")
    log.info("wrote %d k-mers to %s", out.count(), f"{output}/report")
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    options = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("kmer_census").getOrCreate()
    try:
        config = json.loads(spark.read.text(options.config, wholetext=True).first()[0]) if options.config else None
        run(spark, options.input, options.output, options.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
