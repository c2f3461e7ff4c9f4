"""Sites of known motifs in a table of texts or sequences, with the matrices that the sites make.

    python -m jobs.motif_sites --input TABLE --output FOLDER [--config FILE]

Motifs are consensus strings of IUPAC letters in the configuration. One pass scores all of them on
both strands; a sequence's best site counts where it reaches the share ``least`` of the way from the
motif's lowest score to its highest. Output: ``sites/motif=M`` as Parquet and ``matrices/motif=M`` as
ORC, counts of the letters at each place of the sites. A run replaces the output of an earlier one, so
running again, also after a failure, leaves the same.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.bases import clean
from seqloom.functions.motifs import iupac_pwm
from seqloom.operators import scan

log = logging.getLogger("motif_sites")
DEFAULTS = json.loads(Path(__file__).with_suffix(".json").read_text())
SITES = "seq_id long, pos long, strand string, score double, site string, motif string"
MATRICES = "pos long, a long, c long, g long, t long, motif string"


def matrices(config: dict) -> dict[str, np.ndarray]:
    """log2 matrices by name."""
    return {name: np.log2(iupac_pwm(consensus)) for name, consensus in config["motifs"].items()}


def bounds(config: dict) -> dict[str, float]:
    """The score that a site of each motif must reach."""
    ends = {name: (m.min(axis=1).sum(), m.max(axis=1).sum()) for name, m in matrices(config).items()}
    return {name: round(float(low + config["least"] * (high - low)), 9) for name, (low, high) in ends.items()}


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the table at ``source``, write to ``output`` and return its sites and matrices.

    Rows without id and repeated ids are sequences of their own; a null text is empty and has no site.
    """
    config = DEFAULTS | (config or {})
    rows = spark.read.format(config["format"]).load(source).select(F.col(config["id"]).cast("long").alias("seq_id"), clean(F.col(config["text"])).alias("seq"))
    least = F.create_map(*[F.lit(x) for pair in bounds(config).items() for x in pair])
    found = scan.best_sites(rows, matrices(config)).filter(F.col("score") >= least[F.col("motif")])
    found.write.mode("overwrite").partitionBy("motif").parquet(f"{output}/sites")
    sites = spark.read.schema(SITES).parquet(f"{output}/sites")
    scan.site_counts(sites).write.mode("overwrite").partitionBy("motif").orc(f"{output}/matrices")
    out = spark.read.schema(MATRICES).orc(f"{output}/matrices")
    for r in sites.groupBy("motif").agg(F.count("*").alias("n"), F.countDistinct("seq_id").alias("ids")).collect():
        log.info("%s: wrote %d sites of %d ids", r["motif"], r["n"], r["ids"])
    log.info("read %d rows from %s, wrote %d places to %s", rows.count(), source, out.count(), f"{output}/matrices")
    return sites, out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("input", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    options = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("motif_sites").getOrCreate()
    try:
        config = json.loads(spark.read.text(options.config, wholetext=True).first()[0]) if options.config else None
        run(spark, options.input, options.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
