"""Command line: ``find``, ``discover``, ``mixture``, ``generate``, ``benchmark``, ``inspect``.

Run as ``python -m seqloom.cli COMMAND --help``.
"""

from __future__ import annotations

import argparse
import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from seqloom.functions.gaps import GapConfig
from seqloom.functions.motifs import GappedPattern, perturb
from seqloom.operators import corpus as C
from seqloom.operators import mixture, sampler, synth
from seqloom.sources import fasta, motif_files


#: Cycles for which a search for a fixed number of motifs goes on whatever its convergence.
GRACE = 500


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("-seqs", required=True)
    both.add_argument("-out", required=True)
    both.add_argument("-bgOrder", type=int, default=3)
    both.add_argument("-seed", type=int, default=0)
    both.add_argument("-adaptiveMCMC", action=argparse.BooleanOptionalAction, default=False)
    both.add_argument("-deaths", type=int, default=1, help="particles that die each round, each with a chain of its own")

    both.add_argument("-threads", type=int, default=0, help="independent live sets that the ensemble is dealt to; 0: by its size")

    f = sub.add_parser("find", parents=[both], help="a fixed number of motifs")
    f.add_argument("-numMotifs", type=int, default=1)
    f.add_argument("-motifLength", type=int, default=10)
    f.add_argument("-maxCycles", type=int, default=500)
    f.add_argument("-ensembleSize", type=int, default=20)
    f.add_argument("-stopIqr", type=float, default=0.01)
    f.add_argument("-stopH", type=float, default=0.1, help="log2 units that may remain")
    f.add_argument("-convergenceMode", choices=["skilling", "iqr"], default="skilling")
    f.add_argument("-checkpoint")
    f.add_argument("-checkpointInterval", type=int, default=100)
    f.add_argument("-restart")
    f.add_argument("-format", choices=sorted(motif_files.FORMATS), default="xms")
    f.add_argument("-kmerSeeds", action="store_true")
    f.add_argument("-allowGaps", action="store_true")
    f.add_argument("-minGapLength", type=int, default=0)
    f.add_argument("-maxGapLength", type=int, default=20)
    f.add_argument("-maxNumGaps", type=int, default=2)
    f.add_argument("-gapPrior", choices=["geometric", "uniform", "poisson"], default="geometric")
    f.add_argument("-gapParam", type=float, default=0.1)
    f.add_argument("-singleStrand", action="store_true")

    d = sub.add_parser("discover", parents=[both], help="as many motifs as the evidence supports")
    d.add_argument("-minMotifs", type=int, default=1)
    d.add_argument("-maxMotifs", type=int, default=10)
    d.add_argument("-bayesThreshold", type=float, default=5.0, help="gain in log2 evidence")
    d.add_argument("-ensembleSize", type=int)
    d.add_argument("-maxCycles", type=int, default=5000)
    d.add_argument("-stopIqr", type=float, default=0.5)
    d.add_argument("-startLength", type=int, default=10)

    m = sub.add_parser("mixture", help="each sequence with motifs of its own; for small sets")
    m.add_argument("-seqs", required=True)
    m.add_argument("-numMotifs", type=int, default=1)
    m.add_argument("-motifLength", type=int, default=10)
    m.add_argument("-ensembleSize", type=int, default=50)
    m.add_argument("-out", default="motifs.xms")
    m.add_argument("-maxCycles", type=int, default=1000)
    m.add_argument("-seed", type=int, default=0)

    g = sub.add_parser("generate", help="synthetic sequences with planted motifs")
    g.add_argument("-o", "--output", required=True, help="folder of FASTA part files")
    g.add_argument("-n", type=int, default=100)
    g.add_argument("-L", "--length", type=int, default=200)
    g.add_argument("--length-std", type=float, default=0)
    g.add_argument("--length-min", type=int, default=50)
    g.add_argument("--length-max", type=int, default=1000)
    g.add_argument("--gc", type=float, default=0.5)
    g.add_argument("--bg-order", type=int, default=0)
    g.add_argument("--bg-matrix", help="file of one line for each context, four chances a line; the order is that of as many contexts")
    g.add_argument("--learn-bg-from")
    g.add_argument("--bg-method", choices=["markov", "shuffle"], default="markov")
    g.add_argument("--motif", action="append", default=[])
    g.add_argument("--motif-file")
    g.add_argument("--density", type=float, default=0.8)
    g.add_argument("--strand-bias", type=float, default=0.5)
    g.add_argument("--occurrences", type=int, default=1)
    g.add_argument("--planting", choices=["uniform", "center", "clustered"], default="uniform")
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--truth", help="file of the truth as JSON")
    g.add_argument("--preset", choices=sorted(synth.PRESETS))

    b = sub.add_parser("benchmark", help="train and test sets drawn apart")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--train", type=int, default=1000)
    b.add_argument("--test", type=int, default=200)
    b.add_argument("--motif", action="append", default=[])
    b.add_argument("--bg-fasta")
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--standard", action="store_true", help="a folder for each set, the test set with the next seed")

    i = sub.add_parser("inspect", help="what a checkpoint holds")
    i.add_argument("checkpoint")
    i.add_argument("-out", help="write the best particle's motifs")
    return p


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return fasta.read_fasta(spark, path).cache()


def _export(best: sampler.Particle, path: str, form: str, evidence: float, notes: dict) -> None:
    motifs = [(f"motif{i}", perturb(m.flat())) for i, m in enumerate(best.motifs)]
    notes |= {f"motif{i}": m.consensus() for i, m in enumerate(best.motifs)}
    motif_files.write(motifs, path, form, **({"evidence": evidence, "notes": notes} if form == "xms" else {}))


def mix(spark: SparkSession, a: argparse.Namespace) -> mixture.MixtureSearch:
    seqs = [r["seq"] for r in _corpus(spark, a.seqs).select("seq").orderBy("seq_id").collect()]
    search = mixture.MixtureSearch(seqs, a.numMotifs, a.motifLength, a.ensembleSize, a.seed)
    for _ in range(a.maxCycles):
        search.step()
    motif_files.write([(f"motif{i}", np.exp2(m)) for i, m in enumerate(search.best.motifs)], a.out, "legacy")
    return search


def find(spark: SparkSession, a: argparse.Namespace) -> sampler.Search:
    seqs = _corpus(spark, a.seqs)
    if a.restart:
        search = sampler.Search.restore(seqs, a.restart)
    else:
        config = GapConfig(True, a.minGapLength, a.maxGapLength, a.maxNumGaps, a.gapPrior, a.gapParam) if a.allowGaps else None
        seeds = C.seed_kmers(seqs, a.numMotifs, a.motifLength) if a.kmerSeeds else []
        search = sampler.Search(seqs, a.numMotifs, a.motifLength, a.ensembleSize, not a.singleStrand, a.bgOrder, a.adaptiveMCMC, seeds, config, a.seed, a.deaths, a.threads)
    mode, stop = ("iqr", a.stopIqr) if a.convergenceMode == "iqr" else ("remaining", a.stopH)
    search.run(a.maxCycles, mode, stop, a.checkpointInterval, a.checkpoint, grace=GRACE)
    _export(search.best, a.out, a.format, search.log2_evidence, {"cycles": search.cycle})
    return search


def discover(spark: SparkSession, a: argparse.Namespace) -> list[tuple[int, float]]:
    seqs = _corpus(spark, a.seqs)
    options = {"length": a.startLength, "bg_order": a.bgOrder, "seed": a.seed, "adaptive": a.adaptiveMCMC, "deaths": a.deaths, "threads": a.threads}
    if a.ensembleSize:
        options["ensemble"] = a.ensembleSize
    best, seen = sampler.discover(seqs, a.minMotifs, a.maxMotifs, a.bayesThreshold, a.maxCycles, a.stopIqr, **options)
    if best is None:
        raise SystemExit("no number of motifs to try")
    _export(best.best, a.out, "xms", best.log2_evidence, {"motifs": best.n_motifs, "log2 evidence by number": seen})
    return seen


def _data(spark: SparkSession, a: argparse.Namespace) -> synth.Dataset:
    if a.preset:
        return replace(synth.PRESETS[a.preset], seed=a.seed)
    background: synth.Markov | synth.ShuffledCorpus = synth.Markov.uniform(a.gc, a.bg_order)
    if a.bg_matrix:
        background = synth.Markov.of_rows([[float(x) for x in line.split()] for line in spark.read.text(a.bg_matrix, wholetext=True).first()[0].splitlines() if line.strip()])
    elif a.learn_bg_from:
        seqs = _corpus(spark, a.learn_bg_from)
        background = synth.ShuffledCorpus(seqs, a.seed) if a.bg_method == "shuffle" else synth.Markov.learned(seqs, a.bg_order)
    motifs = synth.patterns(a.motif)
    if a.motif_file:
        motifs += [GappedPattern([m], [], n) for n, m in motif_files.read_meme(spark, a.motif_file)]
    lengths = synth.Lengths("normal", a.length, a.length_std, a.length_min, a.length_max) if a.length_std else synth.Lengths("fixed", a.length)
    kind, spread = ("centre", 0.1) if a.planting == "center" else (a.planting, 0.2)
    return synth.Dataset(a.n, lengths, background, motifs, synth.Planting(kind, a.density, a.occurrences, a.strand_bias, spread=spread), a.seed)


def generate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    data = _data(spark, a)
    made = data.generate(spark)
    fasta.write_fasta(made, a.output)
    if a.truth:
        motif_files.write_text(a.truth, data.truth(made))
    return made


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    background = synth.Markov.learned(_corpus(spark, a.bg_fasta)) if a.bg_fasta else synth.Markov.uniform()
    data = synth.Dataset(background=background, motifs=synth.patterns(a.motif), seed=a.seed)
    if a.standard:
        return synth.standard_suite(data, spark, a.output, a.train, a.test)
    for name, part in synth.splits(data, a.train, a.test).items():
        made = part.generate(spark)
        fasta.write_fasta(made, f"{a.output}/{name}")
        motif_files.write_text(f"{a.output}/{name}_truth.json", part.truth(made))


def inspect(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = sampler.inspect(spark, a.checkpoint)
    if a.out:
        best = max(sampler.load(spark, a.checkpoint)[1], key=lambda p: p.log2_lik)
        _export(best, a.out, "xms", found["log2_evidence"], {})
    return found


def plot(values: list[float], height: int = 10, width: int = 50) -> str:
    """The last ``width`` values as rows of text between their largest and least; nothing for no values."""
    values = [v for v in values if math.isfinite(v)][-width:]
    if not values:
        return ""
    low, high = min(values), max(values)
    span = (high - low) or 1.0
    at = [round((v - low) / span * (height - 1)) for v in values]
    rows = ["".join("*" if a == r else " " for a in at) for r in range(height - 1, -1, -1)]
    return "\n".join([f"{high:.2f}", *rows, f"{low:.2f}"])


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    out = {"find": find, "discover": discover, "mixture": mix, "generate": generate, "benchmark": benchmark, "inspect": inspect}[a.command](spark, a)
    if isinstance(out, sampler.Search):
        print(plot(out.dead))
        print(f"cycles {out.cycle}, log2 evidence {out.log2_evidence:.2f}, best {out.best.log2_lik:.2f}, remaining {out.remaining():.2f}, iqr {out.iqr():.2f}")
    elif isinstance(out, mixture.MixtureSearch):
        print(f"best {out.best.total:.2f} of {len(out.particles)}, written to {a.out}")
    elif out is not None and not isinstance(out, DataFrame):
        print(out)


if __name__ == "__main__":
    main()
