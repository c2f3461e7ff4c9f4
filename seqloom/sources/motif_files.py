"""Readers and writers of motif files.

Motifs are ``(name, matrix)`` with a (length, 4) array of probabilities. Files are small and
are read and written on the driver, through Spark's readers, so that any store it knows works.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.bases import BASES
from seqloom.functions.motifs import from_counts

Motif = tuple[str, np.ndarray]
NAMES = {"adenine": 0, "cytosine": 1, "guanine": 2, "thymine": 3}


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _floats(line: str) -> list[float]:
    out = []
    for word in line.split():
        try:
            out.append(float(word))
        except ValueError:
            break
    return out


def read_meme(spark: SparkSession, path: str) -> list[Motif]:
    """A ``MOTIF`` line opens a motif; lines that begin with four numbers are its rows."""
    out: list[tuple[str, list[list[float]]]] = []
    for line in _text(spark, path).splitlines():
        if line.startswith("MOTIF"):
            out.append(((line.split() + [""])[1], []))
        elif out and not line.startswith(("#", "letter-probability")) and len(row := _floats(line)[:4]) == 4:
            out[-1][1].append(row)
    return [(n, _normal(np.array(r))) for n, r in out if r]


def _normal(m: np.ndarray) -> np.ndarray:
    total = m.sum(axis=1, keepdims=True)
    return np.where(total > 0, m / np.where(total > 0, total, 1), 0.25)


def read_jaspar(spark: SparkSession, path: str) -> Motif:
    """One motif of counts: four rows, ``A [ 1 2 ]``, ``A 1 2`` or bare numbers."""
    name, rows = "", []
    for line in _text(spark, path).splitlines():
        if line.startswith(">"):
            name = line[1:].strip()
        elif row := _floats(re.sub(r"^\s*[ACGTacgt]\b|[\[\]]", " ", line)):
            rows.append(row)
    if len(rows) != 4:
        raise ValueError("a motif of counts has four rows")
    return name, from_counts(np.array(rows).T)


def read_xms(spark: SparkSession, path: str) -> list[Motif]:
    """Both forms: ``weightMatrix`` with rows of text, and ``weightmatrix`` with columns of named weights."""
    root = ET.fromstring(_text(spark, path))
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for m in (e for e in root.iter() if local(e).lower() == "motif"):
        name = next((e.text or "" for e in m.iter() if local(e) == "name"), m.get("name", ""))
        for w in (e for e in m.iter() if local(e).lower() == "weightmatrix"):
            columns = sorted((e for e in w if local(e) == "column"), key=lambda e: int(e.get("pos", 0)))
            if columns:
                rows = np.zeros((len(columns), 4))
                for i, c in enumerate(columns):
                    for x in c:
                        if x.get("symbol") in NAMES:
                            rows[i, NAMES[x.get("symbol")]] = float(x.text)
            else:
                rows = np.array([r for r in map(_floats, (w.text or "").splitlines()) if len(r) == 4]).reshape(-1, 4)
            out.append((name.strip(), rows))
    return out


def read_truth_text(spark: SparkSession, path: str) -> DataFrame:
    """``(motif, length, consensus)`` from lines such as ``Motif 1 (L=8): ACGTACGT``."""
    form = r"Motif\s+(\d+)\s*\(L=(\d+)\):\s*([A-Z]+)"
    lines = spark.read.text(path).filter(F.col("value").rlike(form))
    part = lambda i: F.regexp_extract("value", form, i)
    return lines.select(part(1).cast("int").alias("motif"), part(2).cast("int").alias("length"), part(3).alias("consensus"))


def legacy_xms(motifs: list[Motif], weights: list[float] | None = None) -> str:
    """The oldest form: numbered motifs with their weight in the mixture (1 if not given) and length, rows as they are."""
    out = ["<motifs>"]
    for i, (_, m) in enumerate(motifs):
        out += [f"  <motif id='{i}' weight='{1.0 if weights is None else weights[i]}'>", f"    <weightMatrix length='{len(m)}'>"]
        out += ["      " + " ".join(f"{x:.4f}" for x in r) for r in np.asarray(m, float)] + ["    </weightMatrix>", "  </motif>"]
    return "\n".join([*out, "</motifs>", ""])


def xms(motifs: list[Motif], evidence: float = 0.0, notes: dict[str, object] | None = None, weights: list[float] | None = None) -> str:
    """The simple form; matrices are normalised by position and written with four decimals, weights are 1 if not given."""
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', f'<motifset evidence="{evidence:.4f}">']
    lines += [f"  <!-- {k}: {v} -->" for k, v in (notes or {}).items()]
    for i, (name, m) in enumerate(motifs):
        weight = 1.0 if weights is None else weights[i]
        rows = "\n".join("      " + " ".join(f"{x:.4f}" for x in r) for r in _normal(m))
        lines += ["  <motif>", f"    <name>{name}</name>", f"    <weight>{weight}</weight>", f"    <weightMatrix>\n{rows}\n    </weightMatrix>", "  </motif>"]
    return "\n".join([*lines, "</motifset>", ""])


def meme(motifs: list[Motif]) -> str:
    out = ["MEME version 5", "", f"ALPHABET= {BASES}", "", "strands: + -", "", "Background letter frequencies", " ".join(f"{b} 0.25" for b in BASES), ""]
    for name, m in motifs:
        out += [f"MOTIF {name}", f"letter-probability matrix: alength= 4 w= {len(m)} nsites= 20 E= 0"]
        out += [" ".join(f"{x:.6f}" for x in r) for r in _normal(m)] + [""]
    return "\n".join(out)


def pfm(motifs: list[Motif]) -> str:
    """One line a base; columns are distributions of 100 with one decimal."""
    out = []
    for name, m in motifs:
        out += [f">{name}", *[" ".join([b, "[", *[f"{100 * x:.1f}" for x in _normal(m)[:, i]], "]"]) for i, b in enumerate(BASES)]]
    return "\n".join([*out, ""])


def transfac(motifs: list[Motif]) -> str:
    out = []
    for name, m in motifs:
        out += [f"ID {name}", "P0 A C G T", *[f"{i:02d} " + " ".join(f"{100 * x:.2f}" for x in r) for i, r in enumerate(_normal(m), 1)], "XX", "//"]
    return "\n".join([*out, ""])


FORMATS = {"xms": xms, "legacy": legacy_xms, "meme": meme, "pfm": pfm, "transfac": transfac}


def write_text(path: str, text: str) -> None:
    """A small file on any store that Spark knows; one of that name is replaced."""
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write(motifs: list[Motif], path: str, form: str = "xms", **options) -> None:
    write_text(path, FORMATS[form](motifs, **options))
