"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast; beyond either bound a shuffle join takes its place.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset a temporary folder is set, which is right only
    for a local master; any other master raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="seqloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Paths of the tables that :func:`stored` wrote and that are still there.
_WRITTEN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no result needs any more; other tables are left alone."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) in _WRITTEN:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`stored` wrote; results not yet read become unreadable."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def folders_read(df: DataFrame) -> set[str]:
    """Last parts of the folders that a DataFrame's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = set()
    for i in range(leaves.size()):
        kind = leaves.apply(i).getClass().getSimpleName()
        if kind == "LogicalRelation":
            roots = leaves.apply(i).relation().location().rootPaths()
            out |= {roots.apply(j).getName() for j in range(roots.size())}
        elif kind.startswith("DataSourceV2"):
            # Where the session reads Parquet by the newer interface only the files are known.
            return out | {part for path in df.inputFiles() for part in path.split("/")}
    return out


def tidy(make: Callable[..., T]) -> Callable[..., T]:
    """Decorates what stores tables: those that its result, a DataFrame or a plain value, doesn't read are deleted on return."""

    @wraps(make)
    def run(*args, **options):
        before = set(_WRITTEN)
        out = make(*args, **options)
        needed = folders_read(out) if isinstance(out, DataFrame) else set()
        spark = out.sparkSession if isinstance(out, DataFrame) else SparkSession.active()
        for path in _WRITTEN - before:
            if path.rpartition("/")[2] not in needed:
                _delete(spark, path)
        return out

    return run


def settled(df: DataFrame, tag: str) -> DataFrame:
    """:func:`stored`, after which the stored tables that ``df`` read are deleted."""
    read = folders_read(df)
    old = [path for path in _WRITTEN if path.rpartition("/")[2] in read]
    out = stored(df, tag)
    for path in old:
        _delete(df.sparkSession, path)
    return out


@contextmanager
def arrow_bytes(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many bytes for what runs inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean(run: Callable[..., Iterator[T]]) -> Callable[..., Iterator[T]]:
    """Decorates what works on a task's batches: the Python worker, which waits for further tasks, gives unused memory back when it ends."""

    @wraps(run)
    def out(batches: Iterator) -> Iterator[T]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return out


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, else as it is.

    Strings and binaries count by their bytes, arrays, maps and structs by the bytes of their
    JSON, any other column as 16 bytes. ``df`` should be a stored table, as measuring reads it.
    """
    widths = []
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            widths.append(F.octet_length(F.col(f"`{c}`")))
        elif kind.startswith(("array", "map", "struct")):
            widths.append(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))))
    width = sum((F.coalesce(w, F.lit(0)).cast("long") for w in widths), F.lit(16 * len(df.columns)).cast("long"))
    row = df.agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return F.broadcast(df) if row["n"] <= max_rows and (row["b"] or 0) <= max_bytes else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def ascii_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case; null has none."""
    gaps = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
    spaced = F.translate(F.coalesce(text, F.lit("")), gaps + _UPPER, " " * len(gaps) + _UPPER.lower())
    return F.array_remove(F.split(spaced, " +"), "")


#: Everything that separates words: ASCII characters but letters and digits.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words of :func:`ascii_words` in the case they are written in; :func:`lower_word` of each gives the same words.

    Where words are exploded anyway this is faster, as most are pure ASCII.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def lower_word(word: Column) -> Column:
    """A-Z of a word in lower case."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
