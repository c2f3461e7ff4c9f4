"""FASTA as a data source of Spark: ``spark.read.format("fasta")`` and ``readStream``, after :func:`register`.

A file is cut into byte ranges, and a record belongs to the range that its first byte is in, so one
large file is read by many tasks. A record comes as pieces of at most ``pieceLetters`` letters, so that a
chromosome is never one row; ``at`` is a piece's place in its record and ``last`` marks the record's
last piece. Files are read in blocks, whatever their lines; compressed ones in one range. Paths are what
the workers can open: local or mounted ones, or those of a store that Arrow knows by its scheme.

Options: ``path`` (a file, or a folder with folders), ``rangeBytes``, ``pieceLetters``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq_id string, description string, at long, seq string, last boolean"
_FIELDS = pa.schema([("seq_id", pa.string()), ("description", pa.string()), ("at", pa.int64()), ("seq", pa.string()), ("last", pa.bool_())])
RANGE_BYTES, PIECE_LETTERS, BLOCK = 64 << 20, 1_000_000, 1 << 20
_SPACE = b" \t\r\n\x0b\x0c"
PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file; a compressed file has no end."""

    path: str
    start: int
    end: int | None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[int, str, int]]:
    """``(time, path, size)`` of the files at a path, oldest first; hidden ones and markers are left out."""
    store, at = _open(path)
    scheme = path[: len(path) - len(at)] if "://" in path and not path.startswith("file:") else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file]
    return sorted((x.mtime_ns or 0, scheme + x.path, x.size) for x in found if not x.base_name.startswith(("_", ".")))


def ranges(found: list[tuple[int, str, int]], size: int) -> list[Range]:
    out = []
    for _, path, length in found:
        if path.endswith(PACKED):
            out.append(Range(path, 0, None))
        else:
            out += [Range(path, i, min(i + size, length)) for i in range(0, length, size)]
    return out


def pieces(blocks: Iterator[bytes], upto: int | None, letters: int, begun: bool) -> Iterator[tuple[str, str, int, str, bool]]:
    """``(seq_id, description, at, seq, last)`` of the records that begin before byte ``upto`` of what ``blocks`` hold.

    A record begins with ``>`` at the start of a line, or of the file where it has ``begun``.
    White space in sequences and line ends of either kind are dropped; what comes before the
    first record is in none, nor is a record with neither header nor letters.
    """
    buffer, gone, done = b"", 0, False
    source = iter(blocks)

    def more() -> bool:
        nonlocal buffer, done
        block = next(source, b"")
        done = not block
        buffer += block
        return not done

    def find(mark: bytes, start: int = 0) -> int:
        """The place of ``mark`` in the buffer, reading on as needed; -1 at the end."""
        while (at := buffer.find(mark, start)) < 0:
            start = max(0, len(buffer) - len(mark) + 1)
            if not more():
                return -1
        return at

    more()
    at = 0 if begun and buffer.startswith(b">") else find(b"\n>") + 1
    if not (at or begun and buffer.startswith(b">")):
        return
    while True:
        if upto is not None and gone + at >= upto:
            return
        end = find(b"\n", at)
        # The line feed stays, so that a header without letters is followed by the next one.
        cut = end if end >= 0 else len(buffer)
        head = buffer[at + 1 : cut].decode("utf-8", "replace").removesuffix("\r")
        gone, buffer = gone + cut, buffer[cut:]
        name = head.split(maxsplit=1)[0] if head[:1].strip() else ""
        held, sent = bytearray(), 0
        while True:
            at = buffer.find(b"\n>")
            part = buffer[:at] if at >= 0 else buffer if done else buffer[:-1]
            held += part.translate(None, _SPACE)
            gone, buffer = gone + len(part), buffer[len(part) :]
            while len(held) > letters:
                yield name, head, sent, held[:letters].decode("latin-1"), False
                del held[:letters]
                sent += letters
            if at >= 0 or done:
                break
            more()
        if held or sent or head.strip():
            yield name, head, sent, held.decode("latin-1"), True
        if at < 0:
            return
        at = 1


def read_range(part: Range, letters: int) -> Iterator[pa.RecordBatch]:
    store, at = _open(part.path)
    # One byte more before the range shows whether its first byte begins a line.
    start = max(0, part.start - 1)
    with store.open_input_stream(at, compression="detect") if part.end is None else store.open_input_file(at) as file:
        if start:
            file.seek(start)
        blocks = iter(lambda: file.read(BLOCK), b"")
        rows, size = [], 0
        for row in pieces(blocks, None if part.end is None else part.end - start, letters, part.start == 0):
            rows.append(dict(zip(_FIELDS.names, row, strict=True)))
            size += len(row[3]) + 100
            if size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.letters = int(options.get("pieceLetters", PIECE_LETTERS))

    def partitions(self) -> list[Range]:
        return ranges(files(self.path), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.letters)


class _StreamReader(_Reader, DataSourceStreamReader):
    """New files in the order of their times, then paths; a file must not be older than those taken already."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = files(self.path)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return ranges([f for f in files(self.path) if after < f[:2] <= upto], self.size)


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fasta)


def cut(records: DataFrame, letters: int) -> DataFrame:
    """``(seq_id, at, seq)``: sequences of a table in pieces as this source gives them."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(letters))
    return records.select("seq_id", "seq", F.explode(starts).alias("i")).select(
        "seq_id", F.col("i").cast("long").alias("at"), F.substring("seq", F.col("i") + 1, F.lit(letters)).alias("seq")
    )


def with_context(rows: DataFrame, letters: int) -> DataFrame:
    """Pieces ``(seq_id, at, seq)`` with ``before``, the last ``letters`` letters of the piece before; empty for a record's first.

    By a join on a piece's place, so that a long record's pieces stay apart.
    """
    tails = rows.select(F.col("seq_id").alias("of"), (F.col("at") + F.length("seq")).alias("to"), F.expr(f"right(seq, {letters})").alias("before")).filter("before <> ''")
    joined = rows.join(tails, F.col("seq_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("to")), "left")
    return joined.select(*rows.columns, F.coalesce("before", F.lit("")).alias("before"))
