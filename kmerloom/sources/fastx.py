"""FASTA and FASTQ: a parser, readers of files and text, a Python data source, writers."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from kmerloom.errors import FastxParseError, InvalidArgumentError, SourceIOError, SourceLocation
from kmerloom.session import ship

SCHEMA = "file string, record_index bigint, header string, sequence string"
GZIP = b"\x1f\x8b"


@dataclass
class Record:
    """start: where the sequence begins in its record, in bytes; 0 unless a long record was cut."""

    header: str
    sequence: str
    start: int = 0


class _Inflated(io.RawIOBase):
    """Plain bytes of a gzip stream, member by member; a stream that is cut off or damaged ends there."""

    def __init__(self, raw):
        self.raw, self.d = raw, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while self.d is not None:
            over = self.d.eof
            data = (self.d.unused_data if over else self.d.unconsumed_tail) or self.raw.read(1 << 16)
            if not data:
                break
            if over:
                self.d = zlib.decompressobj(31)
            try:
                out = self.d.decompress(data, len(b))
            except zlib.error:
                break
            if out:
                b[: len(out)] = out
                return len(out)
        self.d = None
        return 0


def plain(raw) -> io.BufferedReader:
    """A binary stream's bytes, inflated if it begins as gzip does; a buffer of it is in memory."""
    buffered = io.BufferedReader(raw, 1 << 16)
    return io.BufferedReader(_Inflated(buffered), 1 << 16) if buffered.peek(2)[:2] == GZIP else buffered


def unzipped(data: bytes) -> bytes:
    """The plain bytes of gzip data, told by its first two bytes; a file that is cut off ends where it ends."""
    return plain(io.BytesIO(data)).read()


class _Lines:
    """Lines without their end and a CR before it, with their number."""

    def __init__(self, stream):
        self.stream, self.number, self.back = stream, 0, None

    def next(self) -> str | None:
        if self.back is not None:
            line, self.back = self.back, None
            self.number += 1
            return line
        raw = self.stream.readline()
        if not raw:
            return None
        self.number += 1
        return raw.removesuffix("\n").removesuffix("\r")

    def unread(self, line: str) -> None:
        self.back = line
        self.number -= 1


def parse(stream, name: str = "<stream>", size: int = 0, overlap: int = 0) -> Iterator[Record]:
    """Records of a text stream. The first header tells FASTA (>) from FASTQ (@); all must be of its kind.

    size: FASTA records are cut into pieces of about so many bytes, each beginning with the last `overlap` bytes of the one before; with k - 1 of
    them each window of k is in one piece.
    """
    lines, kind = _Lines(stream), ""

    def fail(message: str, line: int, column: int):
        raise FastxParseError(message, SourceLocation(name, line, column))

    while (line := lines.next()) is not None:
        if not line:
            continue
        if line[0] not in ">@":
            fail("expected FASTA or FASTQ header", lines.number, 1)
        if kind and line[0] != kind:
            fail("mixed FASTA and FASTQ records are not supported", lines.number, 1)
        kind, header, parts, start, held = line[0], line[1:], [], 0, 0
        if kind == ">":
            while (line := lines.next()) is not None:
                if line.startswith(">"):
                    lines.unread(line)
                    break
                parts.append(line)
                held += len(line)
                if size and held >= size + overlap:
                    piece = "".join(parts)
                    yield Record(header, piece, start)
                    parts, start = [piece[held - overlap :]], start + held - overlap
                    held = overlap
            if not start or held > overlap:
                yield Record(header, "".join(parts), start)
            continue
        while True:
            if (line := lines.next()) is None:
                fail("unterminated FASTQ record: missing '+' separator", max(lines.number, 1), 1)
            if line.startswith("+"):
                break
            parts.append(line)
        sequence, got, width = "".join(parts), 0, 0
        while got < len(sequence):
            if (line := lines.next()) is None:
                fail("FASTQ quality length does not match sequence length", lines.number, width + 1)
            got, width = got + len(line), len(line)
            if got > len(sequence):
                fail("FASTQ quality length exceeds sequence length", lines.number, width - (got - len(sequence)) + 1)
        yield Record(header, sequence)


def parse_stream(raw, name: str, size: int = 0, overlap: int = 0) -> Iterator[Record]:
    """Records of a binary stream, plain or gzip; no more than a record (or piece) is in memory."""
    return parse(io.TextIOWrapper(plain(raw), encoding="latin-1", newline="\n"), name, size, overlap)


def parse_bytes(data: bytes, name: str = "<bytes>") -> Iterator[Record]:
    return parse_stream(io.BytesIO(data), name)


def _text(s: str) -> str:
    """Bytes read one to a character, as UTF-8 where they are."""
    try:
        return s.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return s


def read(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Records of FASTA and FASTQ files, plain or gzip by their first bytes: file, record_index (in its file), header, sequence.

    A file is parsed by one task, as FASTQ can't be split, and may have 2 GB; the source `fastx` streams larger ones. permissive: a further column `error` has what is wrong (line, column, message) in a row
    of its own, and the file's records before it are kept.
    """
    schema = SCHEMA + (", error struct<line:int,column:int,message:string>" if permissive else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                rows, i = [], 0
                try:
                    for r in parse_bytes(data, name):
                        rows.append((name, i, _text(r.header), _text(r.sequence), *[None] * permissive))
                        i += 1
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except FastxParseError as e:
                    if not permissive:
                        raise
                    rows.append((name, i, None, None, {"line": e.location.line, "column": e.location.column, "message": e.message}))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["file", "record_index", "header", "sequence", *["error"] * permissive]
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA in parallel: large plain files are split at headers. file, block, at (their order in the file), header, sequence; as parse() reads them.

    A chunk is what stands between two line ends with `>`; only a file's first chunk still has its own `>`.
    """
    ship(spark)
    raw = spark.read.option("lineSep", "\n>").text(path)
    meta = F.col("_metadata")
    rows = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))

    def entry(chunk: str) -> tuple[str, str]:
        lines = chunk.split("\n")
        if "\r" in chunk:
            lines = [x.removesuffix("\r") for x in lines]
        return lines[0], "".join(lines[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: list[tuple] = []
            for file, block, at, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block == 0 and before != (file, block):
                    blank = re.match(r"(?:\r?\n)*\r?", chunk).end() if not chunk.startswith(">") else 0
                    if blank == len(chunk):
                        chunk = None  # lines before the first header, or an empty file
                    elif chunk[blank] != ">":
                        raise FastxParseError("expected FASTA header", SourceLocation(file, chunk.count("\n", 0, blank) + 1, 1))
                    else:
                        chunk = chunk[blank + 1 :]
                before = file, block
                if chunk is not None:
                    out.append((file, block, at, *entry(chunk)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "block", "at", "header", "sequence"])

    return rows.mapInArrow(run, "file string, block bigint, at bigint, header string, sequence string")


def indexed(records: DataFrame, *order: str) -> DataFrame:
    """record_index over all files, from 0, without sorting all records in one place: counts a file, and places in it.

    Only files (not records) are ordered in one task.
    """
    order = order or ("record_index",)
    files = records.groupBy("file").agg(F.count("*").alias("n"))
    base = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1
    out = records.withColumn("__place", place).join(base, "file")
    return out.select("file", (F.col("base") + F.col("__place")).cast("long").alias("record_index"), "header", "sequence")


def concatenated(records: DataFrame, separator: str = "N") -> DataFrame:
    """One row: all records' sequences in order, joined; windows over a separator are part of it. One text in memory, as its source asks."""
    ordered = F.array_sort(F.collect_list(F.struct("record_index", "sequence")))
    return records.agg(F.array_join(F.transform(ordered, lambda r: r["sequence"]), separator).alias("sequence"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _listed(path: str) -> list[str]:
    from pyarrow import fs as pafs

    files, top = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = files.get_file_info(top)
    if info.type == pafs.FileType.NotFound:
        raise SourceIOError(f"no such file: {path}")
    found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(top, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return sorted(scheme + i.path for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))


def _records(path: str, size: int = 0, overlap: int = 0) -> Iterator[tuple]:
    from pyarrow import fs as pafs

    files, top = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with files.open_input_stream(top, compression=None) as f:
        i = -1
        for r in parse_stream(f, path, size, overlap):
            i += not r.start
            yield path, i, _text(r.header), _text(r.sequence), *[r.start] * bool(size)


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, overlap: int):
        self.path, self.size, self.overlap = path, size, overlap

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _listed(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _records(partition.path, self.size, self.overlap)


class _StreamReader(DataSourceStreamReader):
    """An offset is the time and name of the latest file; a batch takes the files after one offset up to the next, whatever was read before a restart."""

    def __init__(self, path: str, size: int, overlap: int):
        self.path, self.size, self.overlap = path, size, overlap

    def _files(self) -> list[tuple[int, str]]:
        from pyarrow import fs as pafs

        info = lambda p: (pafs.FileSystem.from_uri(p) if "://" in p else (pafs.LocalFileSystem(), p))
        return sorted((fs.get_file_info(at).mtime_ns or 0, p) for p in _listed(self.path) for fs, at in [info(p)])

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p) for t, p in self._files() if (start["time"], start["file"]) < (t, p) <= (end["time"], end["file"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _records(partition.path, self.size, self.overlap)

    def commit(self, end: dict) -> None:
        pass


class FastxDataSource(DataSource):
    """spark.dataSource.register(FastxDataSource); spark.read.format("fastx").load(path), also readStream.

    Files of any size, plain or gzip, are streamed: a task holds a record, or with the option `size` a piece of a FASTA record of about so many
    bytes, which begins with the last `overlap` bytes of the one before; then a column `start` tells where it begins.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def _cut(self) -> tuple[int, int]:
        size, overlap = int(self.options.get("size", 0)), int(self.options.get("overlap", 0))
        if size < 0 or overlap < 0 or overlap and not size:
            raise InvalidArgumentError("size and overlap must not be negative, and overlap needs size")
        return size, overlap

    def schema(self) -> str:
        return SCHEMA + ", start bigint" * bool(self._cut()[0])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], *self._cut())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], *self._cut())


def fasta_text(records: DataFrame, header: str = "header", sequence: str = "sequence", wrap: int = 0) -> DataFrame:
    """A column `value` of FASTA entries; wrap: characters a line."""
    body = F.col(sequence)
    body = F.regexp_replace(F.regexp_replace(body, f"(.{{{wrap}}})", "$1\n"), r"\n$", "") if wrap else body
    return records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value"))


def write_fasta(records: DataFrame, path: str, header: str = "header", sequence: str = "sequence", wrap: int = 0, compression: str = "none") -> None:
    fasta_text(records, header, sequence, wrap).write.option("compression", compression).text(path)


def write_fastq(records: DataFrame, path: str, header: str = "header", sequence: str = "sequence", quality: str = "I") -> None:
    """FASTQ with one quality for all bases."""
    s = F.col(sequence)
    records.select(F.concat(F.lit("@"), F.col(header), F.lit("\n"), s, F.lit("\n+\n"), F.repeat(F.lit(quality), F.length(s))).alias("value")).write.text(path)


#: Letters of random sequences: four bases, twenty residues.
BASES, RESIDUES = "ACGT", "ACDEFGHIKLMNPQRSTVWY"


def random_sequences(spark: SparkSession, rows: int, length: int, letters: str = BASES, seed: int = 42) -> DataFrame:
    """record_index, sequence: uniform letters from a hash of row, place and seed; the same for any partitioning."""
    letter = lambda i: F.lit(letters).substr((F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    return spark.range(rows).select(F.col("id").alias("record_index"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("sequence"))


def hashed_sequences(spark: SparkSession, rows: int, seed: str = "") -> DataFrame:
    """record_index, sequence: 32 bases from the MD5 of seed and row, one for each of its hex digits, which any engine can make again."""
    digest = F.md5(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"))
    return spark.range(rows).select(F.col("id").alias("record_index"), F.translate(digest, "0123456789abcdef", BASES * 4).alias("sequence"))


def random_kmers(spark: SparkSession, rows: int, bits: int, seed: int = 42) -> DataFrame:
    """packed: uniform k-mers of so many bits."""
    x = F.xxhash64("id", F.lit(seed))
    return spark.range(rows).select((F.shiftrightunsigned(x, 64 - bits) if bits < 64 else x).alias("packed"))
