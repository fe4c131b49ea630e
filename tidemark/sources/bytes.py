"""Data sources over files of any size: hashes, contents within a limit, and CSV cut at the bounds of records.

Files are listed once in the driver and packed into partitions of about one size; tasks
open them and never hold more than a chunk, the limit, or a chunk and one record. Paths are
those that Arrow opens: local or mounted folders and the stores it knows. Where there are no
files Spark asks for one partition, None, which has no rows.
"""

from __future__ import annotations

import csv
import hashlib
import io
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

CHUNK = 1 << 20
#: Bytes that a partition holds, unless one file has more.
PARTITION = 128 << 20
QUOTE, BREAK = 34, 10


def listed(path: str, glob: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a path by name; names that begin with a dot or an underscore are hidden."""
    store, root = fs.FileSystem.from_uri(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
    names = [(i.path, i.size) for i in found if not i.base_name.startswith((".", "_")) and fnmatch(i.base_name, glob)]
    return sorted(names)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


@dataclass
class Split(InputPartition):
    name: str
    start: int
    end: int
    #: Whether the first byte stands between quotes.
    quoted: bool


def packed(names: list[tuple[str, int]], size: int) -> list[Files]:
    """Files in their order, in parts of at most a size or of one file; each also costs one chunk for being opened."""
    parts, room = [], 0
    for name, n in names:
        if room < n + CHUNK:
            parts.append([])
            room = size
        parts[-1].append((name, n))
        room -= n + CHUNK
    return [Files(p) for p in parts]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.size = int(options.get("partitionbytes", PARTITION))
        self.limit = int(options.get("limit", 0))

    def store(self):
        return fs.FileSystem.from_uri(self.path)[0]

    def partitions(self):
        return packed(listed(self.path, self.glob), self.size)


class _Hashes(_Reader):
    def read(self, partition: Files):
        store = self.store()
        for name, _ in partition.names if partition else ():
            digest, n = hashlib.sha256(), 0
            with store.open_input_stream(name) as stream:
                while block := stream.read(CHUNK):
                    digest.update(block)
                    n += len(block)
            yield name, n, digest.hexdigest()


class FileHashes(DataSource):
    """``path, size, sha256`` of files, in chunks. Options: path, glob, partitionBytes."""

    @classmethod
    def name(cls):
        return "file_hashes"

    def schema(self):
        return "path string, size long, sha256 string"

    def reader(self, schema):
        return _Hashes(self.options)


class _Contents(_Reader):
    def read(self, partition: Files):
        store, fault = self.store(), f"file exceeds {self.limit} bytes"
        for name, size in partition.names if partition else ():
            if size > self.limit:
                yield name, size, None, fault
                continue
            with store.open_input_stream(name) as stream:
                content = stream.read(self.limit + 1)
            # a file may have grown since it was listed
            over = len(content) > self.limit
            yield name, max(size, len(content)), None if over else bytes(content), fault if over else None


class LimitedFiles(DataSource):
    """``path, size, content, error``: a file over the limit is not read, or read no further. Options: path, glob, limit, partitionBytes."""

    @classmethod
    def name(cls):
        return "limited_files"

    def schema(self):
        return "path string, size long, content binary, error string"

    def reader(self, schema):
        return _Contents(self.options)


def splits(names: list[tuple[str, int]], size: int) -> list[Split]:
    return [Split(name, at, min(at + size, n), False) for name, n in names for at in range(0, n, size)]


class _Quotes(_Reader):
    def partitions(self):
        return splits(listed(self.path, self.glob), self.size)

    def read(self, partition: Split):
        if partition is None:
            return
        n, left = 0, partition.end - partition.start
        with self.store().open_input_file(partition.name) as f:
            f.seek(partition.start)
            while left > 0 and (block := f.read(min(CHUNK, left))):
                n += block.count(b'"')
                left -= len(block)
        yield partition.name, partition.start, partition.end, n % 2 == 1


class QuoteParity(DataSource):
    """``path, start, stop, odd``: whether a split of a file holds an odd number of quotes."""

    @classmethod
    def name(cls):
        return "quote_parity"

    def schema(self):
        return "path string, start long, stop long, odd boolean"

    def reader(self, schema):
        return _Quotes(self.options)


def whole_records(block: bytes, quoted: bool) -> tuple[np.ndarray, bool]:
    """The places after the line breaks outside of quotes, and whether the block ends between quotes."""
    data = np.frombuffer(block, np.uint8)
    inside = (np.cumsum(data == QUOTE) + quoted) % 2 == 1
    return np.flatnonzero((data == BREAK) & ~inside) + 1, bool(inside[-1])


class _Records(_Reader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options)
        self.width = len(schema)
        self.fields = pa.schema([(f.name, pa.string()) for f in schema])
        self.states = options["states"]

    def partitions(self):
        odd = self.states.split()
        parts, quoted, last = [], False, None
        for s, state in zip(splits(listed(self.path, self.glob), self.size), odd, strict=True):
            quoted = quoted and s.name == last
            s.quoted, last = quoted, s.name
            quoted ^= state == "1"
            parts.append(s)
        return parts

    def records(self, part: Split):
        """Blocks of whole records that begin in the split; the header of the file is left out."""
        quoted, at, rest = part.quoted, part.start, b""
        with self.store().open_input_file(part.name) as f:
            skipping = True
            if part.start and not quoted:
                f.seek(part.start - 1)
                skipping = f.read(1) != b"\n"
            f.seek(at)
            while block := f.read(CHUNK):
                ends, quoted = whole_records(block, quoted)
                begin = 0
                if skipping:
                    if not len(ends):
                        at += len(block)
                        continue
                    begin, skipping = int(ends[0]), False
                    if at + begin >= part.end:
                        return
                # the first bound at or after the end of the split closes its last record
                over = int(np.searchsorted(ends, part.end - at))
                if over < len(ends):
                    if rest or ends[over] > begin:
                        yield rest + block[begin : ends[over]]
                    return
                cut = int(ends[-1]) if len(ends) else begin
                if cut > begin:
                    yield rest + block[begin:cut]
                    rest = b""
                rest += block[cut:]
                at += len(block)
                if not rest and at >= part.end:
                    return
            if rest:
                yield rest

    def read(self, partition: Split):
        if partition is None:
            return
        csv.field_size_limit((1 << 31) - 1)
        for block in self.records(partition):
            lines = csv.reader(io.StringIO(block.decode("utf-8", "replace"), newline=""), quoting=csv.QUOTE_NOTNULL)
            rows = [(r + [None] * self.width)[: self.width] for r in lines if r]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(self.width)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.fields)


class CsvRecords(DataSource):
    """Records of CSV files, all columns as text. Options: path, glob, partitionBytes, states (the parity of each split)."""

    @classmethod
    def name(cls):
        return "csv_records"

    def reader(self, schema):
        return _Records(self.options, schema)


def _reader(spark: SparkSession, source: type[DataSource], path: str, glob: str, size: int):
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("glob", glob).option("partitionBytes", size)


def file_hashes(spark: SparkSession, path: str, glob: str = "*", size: int = PARTITION) -> DataFrame:
    """``path, size, sha256`` of the files below a path, read in chunks."""
    return _reader(spark, FileHashes, path, glob, size).load()


def limited_files(spark: SparkSession, path: str, limit: int, glob: str = "*", size: int = PARTITION) -> DataFrame:
    """``path, size, content, error`` of the files below a path; those over the limit have no content."""
    return _reader(spark, LimitedFiles, path, glob, size).option("limit", limit).load()


def csv_records(spark: SparkSession, path: str, schema: str, glob: str = "*", size: int = PARTITION) -> DataFrame:
    """CSV files with one header each, in splits, though cells may hold line breaks.

    A first pass counts quotes in every split, so the second knows whether a split begins
    between quotes. A split gives the records that begin in it. Short rows are filled with
    nulls, a cell without quotes and text is null, and one that does not read as its type is
    null. The driver holds one bit for each split. Files must not change between the passes.
    """
    typed = StructType.fromDDL(schema)
    odd = _reader(spark, QuoteParity, path, glob, size).load().orderBy("path", "start").select("odd").collect()
    texts = StructType([StructField(f.name, StringType()) for f in typed])
    rows = _reader(spark, CsvRecords, path, glob, size).option("states", " ".join("1" if r.odd else "0" for r in odd)).schema(texts).load()
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in typed])
