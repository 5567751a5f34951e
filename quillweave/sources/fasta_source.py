"""FASTA as a data source: spark.read.format("sequences").load(path), in byte ranges of any size.

A record starts at the first > of a line. Each range gives the records that start in it and reads on past its end until
the last of them ends; whether a > is the first of its line is found by looking back to the line's start. Files are opened
by pyarrow.fs, on the driver only to list them and their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, unless the option rangeBytes says otherwise, and bytes read at once.
RANGE, CHUNK = 64 << 20, 1 << 20


class Range(InputPartition):
    """The records of a file that start at lo or after, and before hi."""

    def __init__(self, file: str, lo: int, hi: int):
        super().__init__((file, lo, hi))
        self.file, self.lo, self.hi = file, lo, hi


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files_of(path: str) -> list[tuple[str, int]]:
    """The file, or the files of a folder in order of their names, with their sizes; names that start with _ or . are
    passed over, as Spark does."""
    import pyarrow.fs as pafs

    store, inner = _open(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in store.get_file_info(pafs.FileSelector(inner)) if x.is_file and x.base_name[:1] not in "_."]
    return sorted((head + x.path, x.size) for x in found)


def _line_start(f, at: int, chunk: int = CHUNK) -> int:
    """Where the line that holds the byte at begins."""
    while at > 0:
        lo = max(0, at - chunk)
        f.seek(lo)
        block = f.read(at - lo)
        end = max(block.rfind(b"\n"), block.rfind(b"\r"))
        if end >= 0:
            return lo + end + 1
        at = lo
    return 0


def _lines(f, at: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Lines from a line's start on, with their places, without their ends; a line end of two bytes gives an empty line more."""
    f.seek(at)
    rest = b""
    while block := f.read(chunk):
        *whole, rest = (rest + block).replace(b"\r", b"\n").split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def records(f, lo: int, hi: int, chunk: int = CHUNK) -> Iterator[tuple[int, str, str]]:
    """start, header and data (lines joined) of the records that start from lo to before hi."""
    start, header, data = None, b"", []
    for at, line in _lines(f, _line_start(f, lo, chunk), chunk):
        mark = line.find(b">")
        before = line if mark < 0 else line[:mark]
        if start is not None and before:
            data.append(before)
        if mark < 0:
            if start is None and at >= hi:
                return
            continue
        if start is not None:
            yield start, header.decode("latin-1"), b"".join(data).decode("latin-1")
            start = None
        if at + mark >= hi:
            return
        if at + mark >= lo:
            start, header, data = at + mark, line[mark + 1 :], []
    if start is not None:
        yield start, header.decode("latin-1"), b"".join(data).decode("latin-1")


class SequenceSource(DataSource):
    """Columns: file, start (its byte), header and data (as they stand, lines joined). Options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "file string, start long, header string, data string"

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(dict(self.options))


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE)))
        if self.size < 1:
            raise ValueError("rangeBytes is 1 or more")

    def partitions(self) -> list[Range]:
        return [Range(file, lo, min(lo + self.size, size)) for file, size in files_of(self.path) for lo in range(0, size, self.size)]

    def read(self, partition: Range):
        store, inner = _open(partition.file)
        with store.open_input_file(inner) as f:
            for record in records(f, partition.lo, partition.hi):
                yield (partition.file, *record)


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of a FASTA file or folder, with of: their place, by which they are in order."""
    spark.dataSource.register(SequenceSource)
    df = spark.read.format("sequences").option("rangeBytes", range_bytes).load(path)
    return df.withColumn("of", F.struct("file", "start"))
