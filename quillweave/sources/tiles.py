"""Pair scores as a packed triangle: spark.write.format("triangle") and spark.read.format("triangle").

The score of i < j stands at pair number j (j - 1) / 2 + i, as four bytes and nothing else, so that the files hold half of
a dense matrix and no ordinals. Consecutive numbers make a chunk, which is compressed by itself. A task writes consecutive
chunks to one file, which ends with the places of its chunks; its commit message is the file's name, first chunk and number of
chunks. The manifest is written when all tasks are done: what failed tasks or runs leave is in no manifest, and thus not
read. A row of the matrix is read through the chunks that hold it; no row of scores passes the driver.

A triangle of n sequences of which d are different may be coded (write_coded). Its files then hold, in place of the scores,
which of the distinct sequences each ordinal is (n numbers), and a row of scores with all distinct ones for each of these
(d * d numbers), in the same chunks and under the same checks. The score of (i, j) is that of which[i] in the row of
which[j]; every score is read as before, by cell, by rows or whole.

Cases: a pair that is missing, given twice or beyond the number of sequences is an error of its task, a null score too;
fewer than two sequences give a manifest without files.
"""

from __future__ import annotations

import bisect
import functools
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillweave.operators.pairs import MAX_TASKS, pair_number

#: Pairs of a chunk, and chunks that a task writes, and reads at least.
CHUNK, READ = 1 << 18, 16
#: Rows of the matrix whose pairs a task reads, in wide matrices; what is summed up by row then shuffles n / WIDTHS as much.
WIDTHS = 256
#: Chunks of a coded triangle that a task keeps, and rows that it sums up at once.
KEPT, TOTALS = 64, 1 << 16
MANIFEST = "manifest.json"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def first_of(j):
    """The number of the pair (0, j)."""
    return j * (j - 1) // 2


def pairs_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i and j of pair numbers; the root is corrected by one either way."""
    j = np.floor((1 + np.sqrt(1 + 8 * numbers.astype(np.float64))) / 2).astype(np.int64)
    j -= first_of(j) > numbers
    j += first_of(j + 1) <= numbers
    return numbers - first_of(j), j


def rows_from(first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The j of consecutive pair numbers, the first number of each among these, and how many there are."""
    j_of = lambda number: int(pairs_of(np.array([number], np.int64))[1][0])
    rows = np.arange(j_of(first), j_of(first + count - 1) + 1, dtype=np.int64)
    starts = np.maximum(first_of(rows), first)
    return rows, starts, np.diff(starts, append=first + count)


def pairs_from(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """i and j of consecutive pair numbers, j by j instead of by roots, as they fit 32 bits."""
    rows, starts, sizes = rows_from(first, count)
    before = starts - first - (starts - first_of(rows))  # places before a row's pair (0, j)
    return (np.arange(count, dtype=np.int64) - np.repeat(before, sizes)).astype(np.int32), np.repeat(rows.astype(np.int32), sizes)


@dataclass
class Part(WriterCommitMessage):
    """A file of consecutive chunks; none: the task had no pairs."""

    file: str | None
    first: int = 0
    chunks: int = 0


class TriangleSource(DataSource):
    """Columns i, j, score. Options: path; to write, n (sequences), distinct (d, where coded), chunk, level; to read, fromRow, toRow, symmetric
    and runs. May be given first, scores instead: the scores of consecutive pair numbers from first on; runs: whole rows' parts
    are read as j, first (the least i), scores."""

    @classmethod
    def name(cls) -> str:
        return "triangle"

    def schema(self) -> str:
        runs = {k.lower(): v for k, v in self.options.items()}.get("runs", "false")
        return "j int, first int, scores array<int>" if runs.lower() == "true" else "i int, j int, score int"

    def writer(self, schema, overwrite: bool) -> TriangleWriter:
        return TriangleWriter(dict(self.options), overwrite, packed="scores" in schema.names)

    def reader(self, schema) -> TriangleReader:
        return TriangleReader(dict(self.options))


class TriangleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, packed: bool = False):
        self.chunks_of = self._packed if packed else self._chunks
        self.path, self.n = options["path"].rstrip("/"), int(options["n"])
        self.chunk, self.level, self.overwrite = int(options.get("chunk", CHUNK)), int(options.get("level", 1)), overwrite
        self.distinct = int(options.get("distinct", 0))
        self.pairs = self.n + self.distinct**2 if self.distinct else first_of(self.n)
        store, path = _store(f"{self.path}/{MANIFEST}")
        if not overwrite and store.get_file_info(path).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)

    def _chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Chunks and their scores, from rows in order of chunks."""
        at, scores, seen, got = None, None, None, 0
        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a pair or score is null")
            i, j, score = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("i", "j", "score"))
            if ((i < 0) | (i >= j) | (j >= self.n)).any():
                raise ValueError(f"a pair is not 0 <= i < j < {self.n}")
            number = first_of(j.astype(np.int64)) + i
            chunk = number // self.chunk
            cuts = [0, *(np.nonzero(np.diff(chunk))[0] + 1).tolist(), len(chunk)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if chunk[lo] != at:
                    if at is not None:
                        yield self._done(at, scores, seen, got)
                    at, got = int(chunk[lo]), 0
                    scores, seen = self._empty(at)
                place = number[lo:hi] - at * self.chunk
                scores[place], seen[place] = score[lo:hi], True
                got += hi - lo
        if at is not None:
            yield self._done(at, scores, seen, got)

    def _packed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """The same from runs of scores; a run is within a chunk, those of a chunk come in any order."""
        at, scores, seen, got = None, None, None, 0
        for batch in batches:
            firsts, runs = (batch.column(batch.schema.get_field_index(x)) for x in ("first", "scores"))
            values, ends = runs.values, runs.offsets.to_numpy().tolist()
            if firsts.null_count or runs.null_count or values.null_count:
                raise ValueError("a pair or score is null")
            values = values.to_numpy()
            for number, lo, hi in zip(firsts.to_numpy().tolist(), ends, ends[1:]):
                if number < 0 or number + hi - lo > self.pairs:
                    raise ValueError(f"a pair is not 0 <= i < j < {self.n}")
                if number // self.chunk != at:
                    if at is not None:
                        yield self._done(at, scores, seen, got)
                    at, got = number // self.chunk, 0
                    scores, seen = self._empty(at)
                place = number - at * self.chunk
                if place + hi - lo > len(scores):
                    raise ValueError(f"scores from pair number {number} on are beyond chunk {at}")
                scores[place : place + hi - lo], seen[place : place + hi - lo] = values[lo:hi], True
                got += hi - lo
        if at is not None:
            yield self._done(at, scores, seen, got)

    def _empty(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        size = min(self.chunk, self.pairs - at * self.chunk)
        return np.zeros(size, "<i4"), np.zeros(size, bool)

    @staticmethod
    def _done(at: int, scores: np.ndarray, seen: np.ndarray, got: int) -> tuple[int, np.ndarray]:
        if got != len(seen) or not seen.all():
            raise ValueError(f"chunk {at}: {got} pairs, {int(seen.sum())} of them different; {len(seen)} are needed")
        return at, scores

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        file, first, ends, out = f"{uuid.uuid4().hex}.tri", None, [0], None
        store, path = _store(f"{self.path}/{file}")
        try:
            for at, scores in self.chunks_of(iterator):
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    first, out = at, store.open_output_stream(path, compression=None)
                if at != first + len(ends) - 1:
                    raise ValueError(f"chunk {at} follows chunk {first + len(ends) - 2}")
                data = zlib.compress(scores.tobytes(), self.level)
                out.write(data)
                ends.append(ends[-1] + len(data))
            if out is not None:
                out.write(np.array(ends, "<i8").tobytes())
        finally:
            if out is not None:
                out.close()
        return Part(file if out is not None else None, first or 0, len(ends) - 1)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m.first, m.chunks, m.file) for m in messages if m is not None and m.file)
        at = 0
        for first, chunks, _ in parts:
            if first != at:
                raise ValueError(f"chunk {at} is missing")
            at += chunks
        if at != -(-self.pairs // self.chunk):
            raise ValueError(f"chunk {at} is missing")
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        old = manifest(self.path)["parts"] if store.get_file_info(f"{folder}/{MANIFEST}").is_file else []
        draft = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"n": self.n, "chunk": self.chunk, "parts": parts} | ({"distinct": self.distinct} if self.distinct else {})).encode())
        store.move(draft, f"{folder}/{MANIFEST}")
        for _, _, file in old:
            store.delete_file(f"{folder}/{file}")

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and m.file:
                store, path = _store(f"{self.path}/{m.file}")
                store.delete_file(path)


def manifest(path: str) -> dict:
    store, inner = _store(f"{path.rstrip('/')}/{MANIFEST}")
    with store.open_input_stream(inner) as f:
        return json.loads(f.read())


class Chunks(InputPartition):
    """Chunks lo to before hi of a file that holds so many from first on."""

    def __init__(self, file: str, first: int, chunks: int, lo: int, hi: int):
        super().__init__((file, lo, hi))
        self.file, self.first, self.chunks, self.lo, self.hi = file, first, chunks, lo, hi


def chunk_scores(path: str, part: Chunks) -> Iterator[tuple[int, np.ndarray]]:
    """Chunk numbers and scores."""
    store, inner = _store(f"{path}/{part.file}")
    with store.open_input_file(inner) as f:
        f.seek(f.size() - 8 * (part.chunks + 1) + 8 * (part.lo - part.first))
        ends = np.frombuffer(f.read(8 * (part.hi - part.lo + 1)), "<i8").tolist()
        for k, (lo, hi) in enumerate(zip(ends, ends[1:]), part.lo):
            f.seek(lo)
            yield k, np.frombuffer(zlib.decompress(f.read(hi - lo)), "<i4")


class Coded:
    """The numbers of a coded triangle, read chunk by chunk when they are asked for; some chunks are kept."""

    def __init__(self, path: str, facts: dict):
        self.path, self.facts, self.n, self.distinct = path, facts, facts["n"], facts["distinct"]
        self.firsts = [p[0] for p in facts["parts"]]
        self._chunk = functools.lru_cache(KEPT)(self._read)

    def _read(self, at: int) -> np.ndarray:
        first, chunks, file = self.facts["parts"][bisect.bisect_right(self.firsts, at) - 1]
        return next(chunk_scores(self.path, Chunks(file, first, chunks, at, at + 1)))[1]

    def _numbers(self, lo: int, hi: int) -> np.ndarray:
        size = self.facts["chunk"]
        parts = [self._chunk(at)[max(0, lo - at * size) : hi - at * size] for at in range(lo // size, -(-hi // size))]
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    @functools.cached_property
    def which(self) -> np.ndarray:
        return self._numbers(0, self.n)

    def row(self, k: int) -> np.ndarray:
        """Scores of a distinct sequence with all of them."""
        return self._numbers(self.n + k * self.distinct, self.n + (k + 1) * self.distinct)

    def cell(self, i: int, j: int) -> int:
        a, b = (int(self._numbers(x, x + 1)[0]) for x in (i, j))
        at = self.n + b * self.distinct + a
        return int(self._numbers(at, at + 1)[0])

    def chunks(self, part: Chunks) -> Iterator[tuple[int, np.ndarray]]:
        """What chunk_scores gives of a triangle that is not coded."""
        size = self.facts["chunk"]
        for k in range(part.lo, part.hi):
            rows, starts, sizes = rows_from(k * size, min(size, first_of(self.n) - k * size))
            begins = starts - first_of(rows)
            yield k, np.concatenate([self.row(self.which[j])[self.which[i : i + m]] for j, i, m in zip(rows.tolist(), begins.tolist(), sizes.tolist())])


class TriangleReader(DataSourceReader):
    """Pairs i < j, where i or j is a row from fromRow to before toRow; symmetric: those rows of the whole matrix."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"].rstrip("/")
        self.facts = manifest(self.path)
        self.lo, self.hi = int(options.get("fromrow", 0)), min(int(options.get("torow", self.facts["n"])), self.facts["n"])
        self.symmetric = options.get("symmetric", "false").lower() == "true"
        self.runs = options.get("runs", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        parts = [(0, -(-first_of(self.facts["n"]) // self.facts["chunk"]), None)] if "distinct" in self.facts else self.facts["parts"]
        start = first_of(max(0, self.lo)) // self.facts["chunk"]  # earlier pairs have both ordinals before fromRow
        each = max(READ, WIDTHS * self.facts["n"] // self.facts["chunk"])
        out: list[list[Chunks]] = []
        room = 0
        for first, chunks, file in parts:
            lo = max(first, start)
            while lo < first + chunks:
                if not room:
                    out.append([])
                    room = each
                hi = min(lo + room, first + chunks)
                out[-1].append(Chunks(file, first, chunks, lo, hi))
                lo, room = hi, room - (hi - lo)
        return [InputPartition(x) for x in out or [[]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        inside = lambda x: (x >= self.lo) & (x < self.hi)
        of = Coded(self.path, self.facts).chunks if "distinct" in self.facts else functools.partial(chunk_scores, self.path)
        for k, scores in (x for part in partition.value for x in of(part)):
            if self.runs:
                yield self._run(k * self.facts["chunk"], scores)
                continue
            i, j = pairs_from(k * self.facts["chunk"], len(scores))
            if self.symmetric and self.lo <= 0 and self.hi >= self.facts["n"]:
                i, j, scores = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([scores, scores])
            elif self.symmetric:
                a, b = inside(i), inside(j)
                i, j, scores = np.concatenate([i[a], j[b]]), np.concatenate([j[a], i[b]]), np.concatenate([scores[a], scores[b]])
            elif self.lo > 0 or self.hi < self.facts["n"]:
                a = inside(i) | inside(j)
                i, j, scores = i[a], j[a], scores[a]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32, copy=False)) for x in (i, j, scores)], ["i", "j", "score"])


    @staticmethod
    def _run(first: int, scores: np.ndarray) -> pa.RecordBatch:
        rows, starts, _ = rows_from(first, len(scores))
        ends = np.append(starts - first, len(scores)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array((starts - first_of(rows)).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(scores))], ["j", "first", "scores"])


def write_triangle(scores: DataFrame, n: int, path: str, overwrite: bool = False, level: int = 1, chunk: int = CHUNK) -> None:
    """scores: i, j, score of all pairs of n sequences; each task takes a range of chunks, in order."""
    spark = scores.sparkSession
    spark.dataSource.register(TriangleSource)
    at = F.floor(pair_number(F.col("i"), F.col("j")) / chunk)
    tasks = _tasks(spark, -(-first_of(n) // chunk))
    rows = scores.select("i", "j", "score").repartitionByRange(tasks, at).sortWithinPartitions(at)
    out = rows.write.format("triangle").options(n=n, chunk=chunk, level=level)
    out.mode("overwrite" if overwrite else "append").save(path)


def write_triangle_runs(rows: DataFrame, n: int, path: str, scores: Column, beside: DataFrame, overwrite: bool = False, level: int = 1, chunk: int = CHUNK) -> None:
    """The same without a row for each pair. rows: j, once each, and further columns; beside: one row, for all tasks; scores:
    what they say of (i, j) for i from lo to before hi, an array. A row of the triangle is cut where chunks begin, and its
    scores are made where they are written, after the cuts were sent to their tasks."""
    spark = rows.sparkSession
    spark.dataSource.register(TriangleSource)
    tasks = _tasks(spark, -(-first_of(n) // chunk))
    j = F.col("j").cast("long")
    start, end = pair_number(F.lit(0), j), pair_number(F.lit(0), j + 1)
    cuts = rows.where("j > 0").withColumns({"_start": start, "_end": end}).withColumn("_at", F.explode(F.sequence(F.floor(F.col("_start") / chunk), F.floor((F.col("_end") - 1) / chunk))))
    cuts = cuts.withColumns({"lo": F.greatest("_start", F.col("_at") * chunk) - F.col("_start"), "hi": F.least("_end", (F.col("_at") + 1) * chunk) - F.col("_start")})
    cuts = cuts.repartitionByRange(tasks, "_at").crossJoin(F.broadcast(beside))
    runs = cuts.select((F.col("_start") + F.col("lo")).alias("first"), scores.alias("scores")).sortWithinPartitions("first")
    runs.write.format("triangle").options(n=n, chunk=chunk, level=level).mode("overwrite" if overwrite else "append").save(path)


def write_coded(which: DataFrame, rows: DataFrame, n: int, distinct: int, path: str, overwrite: bool = False, level: int = 1, chunk: int = CHUNK) -> None:
    """The same coded. which: first and numbers, the distinct sequence of each ordinal from first on; rows: k and numbers, the
    scores of a distinct sequence with all distinct ones in order, with itself those of two copies."""
    spark = which.sparkSession
    spark.dataSource.register(TriangleSource)
    tasks = _tasks(spark, -(-(n + distinct**2) // chunk))
    placed = rows.select((F.lit(n) + F.col("k").cast("long") * distinct).alias("first"), "numbers")
    runs = which.select(F.col("first").cast("long").alias("first"), "numbers").union(placed).where(F.size("numbers") > 0)
    end = F.col("first") + F.size("numbers")
    cuts = runs.withColumn("_at", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((end - 1) / chunk))))
    lo = F.greatest("first", F.col("_at") * chunk)
    some = F.slice("numbers", (lo - F.col("first") + 1).cast("int"), (F.least(end, (F.col("_at") + 1) * chunk) - lo).cast("int"))
    cuts = cuts.select("_at", lo.alias("first"), some.alias("scores")).repartitionByRange(tasks, "_at").sortWithinPartitions("first")
    out = cuts.select("first", "scores").write.format("triangle").options(n=n, distinct=distinct, chunk=chunk, level=level)
    out.mode("overwrite" if overwrite else "append").save(path)


def _tasks(spark: SparkSession, chunks: int) -> int:
    return max(1, min(chunks, max(spark.sparkContext.defaultParallelism, chunks // READ), MAX_TASKS))


def read_triangle(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, symmetric: bool = False) -> DataFrame:
    """i, j, score of the pairs, or of those with an ordinal in rows; symmetric: whole rows but for the zero diagonal."""
    spark.dataSource.register(TriangleSource)
    options = {"symmetric": str(symmetric).lower()} | ({"fromRow": rows[0], "toRow": rows[1]} if rows else {})
    return spark.read.format("triangle").options(**options).load(path)


def row_totals(spark: SparkSession, path: str) -> DataFrame:
    """ord, n, total, least and most of each row of the whole matrix, but for the diagonal: a task sums up what it reads, run by
    run, in as many numbers as the matrix has rows; these are shuffled. Copies have equal rows, so a coded triangle has these
    figures in the row of each distinct sequence and in how often each of them occurs."""
    spark.dataSource.register(TriangleSource)
    facts = manifest(path)
    size = facts["n"]
    if "distinct" in facts:
        return _totals_of_coded(spark, path.rstrip("/"), facts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        least, most = np.full(size, np.iinfo(np.int32).max, np.int32), np.full(size, np.iinfo(np.int32).min, np.int32)
        for b in batches:
            runs = b.column(2)
            values, ends = runs.values.to_numpy(), runs.offsets.to_numpy().tolist()
            for j, i, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:]):
                x, to = values[lo:hi], slice(i, i + hi - lo)
                n[j] += hi - lo
                n[to] += 1
                total[j] += x.sum(dtype=np.int64)
                total[to] += x
                least[j], most[j] = min(least[j], x.min()), max(most[j], x.max())
                np.minimum(least[to], x, out=least[to])
                np.maximum(most[to], x, out=most[to])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int32), n[at], total[at], least[at], most[at])], ["ord", "n", "total", "least", "most"])

    runs = spark.read.format("triangle").option("runs", "true").load(path)
    parts = runs.mapInArrow(sums, "ord int, n long, total long, least int, most int")
    return parts.groupBy("ord").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def _totals_of_coded(spark: SparkSession, path: str, facts: dict) -> DataFrame:
    n, distinct = facts["n"], facts["distinct"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Coded(path, facts)
        mine = np.array([k for b in batches for k in b.column(0).to_pylist()], np.int64)
        if not len(mine):
            return
        copies = np.bincount(coded.which, minlength=distinct)
        figures = np.zeros((3, distinct), np.int64)
        for k in mine.tolist():
            row, others = coded.row(k), copies > 0
            others[k] = copies[k] > 1
            if others.any():
                figures[:, k] = (row * copies).sum() - row[k], row[others].min(), row[others].max()
        of = np.zeros(distinct, bool)
        of[mine] = True
        at = np.flatnonzero(of[coded.which])
        for lo in range(0, len(at), TOTALS):
            some = at[lo : lo + TOTALS]
            total, least, most = figures[:, coded.which[some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.astype(np.int32), np.full(len(some), n - 1), total, least.astype(np.int32), most.astype(np.int32))], ["ord", "n", "total", "least", "most"])

    parts = spark.range(0, distinct, 1, max(1, min(distinct, spark.sparkContext.defaultParallelism)))
    return parts.mapInArrow(sums, "ord int, n long, total long, least int, most int")


def lookup(path: str, i: int, j: int) -> int:
    """One score, by reading one chunk."""
    facts = manifest(path)
    if not (0 <= i < facts["n"] and 0 <= j < facts["n"]):
        raise IndexError((i, j))
    if i == j:
        return 0
    if "distinct" in facts:
        return Coded(path.rstrip("/"), facts).cell(min(i, j), max(i, j))
    number = first_of(max(i, j)) + min(i, j)
    at, place = divmod(number, facts["chunk"])
    first, chunks, file = next(p for p in facts["parts"] if p[0] <= at < p[0] + p[1])
    return int(next(chunk_scores(path.rstrip("/"), Chunks(file, first, chunks, at, at + 1)))[1][place])
