"""What the corpus operators share: table readers, scratch tables in the shared folder, and files on any store."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from typing import Generic, TypeVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.plans.store import drop, saved, shared_folder

__all__ = ["HOT", "Recent", "SPACE", "WORD", "chunks", "drop", "filesystem", "joined", "put_bytes", "rare_collections", "saved", "scratch", "shared_folder", "table", "thinned", "tidy"]

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


V = TypeVar("V")


def rare_collections() -> None:
    """Let a worker look for cycles rarely, where loops make very many small objects and no cycles."""
    gc.freeze()
    gc.set_threshold(300_000, 50, 100)



class Recent(Generic[V]):
    """What was used last, by text, in two halves of bounded bytes; when the new half is full, the old one goes."""

    def __init__(self, limit: int):
        self.half = limit // 2
        self.new: dict[str, V] = {}
        self.old: dict[str, V] = {}
        self.used = 0

    def room(self) -> dict[str, V]:
        """The new half, to be asked for before each batch; a batch may fill it beyond its bytes by its own."""
        if self.used > self.half:
            self.old, self.new, self.used = self.new, {}, 0
        return self.new


#: Rows of a batch that goes to a worker, where Spark's own number is unchanged: rows of texts are long.
BATCH_ROWS = "2000"


def tidy(run):
    """A function over batches that gives freed memory back at the end of its task, as workers live on and share what an
    executor leaves to them; asks for smaller batches, too."""
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library knows it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def chunks(texts, limit: int = 1 << 20):
    """Slices of a text column of about so many characters as lists, nulls as empty texts; a long text ends its slice."""
    out, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/quillweave/{name}-{uuid.uuid4().hex}"


def thinned(df: DataFrame, key: Column, n: int, sample: int) -> DataFrame:
    """About a tenth more than sample of n rows, by a hash of key: a fixed choice, and few rows from each task.

    (A sorted limit would send so many rows from every task.)
    """
    share = min(1.0, (1.1 * sample + 100) / max(n, 1))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))


#: Keys that hold more than one row in so many are fewer than that, which bounds what is sent to all tasks.
HOT = 1000


def joined(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """rows with the facts of their key. facts: one row per key, with the number n of rows that have it, of total rows.

    Facts of keys with over total / HOT rows, HOT at most, are sent to all tasks, so that such rows stay where they are;
    the others are joined by shuffle, no key having more than its share. Rows without a key have no facts and stay where
    they are, too. rows and facts should be stored tables.
    """
    limit = total // HOT
    many = F.broadcast(facts.where(F.col(n) > limit).drop(n))  # fewer than HOT rows
    some = rows.where(F.col(key).isNotNull())
    few = some.join(many.select(key), key, "left_anti").join(facts.where(F.col(n) <= limit).drop(n), key, how)
    out = few.unionByName(some.join(many, key).select(few.columns))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI or local path, and the path in it; works on executors as on the driver."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_bytes(uri: str, parts) -> int:
    """Write a file; its name must be that of one attempt, so that no other attempt or reader meets it half written."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with fs.open_output_stream(path, compression=None) as out:
        for x in parts:
            out.write(x)
            n += len(x)
    return n
