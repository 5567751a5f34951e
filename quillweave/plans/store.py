"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Where saved tables lie, oldest first.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and one machine does all, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillweave-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def saved(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """The table, written out and read again. done: tables saved before that only this one needed; they are deleted."""
    path = f"{shared_folder(df.sparkSession)}/quillweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop(*done)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _made.append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete saved tables; what still reads them becomes unusable."""
    for df in tables:
        if (path := getattr(df, "_saved_at", None)) is not None:
            _delete(df.sparkSession, path)
            if path in _made:
                _made.remove(path)


class Scope:
    """The tables that one run saves between its steps; they are deleted when it ends, but for those it hands on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def saved(self, df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
        out = saved(df, name)
        self.tables.append(out)
        self._drop(done)
        return out

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table that outlives the scope."""
        return saved(df, name)

    def drop_others(self, *needed: DataFrame) -> None:
        """Delete all tables but these."""
        self._drop([t for t in self.tables if not any(t is x for x in needed)])

    def _drop(self, tables) -> None:
        mine = [t for t in self.tables if any(t is x for x in tables)]
        drop(*mine)
        self.tables = [t for t in self.tables if not any(t is x for x in mine)]

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *error) -> None:
        self._drop(list(self.tables))


def made() -> int:
    """How many saved tables there are; to be given to release()."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables saved since, once what was made from them is written."""
    for path in _made[since:]:
        _delete(spark, path)
    del _made[since:]


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables and files that were kept between steps; DataFrames that still read them become unusable."""
    _delete(spark, f"{shared_folder(spark)}/quillweave")
    _made.clear()
