"""Pairs of sequences: the theta join, the numbering of pairs, and pairs by blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tasks of a stage over blocks, at most; beyond it a task takes several tiles, one after the other.
MAX_TASKS = 20_000
#: Pairs that a task numbers, and ordinals of a square of them, either way.
NUMBERS, SIDE = 1 << 24, 192


def all_pairs(seqs: DataFrame) -> DataFrame:
    """i < j with both sequences, by numbering the pairs: even tasks, and two joins on equal keys."""
    n = seqs.count()
    ids = seqs.sparkSession.range(n * (n - 1) // 2).withColumnRenamed("id", "pair_id")
    return by_number(ids, seqs)


def numbered_pairs(seqs: DataFrame) -> DataFrame:
    """pair_id, i and j of all i < j without their sequences: ordinals are dense, so that these follow from numbers alone and
    nothing is joined or shuffled. Pairs come in squares of SIDE ordinals either way: consecutive rows then repeat few i, in
    turn, and stored rows take fewer bytes."""
    n = seqs.count()
    side = -(-n // SIDE)
    spark = seqs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, min(n * (n - 1) // 2 // NUMBERS, MAX_TASKS))
    squares = spark.range(0, side * (side + 1) // 2, 1, tasks).select("id", (larger(F.col("id")) - 1).alias("_j"))
    squares = squares.select("_j", (F.col("id") - _first(F.col("_j") + 1)).alias("_i"))
    upto = lambda first, end: F.sequence(first.cast("int"), (end - 1).cast("int"))
    rows = squares.select(F.col("_i"), F.explode(upto(F.col("_j") * SIDE, F.least(F.lit(n), (F.col("_j") + 1) * SIDE))).alias("j")).where(F.col("j") > F.col("_i") * SIDE)
    rows = rows.select(F.explode(upto(F.col("_i") * SIDE, F.least("j", (F.col("_i") + 1) * SIDE))).alias("i"), "j")
    return rows.select(pair_number(F.col("i"), F.col("j")).alias("pair_id"), "i", "j")


def by_number(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    j = larger(F.col("pair_id"))
    ids = ids.withColumn("j", j).withColumn("i", F.col("pair_id") - _first(F.col("j")))
    left = seqs.select(F.col("ord").cast("long").alias("i"), F.col("seq").alias("seq_i"))
    right = seqs.select(F.col("ord").cast("long").alias("j"), F.col("seq").alias("seq_j"))
    out = ids.join(left, "i").join(right, "j")
    return out.select("pair_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "seq_i", "seq_j")


def pair_number(i: Column, j: Column) -> Column:
    """The place of (i, j), i < j, in the packed lower triangle."""
    j = j.cast("long")
    return _first(j) + i


def larger(pair_id: Column) -> Column:
    """j of a pair number; the root is corrected by one either way, so that rounding cannot matter."""
    guess = F.floor((1 + F.sqrt(1 + 8 * pair_id.cast("double"))) / 2).cast("long")
    return F.when(_first(guess) > pair_id, guess - 1).when(_first(guess + 1) <= pair_id, guess + 1).otherwise(guess)


def _first(j: Column) -> Column:
    """The number of the pair (0, j), in whole numbers."""
    return F.shiftright(j * (j - 1), 1)


def pair_count(n: Column) -> Column:
    return _first(n.cast("long"))


def block_of(n: int, cores: int, most: int = 512) -> int:
    """Sequences of a block: so few that every core has some four tiles, so many that each is sent to few of them."""
    blocks = math.ceil(math.sqrt(8 * cores))
    return max(1, min(most, math.ceil(n / blocks)))


def tiles(seqs: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """ord, seq, their own block mine, and the tile (lo, hi) they are sent to, for every two blocks of so many consecutive
    sequences and each with itself; and a number of tasks for them."""
    spark = seqs.sparkSession
    n = seqs.agg(F.max("ord")).first()[0]
    n = 0 if n is None else n + 1
    block = block or block_of(n, spark.sparkContext.defaultParallelism)
    blocks = -(-n // block)
    mine = F.floor(F.col("ord") / block).cast("int")
    sent = seqs.select("ord", "seq", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("other"))
    sent = sent.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    return sent, max(1, min(blocks * (blocks + 1), MAX_TASKS))


def block_pairs(seqs: DataFrame, of_blocks: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int | None = None) -> DataFrame:
    """What of_blocks makes of every two blocks (and of each with itself) of so many consecutive sequences.

    Each sequence is sent once for every block that its own meets; a task holds two blocks, whatever the number of
    sequences. of_blocks gets ord and seq of both and must itself drop pairs that are not i < j. The number of tasks is
    set here, as adaptive execution joins small tasks by their bytes, which say little about the work of pairs.
    """
    sent, tasks = tiles(seqs, block)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left = pdf[pdf["mine"] == lo].sort_values("ord")
        right = pdf[pdf["mine"] == hi].sort_values("ord")
        return of_blocks(left[["ord", "seq"]].drop_duplicates("ord"), right[["ord", "seq"]].drop_duplicates("ord"))

    return sent.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInPandas(tile, schema)


def identified_pairs(seqs: DataFrame, share: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """i, j and identity of all pairs i < j, block by block; share gives all shares of two lists."""

    def of_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        i, j = left["ord"].to_numpy(), right["ord"].to_numpy()
        a, b = np.nonzero(i[:, None] < j)
        return pd.DataFrame({"i": i[a], "j": j[b], "identity": share(left["seq"].tolist(), right["seq"].tolist())[a, b]})

    return block_pairs(seqs, of_blocks, "i int, j int, identity float")
