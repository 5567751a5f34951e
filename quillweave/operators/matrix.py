"""The similarity matrix from pair scores: both halves, the zero diagonal, dense rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillweave.operators.copies import Copies
from quillweave.operators.pairs import MAX_TASKS

#: Rows of the dense matrix that a task makes from one of a distinct sequence.
ROWS = 32
#: Ordinals of a piece of a row.
PIECE = 256


def long_matrix(scores: DataFrame, seqs: DataFrame) -> DataFrame:
    """i, j, score for all i and j; the diagonal is 0. Each pair is turned around in place, without a second pass."""
    both = F.array(F.struct("i", "j", "score"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("score")))
    mirrored = scores.select(F.explode(both).alias("c")).select("c.i", "c.j", "c.score")
    return mirrored.union(diagonal(seqs))


def diagonal(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.col("ord").alias("i"), F.col("ord").alias("j"), F.lit(0).alias("score"))


def dense_matrix(scores: DataFrame, seqs: DataFrame) -> DataFrame:
    """ord and scores: one row of the matrix per sequence."""
    cells = F.sort_array(F.collect_list(F.struct("j", "score")))
    rows = long_matrix(scores, seqs).groupBy("i").agg(F.transform(cells, lambda c: c["score"]).alias("scores"))
    return rows.withColumnRenamed("i", "ord")


def dense_of_copies(copies: Copies, found: DataFrame) -> DataFrame:
    """The same rows for all copies, from found (i <= j) of the distinct sequences: copies of a sequence have the same row but
    for the place of the zero. A row of the distinct ones is spread over all ordinals once, and sent to where its copies'
    rows are made; no pair of ordinals is shuffled. A task holds a row of the matrix, and which sequence each ordinal is."""
    out = _sent(copies, found, lambda which, short: F.transform(F.flatten(which), lambda k: F.get(short, k)))
    with_zero = F.concat(F.slice("row", 1, F.col("ord")), F.array(F.lit(0)), F.slice("row", F.col("ord") + 2, F.lit(copies.rows)))
    return out.select("ord", with_zero.alias("scores"))


def dense_texts_of_copies(copies: Copies, found: DataFrame) -> DataFrame:
    """The same rows as texts. The text of a distinct sequence's row is made once, in pieces of PIECE scores; a copy's own is
    put together from these, and only the piece with its zero is made anew."""
    out = _sent(copies, found, lambda which, short: F.transform(which, lambda piece: F.array_join(F.transform(piece, lambda k: F.get(short, k)), " ")))
    at, place = F.floor(F.col("ord") / PIECE).cast("int"), F.col("ord") % PIECE
    of = F.split(F.get("row", at), " ")
    anew = F.array_join(F.concat(F.slice(of, 1, place), F.array(F.lit("0")), F.slice(of, place + 2, F.lit(PIECE))), " ")
    return out.select("ord", F.array_join(F.concat(F.slice("row", 1, at), F.array(anew), F.slice("row", at + 2, F.lit(copies.rows))), " ").alias("scores"))


def short_rows(copies: Copies, found: DataFrame) -> DataFrame:
    """i and short: the scores of a distinct sequence with all distinct ones; 0 with itself where it has no copies."""
    missing = copies.once.where("copies = 1").select(F.col("ord").alias("i"), F.col("ord").alias("j"), F.lit(0).alias("score"))
    apart = found.where("i <> j").select("j", "i", "score")
    cells = found.select("i", "j", "score").union(apart).union(missing)
    return cells.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "score"))), lambda c: c["score"]).alias("short"))


def which_of(copies: Copies) -> DataFrame:
    """One row, which: the distinct sequence of each ordinal, in pieces of PIECE ordinals."""
    return which_runs(copies).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "numbers"))), lambda x: x["numbers"]).alias("which"))


def which_runs(copies: Copies) -> DataFrame:
    """first and numbers: the distinct sequence of each of PIECE ordinals from first on."""
    members = copies.lists.select("of", F.explode("members").alias("ord"))
    pieces = members.groupBy(F.floor(F.col("ord") / PIECE).alias("at")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "of"))), lambda x: x["of"]).alias("numbers"))
    return pieces.select((F.col("at") * PIECE).alias("first"), "numbers")


def _sent(copies: Copies, found: DataFrame, spread: Callable[[Column, Column], Column]) -> DataFrame:
    """ord of all copies, and row: what spread makes of which_of() and of the short row of their sequence, once for each."""
    rows = short_rows(copies, found).crossJoin(F.broadcast(which_of(copies))).select("i", spread(F.col("which"), F.col("short")).alias("row"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / ROWS)), lambda k: F.slice("members", (k * ROWS + 1).cast("int"), ROWS))
    sent = copies.lists.select(F.col("of").alias("i"), F.explode(parts).alias("part")).join(rows, "i")
    sent = sent.repartition(max(sent.sparkSession.sparkContext.defaultParallelism, min(copies.rows // ROWS, MAX_TASKS)), "i", "part")
    return sent.select(F.explode("part").alias("ord"), "row")
