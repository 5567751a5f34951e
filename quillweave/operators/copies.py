"""Pairs of a set with many copies: what is said of two sequences is found once for the distinct ones, then told of their copies.

Equal sequences are numbered next to each other and their ordinals kept as lists of CHUNK at most. A result of two distinct
sequences meets the lists of both; only two numbers for two lists are shuffled, as all lists (a number for each row of the
set, where the results are quadratic in these) are sent to all tasks, and pairs of ordinals first appear where they leave
the task. A result of two equal sequences is found by itself. A list holds a bounded part of a sequence's copies, so one
that is very frequent is dealt over many rows, too.

Where fewer than half of the rows are copies, a set is better compared row by row (worth_it): its lists would hold one
ordinal each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.operators.pairs import MAX_TASKS
from quillweave.operators.sequences import renumber
from quillweave.plans.store import saved

#: Ordinals of a list, and pairs of ordinals that a task makes. Spark keeps all rows that a row's explode() makes in memory
#: until the last of them is made, here CHUNK * CHUNK, so that longer lists cost garbage collection (1,024: twice the time).
CHUNK, EACH = 192, 1 << 22
#: Chunks that meet a list in one task: what is stored of the task's pairs then has few different j, and takes fewer bytes.
TOGETHER = 128


def worth_it(seqs: DataFrame) -> bool:
    """Whether at least half of the rows are copies."""
    n = seqs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("seq").alias("different")).first()
    return n["rows"] >= 2 * n["different"] > 0


class Copies:
    """once: ord, seq and copies (their number) of the distinct sequences, in order of their letters; lists: of, chunk and
    members (the ordinals of a part of its copies, ascending)."""

    def __init__(self, seqs: DataFrame):
        whole = seqs.select("seq", F.col("ord").alias("member"), F.struct("seq", "ord").alias("_by"))
        lists = renumber(whole, "_by").groupBy("seq", F.floor(F.col("ord") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("member")).alias("members"))
        lists = saved(lists, "copies")
        self.rows = lists.agg(F.coalesce(F.sum(F.size("members")), F.lit(0))).first()[0]
        counted = lists.groupBy("seq").agg(F.sum(F.size("members")).alias("copies"))
        self.once = saved(renumber(counted.withColumn("_seq", F.col("seq")), "_seq"), "distinct")
        self.lists = saved(lists.join(self.once, "seq").select(F.col("ord").alias("of"), "chunk", "members"), "lists", lists)

    def pairs(self, found: DataFrame, both: bool = False) -> DataFrame:
        """i < j and the further columns of found for all copies; found: i <= j of the distinct sequences, where i = j says
        what holds of the copies of one sequence. both: each pair turned around, too, next to it."""
        more = [c for c in found.columns if c not in ("i", "j")]
        at = F.shiftleft(F.col("of").cast("long"), 32).bitwiseOR(F.col("chunk"))
        ends = self.lists.select("of", at.alias("at"), F.element_at("members", 1).alias("start"), F.element_at("members", -1).alias("end"))
        a, b = (F.broadcast(ends.select(F.col("of").alias(x), F.struct("end", "at", "start").alias(f"of_{x}"))) for x in ("i", "j"))
        rows = found.join(a, "i").join(b, "j").where("i <> j or of_i.at <= of_j.at")
        rows = rows.select(*more, F.least("of_i", "of_j").alias("low"), F.greatest("of_i", "of_j").alias("high"))
        mingled = (F.col("low.at") != F.col("high.at")) & (F.col("high.start") < F.col("low.end"))
        rows = rows.select(*more, F.col("low.at").alias("low"), F.col("high.at").alias("high"), mingled.alias("mingled"))
        tasks = max(found.sparkSession.sparkContext.defaultParallelism, min(self.rows**2 // 2 // EACH, MAX_TASKS))
        rows = rows.repartition(tasks, "high", F.floor(F.col("low").bitwiseAND(F.lit(2**32 - 1)) / TOGETHER)).sortWithinPartitions("mingled", "high")
        for x in ("low", "high"):
            rows = rows.join(F.broadcast(self.lists.select(at.alias(x), F.col("members").alias(f"of_{x}"))), x)
        # where two lists are mingled, ordinals of high that come before some of low are i in a second pass
        there, back = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("of_low", "of_high"), ("of_high", "of_low")))
        twice = (F.col("low") != F.col("high")) if both else F.col("mingled")
        rows = rows.select(*more, F.explode(F.when(twice, F.array(there, back)).otherwise(F.array(there))).alias("way"))
        rows = rows.select(*more, "way.y", F.explode("way.x").alias("i"))
        return rows.select("i", *more, F.explode("y").alias("j")).where("i <> j" if both else "i < j").select("i", "j", *more)


def by_distinct(seqs: DataFrame, pairs: Callable[[DataFrame], DataFrame], alone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What pairs makes of all i < j of a set, by way of the distinct sequences if that is worth it. pairs must not depend on
    which of two sequences comes first; alone: the same of rows i, j, seq_i and seq_j whose sequences are equal."""
    if not worth_it(seqs):
        return pairs(seqs)
    copies = Copies(seqs)
    return copies.pairs(found_once(copies, pairs, alone))


def found_once(copies: Copies, pairs: Callable[[DataFrame], DataFrame], alone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """i <= j of the distinct sequences; i = j where a sequence has copies."""
    with_itself = copies.once.where("copies > 1").select(F.col("ord").alias("i"), F.col("ord").alias("j"), F.col("seq").alias("seq_i"), F.col("seq").alias("seq_j"))
    between, of_copies = pairs(copies.once.select("ord", "seq")), alone(with_itself)
    return saved(between.union(of_copies.select(between.columns)), "found")
