"""The greedy similarity filter: a sequence goes if an earlier one that stays is too similar.

The set is decided block by block in its own order. What is too similar to a sequence that already stays goes first, by
the segment index between those that stay and the block; what is left of the block is decided by itself. So similar
sequences are only ever compared with those that stay, and links are stored for one block at a time. Equal sequences are
one, the first. The first block is the whole set, so one without many similar sequences is entered in the index once; a block
with many pairs in its buckets is cut down, at last until a task can decide it alone, letters at hand and no links stored.
Blocks after that grow twofold, so that their number follows the logarithm of the set's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.operators.copies import by_distinct
from quillweave.operators.identity import first_apart, identity_shares, paired_identity, positional_identity
from quillweave.operators.pairs import block_pairs
from quillweave.operators.segment_index import SegmentIndex
from quillweave.operators.sequences import at_least_two, renumber
from quillweave.plans.store import Scope

__all__ = ["edges", "greedy_filter", "identity_shares", "paired_identity", "positional_identity", "removed", "similar_pairs"]

#: Sequences of a block that one task decides, and the letters that it may hold for that.
ALONE, LETTERS = 4096, 1 << 27
#: Pairs in the buckets of a block, for each of its sequences, beyond which it is cut down; no more links are stored at once.
#: Most are compared by blocks or are one pair in many buckets, and every further block enters those that stay anew.
PAIRS_EACH = 512
#: Links that one task decides; rounds over more of them before they are taken in parts of that size.
LINKS, ROUNDS = 1 << 20, 6


def edges(seqs: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """i < j of all pairs whose share is at least the threshold; pairs are made and dropped block by block, those of copies
    are not compared again, unless a block is asked for."""
    limit = np.float32(threshold)

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        share = identity_shares(left["seq"].tolist(), right["seq"].tolist())
        i, j = left["ord"].to_numpy(), right["ord"].to_numpy()
        a, b = np.nonzero((share >= limit) & (i[:, None] < j))
        return pd.DataFrame({"i": i[a], "j": j[b]})

    by_blocks = lambda of: block_pairs(of, near, "i int, j int", block)
    return by_blocks(seqs) if block else by_distinct(seqs, by_blocks, lambda same: same.where(F.lit(bool(limit <= 1))).select("i", "j"))


def similar_pairs(seqs: DataFrame, threshold: float) -> DataFrame:
    """The same pairs by the segment index, which compares few others where the threshold is high; of equal sequences only
    the first, so that copies are not expanded into pairs."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share, above 0")
    with Scope(seqs.sparkSession) as scope:
        once = scope.saved(distinct(seqs), "distinct")
        return scope.kept(SegmentIndex(threshold, scope).similar(once), "similar-pairs")


def distinct(seqs: DataFrame) -> DataFrame:
    """ord and seq of the first of equal sequences."""
    return seqs.groupBy("seq").agg(F.min("ord").alias("ord")).select("ord", "seq")


def greedy_filter(seqs: DataFrame, threshold: float) -> DataFrame:
    """The sequences that stay, numbered anew; a threshold of 0 or less keeps all. Equal to going through them in order."""
    if threshold > 1:
        raise ValueError("the threshold is a share, from 0 to 1")
    if threshold <= 0:
        return seqs
    with Scope(seqs.sparkSession) as scope:
        return at_least_two(renumber(seqs.join(staying(seqs, threshold, scope), "ord", "left_semi")))


def staying(seqs: DataFrame, threshold: float, scope: Scope) -> DataFrame:
    """ord of the sequences that stay."""
    index = SegmentIndex(threshold, scope)
    # a copy goes whatever becomes of the first: with it stays what it is too similar to, or it goes with what sent the first away
    once = scope.saved(distinct(seqs), "distinct")
    facts = once.agg(F.max("ord").alias("last"), F.max(F.length("seq")).alias("longest")).first()
    end = 0 if facts["last"] is None else facts["last"] + 1
    alone = max(1, min(ALONE, LETTERS // max(1, facts["longest"] or 1)))
    stay, at, size = once.limit(0), 0, max(alone, end)
    while at < end:
        block = once  # as long as it is the whole set, it is not written again
        if at or size < end:
            block = once.where((F.col("ord") >= at) & (F.col("ord") < at + size))
            if at:
                block = block.join(index.similar(stay, block).select(F.col("j").alias("ord")).distinct(), "ord", "left_anti")
            block = scope.saved(block, "block")
        n = block.count()
        entered, pairs = (None, 0) if n <= alone else index.enter(block)
        while pairs > PAIRS_EACH * n and size > alone:
            size = max(alone, size // 4)
            block = scope.saved(block.where(F.col("ord") < at + size), "block", *[x for x in (block, entered) if x is not once])
            n = block.count()
            entered, pairs = (None, 0) if n <= alone else index.enter(block)
        if n <= alone:
            found = _alone(block, threshold)
        else:
            links = scope.saved(index.similar(block, entered=entered), "links", entered)
            found = block.join(_lost(links, scope), "ord", "left_anti")
        needed = ["ord", "seq"] if at + size < end else ["ord"]
        stay = scope.saved(stay.select(needed).union(found.select(needed)), "staying", stay, *[x for x in (block,) if x is not once])
        scope.drop_others(once, stay)
        at, size = at + size, 2 * size
    return stay.select("ord")


def _alone(block: DataFrame, threshold: float) -> DataFrame:
    """What stays of a block of bounded size, decided in one task."""

    def decide(batches):
        whole = pd.concat(list(batches)).sort_values("ord")
        yield whole[first_apart(whole["seq"].tolist(), threshold)] if len(whole) else whole

    return block.repartition(1).mapInPandas(decide, "ord int, seq string") if block.count() else block


def _lost(links: DataFrame, scope: Scope) -> DataFrame:
    """ord of those that links (i < j of all similar pairs of a block) send away.

    In a round, those without an earlier neighbour stay and their neighbours go. Links that are few enough, or are left
    after some rounds, are taken in order of j by one task after the other, so that long chains take no more rounds.
    """
    lost, rounds = links.select(F.col("j").alias("ord")).limit(0), 0
    while n := links.count():
        if n > LINKS and rounds < ROUNDS:
            waiting = links.select(F.col("j").alias("n")).distinct()
            stay = links.select(F.col("i").alias("n")).distinct().join(waiting, "n", "left_anti")
            gone = scope.saved(links.join(stay, links["i"] == stay["n"], "left_semi").select(F.col("j").alias("n")).distinct(), "lost")
            decided = gone.union(stay)
            rest = links.join(decided, links["i"] == decided["n"], "left_anti").join(gone, links["j"] == gone["n"], "left_anti")
            rounds += 1
        else:
            cut = links.agg(F.max("j") if n <= LINKS else F.percentile_approx("j", LINKS / n, 100_000)).first()[0]
            gone = scope.saved(links.where(F.col("j") <= cut).repartition(1).mapInPandas(_in_order, "n int"), "lost")
            later = links.where(F.col("j") > cut).join(gone, F.col("i") == F.col("n"), "left_anti")
            more = later.where(F.col("i") <= cut).select(F.col("j").alias("n")).distinct()  # by those up to the cut that stay
            gone = scope.saved(gone.union(more), "lost")
            rest = later.where(F.col("i") > cut).join(gone, F.col("i") == F.col("n"), "left_anti").join(gone, F.col("j") == F.col("n"), "left_anti")
        lost = lost.union(gone.select(F.col("n").alias("ord")))
        links = scope.saved(rest, "links", links)
    return lost


def _in_order(batches):
    links = pd.concat(list(batches)).sort_values("j")
    lost: set[int] = set()
    for i, j in zip(links["i"].tolist(), links["j"].tolist()):
        if i not in lost:
            lost.add(j)
    yield pd.DataFrame({"n": sorted(lost)}, dtype="int32")


def removed(before: DataFrame, after: DataFrame) -> str:
    return f"Filtered out {before.count() - after.count()} sequences"
