"""Substitution scores estimated from aligned blocks: tables of the BLOSUM kind for any percentage.

A block is a set of sequences of equal length, aligned without gaps. Within a block, sequences that agree in at least so
many percent of their places are in one cluster, also by way of others, and a cluster counts as one sequence. The pairs of
letters that two clusters show at a place, weighted, give the odds of a letter for another against chance.

Links between sequences come from the segment index, one block by itself. Pairs are never listed: with W the weight of a
letter at a place and V its part in one cluster, the pairs of letters x and y between clusters weigh W(x) W(y) less the
sum of V(x) V(y) over clusters; so rows are counted per place, cluster and letter, and a block with very many sequences
is spread over its places and clusters. Only the sums over all places, one per pair of letters, reach the driver.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.functions.matrices import AMINO, STRIDE, Matrix
from quillweave.operators.segment_index import SegmentIndex
from quillweave.operators.sequences import SequenceError, renumber
from quillweave.plans.store import Scope

#: Letters that stand for one amino acid, those of AMINO before the ambiguous ones.
PLAIN = AMINO[:20]
AMBIGUOUS = {"B": "ND", "Z": "QE"}


def clusters(blocks: DataFrame, percent: float, scope: Scope) -> DataFrame:
    """block, seq, n (copies) and cluster of the distinct sequences of each block."""
    if not 0 < percent <= 100:
        raise ValueError("the percentage is above 0, and 100 at most")
    once = blocks.groupBy("block", "seq").agg(F.count(F.lit(1)).alias("n"))
    once = scope.saved(renumber(once.withColumn("of", F.struct("block", "seq")), "of").withColumn("group", F.col("block")), "block-rows")
    if not once.groupBy("block").agg((F.min(F.length("seq")) != F.max(F.length("seq"))).alias("odd")).where("odd").isEmpty():
        raise SequenceError("the sequences of a block differ in length")
    links = scope.saved(SegmentIndex(percent / 100, scope).similar(once), "block-links")
    both = scope.saved(links.select(F.col("i").alias("a"), F.col("j").alias("b")).union(links.select("j", "i")), "block-links", links)
    labels = scope.saved(once.select("ord", F.col("ord").alias("cluster")), "block-clusters")
    while True:
        near = both.join(labels, both["b"] == labels["ord"]).groupBy("a").agg(F.min("cluster").alias("least"))
        moved = labels.join(near, labels["ord"] == near["a"], "left").select("ord", F.least("cluster", "least").alias("cluster"), (F.col("least") < F.col("cluster")).alias("moved"))
        moved = scope.saved(moved, "block-clusters")
        if moved.where("moved").isEmpty():
            break
        # each takes the cluster of its cluster's first, so that chains shrink by half
        up = moved.select(F.col("ord").alias("first"), F.col("cluster").alias("further"))
        labels = scope.saved(moved.join(up, moved["cluster"] == up["first"]).select("ord", F.col("further").alias("cluster")), "block-clusters", labels, moved)
    return once.join(labels, "ord").select("block", "seq", "n", "cluster")


def pair_weights(blocks: DataFrame, percent: float, scope: Scope) -> DataFrame:
    """a <= b (in order of PLAIN) and the weight of this pair of letters over all places of all blocks (block and seq)."""
    found = clusters(blocks, percent, scope)
    sizes = found.groupBy("block", "cluster").agg(F.sum("n").alias("size"))
    letters = F.posexplode(F.split("seq", "")).alias("place", "letter")
    shown = found.join(sizes, ["block", "cluster"]).select("block", "cluster", (F.col("n") / F.col("size")).alias("w"), letters)
    place = F.expr(f"instr('{PLAIN}', letter)")
    shown = shown.where("letter <> ''").withColumn("x", place).where("x > 0")
    parts = scope.saved(shown.groupBy("block", "place", "cluster", "x").agg(F.sum("w").alias("v")), "block-letters")
    all_ = parts.groupBy("block", "place", "x").agg(F.sum("v").alias("v"))
    products = lambda df, keys: df.join(df.select(*keys, F.col("x").alias("y"), F.col("v").alias("u")), keys).where("x <= y").groupBy("x", "y").agg(F.sum(F.col("v") * F.col("u")).alias("s"))
    whole, same = products(all_, ["block", "place"]), products(parts, ["block", "place", "cluster"]).withColumnRenamed("s", "t")
    half = F.when(F.col("x") == F.col("y"), 0.5).otherwise(1.0)
    weight = (F.col("s") - F.coalesce("t", F.lit(0.0))) * half
    letter = lambda c: F.substring(F.lit(PLAIN), F.col(c), F.lit(1))
    return whole.join(same, ["x", "y"], "left").select(letter("x").alias("a"), letter("y").alias("b"), F.greatest(weight, F.lit(0.0)).alias("weight"))


def scores(weights: dict[tuple[str, str], float]) -> tuple[np.ndarray, int]:
    """The table over all letters, and its unit as so many to a bit: log odds, rounded.

    Pairs that no two clusters show get the least score. B and Z are the mean of the letters that they stand for, X that
    of all, by frequency; * gets the least score, and 1 with itself.
    """
    q = np.zeros((20, 20))
    for (a, b), w in weights.items():
        i, j = PLAIN.index(a), PLAIN.index(b)
        q[i, j] += w / 2
        q[j, i] += w / 2
    if not q.sum():
        raise SequenceError("no two clusters of a block can be compared")
    q /= q.sum()
    p = q.sum(axis=1)
    seen = q > 1e-12
    bits = np.log2(np.where(seen, q, 1) / np.where(seen, np.outer(p, p), 1))
    unit = max(2, round(2 / np.sqrt((q * bits).sum()))) if (q * bits).sum() > 0 else 2
    s = bits * unit
    least = np.round(s[seen].min())
    s = np.where(seen, s, least)
    stands = {**{c: c for c in PLAIN}, **AMBIGUOUS, "X": PLAIN}
    wide = np.zeros((23, 20))
    for k, c in enumerate(AMINO[:23]):
        at = [PLAIN.index(x) for x in stands[c]]
        wide[k, at] = p[at] / p[at].sum() if p[at].sum() else 1 / len(at)
    out = np.full((STRIDE, STRIDE), least)
    out[:23, :23] = np.round(wide @ s @ wide.T)
    out[23, 23] = 1
    return out.astype(np.int32), unit


def estimate(blocks: DataFrame, percent: float) -> Matrix:
    """The matrix for a percentage from aligned blocks: block and seq, a row per sequence."""
    with Scope(blocks.sparkSession) as scope:
        weights = {(r["a"], r["b"]): r["weight"] for r in pair_weights(blocks, percent, scope).collect()}  # 210 rows at most
    return Matrix(f"blosum{percent:g}", "amino", AMINO, scores(weights)[0])


def write_matrix(matrix: Matrix, folder: str | Path) -> Path:
    """A file in the usual text layout, named as get_matrix() looks for it in a folder of matrices."""
    path = Path(folder) / f"{matrix.name}.txt"
    rows = ["  " + " ".join(f"{c:>3}" for c in matrix.alphabet)]
    rows += [f"{c} " + " ".join(f"{int(x):>3}" for x in matrix.scores[k, : len(matrix.alphabet)]) for k, c in enumerate(matrix.alphabet)]
    path.write_text("\n".join(rows) + "\n")
    return path
