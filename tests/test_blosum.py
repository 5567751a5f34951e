"""Substitution scores from aligned blocks."""

import itertools
import random

import numpy as np
import pytest

from quillweave.functions.matrices import AMINO, get_matrix
from quillweave.operators.blosum import PLAIN, clusters, estimate, pair_weights, scores, write_matrix
from quillweave.operators.sequences import SequenceError
from quillweave.plans.store import Scope


def _blocks(seed):
    rng = random.Random(seed)
    out = []
    for block in range(5):
        width, base = rng.randint(4, 40), []
        for _ in range(rng.randint(1, 4)):
            base.append(rng.choices(PLAIN[: rng.choice([4, 20])], k=width))
        for _ in range(rng.randint(2, 25)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, width // 2)):
                s[rng.randrange(width)] = rng.choice(PLAIN + "X")
            out.append((f"b{block}", "".join(s)))
        out.append(out[-1])  # a copy
    return out


def _plain(blocks, percent):
    """Weights of pairs of letters by listing all pairs of sequences."""
    weights = {}
    for _, rows in itertools.groupby(blocks, key=lambda r: r[0]):
        seqs = [s for _, s in rows]
        group = list(range(len(seqs)))
        for i, j in itertools.combinations(range(len(seqs)), 2):
            if np.float32(sum(a == b for a, b in zip(seqs[i], seqs[j]))) / np.float32(len(seqs[i])) >= np.float32(percent / 100):
                group = [group[i] if g == group[j] else g for g in group]
        for i, j in itertools.combinations(range(len(seqs)), 2):
            if group[i] != group[j]:
                for a, b in zip(seqs[i], seqs[j]):
                    if a in PLAIN and b in PLAIN:
                        key = tuple(sorted((a, b), key=PLAIN.index))
                        weights[key] = weights.get(key, 0) + 1 / group.count(group[i]) / group.count(group[j])
    return weights


@pytest.mark.parametrize("percent", [30, 62, 90, 100])
def test_weights_equal_listed_pairs(spark, percent):
    blocks = _blocks(percent)
    df = spark.createDataFrame(blocks, "block string, seq string").repartition(3)
    with Scope(spark) as scope:
        got = {(r["a"], r["b"]): r["weight"] for r in pair_weights(df, percent, scope).where("weight > 1e-9").collect()}
    want = _plain(blocks, percent)
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-9 for k, w in want.items()) and want


def test_chains_are_one_cluster(spark):
    """Neighbours share nine letters of ten, the ends none; long chains take few rounds."""
    chain = ["A" * (10 - k) + "R" * k for k in range(11)] + ["R" * (10 - k) + "N" * k for k in range(11)]
    df = spark.createDataFrame([("x", s) for s in chain] + [("y", chain[0]), ("y", chain[10])], "block string, seq string")
    with Scope(spark) as scope:
        found = {(r["block"], r["seq"]): r["cluster"] for r in clusters(df, 90, scope).collect()}
    assert len({c for (b, _), c in found.items() if b == "x"}) == 1
    assert len({c for (b, _), c in found.items() if b == "y"}) == 2


def test_worked_example():
    """Odds by hand: one place, nine A and one R in clusters of their own."""
    table, unit = scores({("A", "A"): 36.0, ("A", "R"): 9.0})
    q, p = {"AA": 0.8, "AR": 0.2}, {"A": 0.9, "R": 0.1}
    bits = {"AA": np.log2(q["AA"] / p["A"] ** 2), "AR": np.log2(q["AR"] / (2 * p["A"] * p["R"]))}
    assert unit == max(2, round(2 / np.sqrt(q["AA"] * bits["AA"] + q["AR"] * bits["AR"])))
    at = AMINO.index
    assert table[at("A"), at("A")] == round(unit * bits["AA"]) and table[at("A"), at("R")] == table[at("R"), at("A")] == round(unit * bits["AR"])
    assert table[at("*"), at("*")] == 1 and table[at("*"), at("W")] == table.min() == table[at("R"), at("R")]


def test_estimate_makes_a_matrix(spark, tmp_path):
    df = spark.createDataFrame(_blocks(7), "block string, seq string")
    m = estimate(df, 50)
    assert m.name == "blosum50" and m.alphabet == AMINO and (m.scores == m.scores.T).all()
    write_matrix(m, tmp_path)
    assert (get_matrix("BLOSUM50", tmp_path).scores == m.scores).all()
    with pytest.raises(ValueError):
        estimate(df, 0)
    with pytest.raises(SequenceError, match="differ in length"):
        estimate(spark.createDataFrame([("b", "AA"), ("b", "AAA")], "block string, seq string"), 50)
    with pytest.raises(SequenceError, match="no two clusters"):
        estimate(df.limit(0), 50)
