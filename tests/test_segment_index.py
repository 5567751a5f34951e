"""The segment index and the filter that goes block by block."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillweave.operators import segment_index, similarity_filter
from quillweave.operators.identity import first_apart, identity_shares, near_pairs
from quillweave.operators.pairs import all_pairs
from quillweave.operators.segment_index import SegmentIndex, mismatches_allowed
from quillweave.operators.similarity_filter import edges, greedy_filter, similar_pairs
from quillweave.plans.store import Scope, shared_folder

LETTERS = "ARNDCQEGHILKMFPSTWYV"


def _mixed(seed, n, bases=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices(LETTERS, k=rng.randint(1, 120))) for _ in range(bases)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 14)):
            s[rng.randrange(len(s))] = rng.choice(LETTERS)
        return "".join(s)[: rng.choice([200, 200, 60, 20])]

    return [changed(rng.choice(base)) for _ in range(n)]


def _set(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "ord int, seq string").repartition(3)


def _staying(seqs, threshold):
    kept = []
    for s in seqs:
        if not kept or not (identity_shares([s], kept)[0] >= np.float32(threshold)).any():
            kept.append(s)
    return kept


@pytest.mark.parametrize("threshold", [0.0001, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0])
def test_mismatches_allowed(spark, threshold):
    n = np.arange(1, 400)
    want = [max(m for m in range(k + 1) if np.float32(k - m) / np.float32(k) >= np.float32(threshold)) for k in n.tolist()]
    got = spark.range(1, 400).select("id", mismatches_allowed(F.col("id"), threshold).alias("m")).orderBy("id").collect()
    assert [r["m"] for r in got] == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_index_finds_what_all_pairs_do(spark, threshold, monkeypatch):
    seqs = _set(spark, dict.fromkeys(_mixed(1, 300)))
    want = sorted(map(tuple, edges(seqs, threshold).collect()))
    assert sorted(map(tuple, similar_pairs(seqs, threshold).collect())) == want and want
    monkeypatch.setattr(segment_index, "HOT_PAIRS", 20)
    monkeypatch.setattr(segment_index, "BLOCK", 7)
    assert sorted(map(tuple, similar_pairs(seqs, threshold).collect())) == want


def test_index_compares_few_pairs(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices(LETTERS, k=rng.randint(60, 90))) for _ in range(1500)]
    seqs += [s[:30] + "W" + s[31:] for s in seqs[:100]]
    whole = _set(spark, seqs)
    with Scope(spark) as scope:
        index = SegmentIndex(0.9, scope)
        entered, pairs = index.enter(whole)
        compared = index.candidates(entered, within=True).count()
        assert entered.where(f"pairs > {segment_index.HOT_PAIRS}").isEmpty()
        assert compared <= pairs < 0.02 * len(seqs) * (len(seqs) - 1) / 2
        assert index.similar(whole, entered=entered).count() >= 100


@pytest.mark.parametrize(("alone", "each", "links"), [(4096, 64, 1 << 20), (30, 1000, 25), (30, 2, 25)])
@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_filter_in_blocks(spark, monkeypatch, threshold, alone, each, links):
    """Blocks that one task decides, blocks by links in parts and in rounds, and blocks that are cut down."""
    for name, value in (("ALONE", alone), ("PAIRS_EACH", each), ("LINKS", links), ("ROUNDS", 1)):
        monkeypatch.setattr(similarity_filter, name, value)
    seqs = _mixed(2, 250)
    got = [tuple(r) for r in greedy_filter(_set(spark, seqs), threshold).orderBy("ord").collect()]
    assert got == list(enumerate(_staying(seqs, threshold)))


def test_first_apart():
    seqs = _mixed(3, 120)
    assert list(itertools.compress(seqs, first_apart(seqs, 0.6))) == _staying(seqs, 0.6)


def test_long_chain_takes_few_jobs_and_leaves_nothing(spark, monkeypatch):
    """Each sequence is near the one before it only, so every other one stays; rounds would follow the chain."""
    rng = random.Random(6)
    now, seqs = rng.choices(LETTERS, k=40), []
    for k in range(600):
        for x in range(3):
            now[(3 * k + x) % 40] = rng.choice([c for c in LETTERS if c != now[(3 * k + x) % 40]])
        seqs.append("".join(now))
    want = _staying(seqs, 0.9)
    assert 250 < len(want) < 350
    monkeypatch.setattr(similarity_filter, "ALONE", 100)
    folder = shared_folder(spark).removeprefix("file://") + "/quillweave"
    whole = _set(spark, seqs)
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    counted = []
    monkeypatch.setattr(similarity_filter, "_in_order", lambda b, f=similarity_filter._in_order: f(b))
    lost = similarity_filter._lost
    monkeypatch.setattr(similarity_filter, "_lost", lambda links, scope: counted.append(links.count()) or lost(links, scope))
    out = greedy_filter(whole, 0.9)
    assert [r["seq"] for r in out.orderBy("ord").collect()] == want
    assert len(counted) <= 4 and sum(counted) < 600  # links of one block at a time
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("parts-")  # what the result itself reads


def test_all_pairs_are_still_those_of_the_join(spark):
    seqs = _set(spark, ["AA", "AC", "CC"])
    assert sorted((r["i"], r["j"]) for r in all_pairs(seqs).collect()) == [(0, 1), (0, 2), (1, 2)]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9, 0.95, 1.0])
def test_sketches_rule_out_no_similar_pair(threshold):
    width = segment_index.sketch_width(float(np.float32(threshold)))
    assert width == {0.5: 1, 0.7: 2, 0.8: 4, 0.9: 8, 0.95: 16, 1.0: 32}[threshold]
    seqs = [*_mixed(5, 120), "", "A", "A" * width]
    a, b = zip(*itertools.combinations(seqs, 2))
    found = segment_index.least_mismatches([segment_index.sketch(s, width) for s in a], [segment_index.sketch(s, width) for s in b])
    real = np.array([sum(p != q for p, q in zip(x, y)) for x, y in zip(a, b)])
    assert (found <= real).all()
    if threshold >= 0.9:
        far = real > 60
        whole = np.array([min(len(x), len(y)) // width for x, y in zip(a, b)])
        assert far.any() and (found[far] >= 0.8 * whole[far]).mean() > 0.95


def test_entries_are_shuffled_once_and_letters_of_few_pairs_fetched(spark, monkeypatch):
    """Sequences that share a segment only, whose letters need not be fetched."""
    rng = random.Random(8)
    seqs = ["".join(rng.choices(LETTERS, k=8)) + "".join(rng.choices(LETTERS, k=192)) for _ in range(40)]
    seqs = [s[:64] + "ARNDCQEG" + s[72:] for s in seqs] + [seqs[0][:64] + "ARNDCQEG" + seqs[0][72:199] + "A"]
    whole, calls = _set(spark, seqs), []
    made = segment_index.entries
    monkeypatch.setattr(segment_index, "entries", lambda *a: calls.append(1) or made(*a))
    possible = segment_index._possible
    monkeypatch.setattr(segment_index, "_possible", lambda pairs, *a: calls.append((pairs.count(), possible(pairs, *a).count())) or possible(pairs, *a))
    assert [tuple(r) for r in similar_pairs(whole, 0.9).collect()] == [(0, 40)]
    assert calls == [1, (820, 1)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9, 1.0])
def test_near_pairs_are_those_of_all_shares(threshold, monkeypatch):
    from quillweave.operators import identity

    a, b = _mixed(6, 90), [s + "A" * k for k, s in enumerate(_mixed(6, 70))]
    want = np.nonzero(identity_shares(a, b) >= np.float32(threshold))
    for first, at_once in ((192, 1 << 24), (3, 40), (1, 1)):
        monkeypatch.setattr(identity, "FIRST", first)
        monkeypatch.setattr(identity, "AT_ONCE", at_once)
        assert all((x == y).all() for x, y in zip(near_pairs(a, b, threshold), want)) and len(want[0])
        assert list(itertools.compress(a, first_apart(a, threshold))) == _staying(a, threshold)


def test_buckets_with_the_same_sequences_are_compared_once(spark):
    """A long common beginning makes many buckets of the same sequences."""
    rng = random.Random(9)
    begin = "".join(rng.choices(LETTERS, k=80))
    whole = _set(spark, [begin + "".join(rng.choices(LETTERS, k=120)) for _ in range(100)])
    with Scope(spark) as scope:
        entered, pairs = SegmentIndex(0.9, scope).enter(whole)
        assert pairs < 2 * 100**2 and entered.where(f"pairs > {segment_index.HOT_PAIRS}").select("key").distinct().count() == 1
        assert entered.groupBy("key", "ord").count().where("count > 1").isEmpty()  # one entry for both sides


def test_a_set_with_few_similar_is_one_block(spark, monkeypatch):
    rng = random.Random(10)
    seqs = ["".join(rng.choices(LETTERS, k=60)) for _ in range(400)]
    seqs += [s[:50] + "W" + s[51:] for s in seqs[::9]]
    monkeypatch.setattr(similarity_filter, "ALONE", 20)
    entered = []
    enter = SegmentIndex.enter
    monkeypatch.setattr(SegmentIndex, "enter", lambda *x: entered.append(1) or enter(*x))
    out = greedy_filter(_set(spark, seqs), 0.9)
    assert [r["seq"] for r in out.orderBy("ord").collect()] == _staying(seqs, 0.9) and len(entered) == 1
