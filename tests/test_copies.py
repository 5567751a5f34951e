"""Pairs of sets with copies: numbered without joins, compared once for the distinct sequences, told of all copies."""

import random

import pytest

from quillweave.operators import copies, matrix, score
from quillweave.operators.copies import by_distinct
from quillweave.operators.pairs import all_pairs, numbered_pairs
from quillweave.operators.score import dense_scores, dense_texts, score_all, score_all_sql
from quillweave.operators.similarity_filter import edges
from quillweave.plans.config import ScoringConfig
from quillweave.registry import QUERIES

NW = ScoringConfig("nw", "blosum62", gap=4)


def _set(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "ord int, seq string").repartition(3)


def _copied(seed=1, n=90):
    rng = random.Random(seed)
    names = ["".join(rng.choices("ARNDCQEG", k=rng.randint(2, 12))) for _ in range(9)]
    return [*rng.choices(names, weights=[40, *[5] * 8], k=n), "WWWW"]


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["q_pairs_whole", "q_pair_index_whole"])
def test_numbers_of_pairs_take_no_join_and_no_shuffle(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Range" in plan and "Join" not in plan and "Exchange" not in plan


def test_numbered_pairs_are_all_pairs(spark):
    for n in (0, 1, 2, 70):
        seqs = _set(spark, ["AC"] * n) if n else spark.createDataFrame([], "ord int, seq string")
        assert _rows(numbered_pairs(seqs)) == _rows(all_pairs(seqs).select("pair_id", "i", "j"))


@pytest.mark.parametrize("chunk", [3, 1024])
def test_copies_are_scored_once(spark, monkeypatch, chunk):
    seqs, sizes = _set(spark, _copied()), []
    want = _rows(score._by_blocks(seqs, NW))
    by_blocks = score._by_blocks
    monkeypatch.setattr(copies, "CHUNK", chunk)
    monkeypatch.setattr(score, "_by_blocks", lambda of, *a: sizes.append(of.count()) or by_blocks(of, *a))
    assert _rows(score_all(seqs, NW)) == want == _rows(score_all_sql(seqs, NW))
    dense = {r["ord"]: r["scores"] for r in dense_scores(seqs, NW).collect()}
    assert sizes == [len(set(_copied()))] * 2
    whole = {(i, j): s for i, j, s in want}
    n = len(_copied())
    assert dense == {i: [0 if i == j else whole[min(i, j), max(i, j)] for j in range(n)] for i in range(n)}


@pytest.mark.parametrize("piece", [4, 256])
def test_dense_texts_are_made_once(spark, monkeypatch, piece):
    monkeypatch.setattr(matrix, "PIECE", piece)
    for seqs in (_set(spark, _copied(3)), _set(spark, ["AC", "ACD", "W"])):
        texts = dense_texts(seqs, NW)
        assert _rows(texts) == sorted((r["ord"], " ".join(map(str, r["scores"]))) for r in dense_scores(seqs, NW).collect())
    sent, kinds = matrix._sent, []
    monkeypatch.setattr(matrix, "_sent", lambda *x: kinds.append(dict((out := sent(*x)).dtypes)["row"]) or out)
    dense_texts(_set(spark, _copied(3)), NW)
    assert kinds == ["array<string>"]  # scores become text before the copies are told apart


def test_two_lists_make_few_pairs_at_once(spark):
    made = copies.Copies(_set(spark, [*["ACD"] * 1500, "AC"]))
    sizes = [len(r["members"]) for r in made.lists.collect()]
    assert sum(sizes) == 1501 and max(sizes) ** 2 <= 1 << 16


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_edges_of_copies(spark, monkeypatch, threshold):
    seqs = _set(spark, _copied(2))
    monkeypatch.setattr(copies, "CHUNK", 4)
    assert _rows(edges(seqs, threshold)) == _rows(edges(seqs, threshold, block=7))


def test_few_copies_and_one_name_alone(spark):
    few = [f"A{'C' * k}" for k in range(1, 8)] + ["AC"]
    assert _rows(score_all(_set(spark, few), NW)) == _rows(score._by_blocks(_set(spark, few), NW))
    alone = _set(spark, ["ACD"] * 5)
    assert _rows(score_all(alone, NW)) == _rows(score._by_blocks(alone, NW)) and score_all(alone, NW).count() == 10
    assert by_distinct(spark.createDataFrame([], "ord int, seq string"), lambda x: all_pairs(x).select("i", "j"), None).count() == 0


def test_a_table_that_is_not_symmetric_is_taken_as_it_stands(spark, monkeypatch):
    monkeypatch.setattr(score, "symmetric", lambda config: False)
    monkeypatch.setattr(score, "by_distinct", None)
    assert score_all(_set(spark, ["AC", "AC", "AC"]), NW).count() == 3


def test_pairs_of_copies_leave_in_runs(spark):
    """Rows in which i changes from row to row take several times the bytes when they are stored."""
    seqs = _set(spark, ["ACD", "AC"] * 300)
    changes = score_all(seqs, NW).mapInPandas(lambda batches: (b.assign(new=b["i"].diff() != 0)[["new"]] for b in batches), "new boolean")
    rows, new = changes.selectExpr("count(*)", "count_if(new)").first()
    assert rows == 600 * 599 // 2 and new < rows / 20


def _stored_bytes(df, path):
    df.coalesce(1).write.parquet(str(path))
    return sum(p.stat().st_size for p in path.glob("*.parquet"))


def test_pairs_are_stored_in_few_bytes(spark, tmp_path):
    """In order of pair numbers, i takes two bytes of each row."""
    pairs = numbered_pairs(_set(spark, ["AC"] * 3000)).select("i", "j")
    assert _stored_bytes(pairs, tmp_path / "pairs") < 3000 * 2999 // 2 / 2


@pytest.mark.parametrize("chunk", [3, 192])
def test_both_halves_of_copies_come_list_by_list(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(copies, "CHUNK", chunk)
    for seqs in (_set(spark, _copied(4)), _set(spark, ["AC", "ACD", "W"]), _set(spark, ["ACD"] * 5)):
        assert _rows(score.long_scores(seqs, NW)) == _rows(matrix.long_matrix(score._by_blocks(seqs, NW), seqs))
    if chunk == 192:
        assert _stored_bytes(score.long_scores(_set(spark, ["ACD", "AC"] * 700), NW), tmp_path / "long") < 1400**2 / 2


def test_lists_of_copies_are_not_shuffled(spark):
    made = copies.Copies(_set(spark, _copied(5)))
    found = made.once.select(made.once["ord"].alias("i"), made.once["ord"].alias("j"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made.pairs(found)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
