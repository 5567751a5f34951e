import pytest

import __spark_entry__ as entry
from quillweave.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, same_rows, name):
    same_rows(QUERIES[name](spark, small), ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["q_nw_benchmark", "q_ga_benchmark", "q_sw_benchmark"])
def test_whole_benchmark_texts(spark, small, name):
    from quillweave.functions.kernels import align_scores
    from quillweave.registry import CONFIGS, benchmark_seqs

    cfg = CONFIGS[name.split("_")[1], "protein"].resolved()
    m, (o, e) = cfg.load(), cfg.gaps
    seqs = {r["ord"]: r["seq"] for r in benchmark_seqs(spark, small).collect()}
    got = {(r["i"], r["j"]): r["score"] for r in QUERIES[name](spark, small).collect()}
    assert len(got) == len(seqs) * (len(seqs) - 1) // 2
    some = sorted(got)[::97]
    assert [got[p] for p in some] == align_scores([seqs[j] for _, j in some], [seqs[i] for i, _ in some], m.lookup, m.scores, cfg.method, o, e).tolist()


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
