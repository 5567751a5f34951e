"""The queries over whole tables, copies included, against plain loops."""

import functools

import numpy as np
import pytest

import __spark_entry__ as entry
from quillweave.functions.matrices import AMINO, NUCLEOTIDE
from quillweave.registry import CONFIGS, EQUAL_GAPS, QUERIES

BLANK = -(10**9)


def letters_of(text, alphabet):
    return "".join(c for c in text or "" if c in alphabet + alphabet.lower()).upper()


def sequences(small, table, key, column, alphabet=AMINO):
    import pyarrow.parquet as pq

    rows = sorted(pq.read_table(f"{small}/{table}.parquet", columns=[key, column]).to_pylist(), key=lambda r: r[key])
    return [s for r in rows if (s := letters_of(r[column], alphabet))]


@functools.cache
def score_of(a, b, config):
    """The recurrence cell by cell: a is the row side, gaps of length k cost open + (k - 1) * extend."""
    m, (o, e) = config.load(), (-g for g in config.gaps)
    local, at = config.method == "sw", {c: i for i, c in enumerate(m.alphabet)}
    edge = lambda k: 0 if local or not k else -o - (k - 1) * e
    up, gap_up, best = [edge(x) for x in range(len(b) + 1)], [BLANK] * (len(b) + 1), 0
    for y, p in enumerate(a, 1):
        row, gap_row, gap_left = [edge(y)], [BLANK], BLANK
        for x, q in enumerate(b, 1):
            gap_left = max(row[x - 1] - o, gap_left - e)
            gap_row.append(max(up[x] - o, gap_up[x] - e))
            row.append(max(up[x - 1] + int(m.scores[at[p], at[q]]), gap_left, gap_row[x], 0 if local else BLANK))
            best = max(best, row[x])
        up, gap_up = row, gap_row
    return best if local else up[-1]


def share(a, b):
    n = min(len(a), len(b))
    return np.float32(sum(x == y for x, y in zip(a, b))) / np.float32(n)


def survivors(seqs, threshold):
    kept = []
    for s in seqs:
        if not any(share(k, s) >= np.float32(threshold) for k in kept):
            kept.append(s)
    return kept


def pair_scores(df):
    return {(r["i"], r["j"]): r["score"] for r in df.collect()}


def wanted(seqs, config):
    config = config.resolved()
    return {(i, j): score_of(seqs[i], seqs[j], config) for j in range(len(seqs)) for i in range(j)}


@pytest.mark.parametrize("method, kind", list(CONFIGS))
def test_scores_of_all_rows(spark, small, method, kind):
    seqs = sequences(small, "part", "p_partkey", "p_name", {"protein": AMINO, "dna": NUCLEOTIDE}[kind])
    assert len(seqs) > len(set(seqs))
    assert pair_scores(QUERIES[f"q_{method}_{kind}_whole"](spark, small)) == wanted(seqs, CONFIGS[method, kind])


@pytest.mark.parametrize("method", ["nw", "ga", "sw"])
def test_sql_backend_of_all_rows(spark, small, method):
    seqs = sequences(small, "part", "p_partkey", "p_name")
    assert pair_scores(QUERIES[f"q_{method}_sql_backend_whole"](spark, small)) == wanted(seqs, CONFIGS[method, "protein"])


def test_pairs_filter_and_matrix_of_all_rows(spark, small):
    seqs = sequences(small, "part", "p_partkey", "p_name")
    run = lambda name: QUERIES[f"q_{name}_whole"](spark, small).collect()
    every = {(i, j) for j in range(len(seqs)) for i in range(j)}
    assert sorted((r["i"], r["j"]) for r in run("pairs")) == sorted(every)
    assert sorted(tuple(r) for r in run("pair_index")) == sorted((j * (j - 1) // 2 + i, i, j) for i, j in every)
    shares = {(i, j): share(seqs[i], seqs[j]) for i, j in every}
    assert {(r["i"], r["j"]): np.float32(r["identity"]) for r in run("identity")} == shares
    assert sorted((r["i"], r["j"]) for r in run("filter_edges_05")) == sorted(p for p in every if shares[p] >= np.float32(0.5))
    for name, threshold in (("05", 0.5), ("09", 0.9)):
        kept = survivors(seqs, threshold)
        assert sorted(tuple(r) for r in run(f"filter_greedy_{name}")) == list(enumerate(kept)) and len(kept) < len(seqs)
    nw = CONFIGS["nw", "protein"]
    assert {(r["i"], r["j"]): r["score"] for r in run("filtered_nw")} == wanted(survivors(seqs, 0.5), nw)
    assert {(r["i"], r["j"]): r["score"] for r in run("ga_equal_gap_rewrite")} == wanted(seqs, EQUAL_GAPS)
    scores = wanted(seqs, nw)
    whole = {**scores, **{(j, i): v for (i, j), v in scores.items()}, **{(i, i): 0 for i in range(len(seqs))}}
    assert {(r["i"], r["j"]): r["score"] for r in run("matrix_long")} == whole
    assert {r["ord"]: r["scores"] for r in run("matrix_dense")} == {i: " ".join(str(whole[i, j]) for j in range(len(seqs))) for i in range(len(seqs))}


def test_one_pass_over_all_documents(spark, small):
    seqs = sequences(small, "documents", "doc_id", "text")
    for name in ("fasta", "dsv"):
        assert sorted(tuple(r) for r in QUERIES[f"q_{name}_roundtrip_whole"](spark, small).collect()) == list(enumerate(seqs))
    codes = QUERIES["q_encode_whole"](spark, small).groupBy("ord").agg({"code": "sum", "pos": "max"}).collect()
    assert {r["ord"]: (r["sum(code)"], r["max(pos)"]) for r in codes} == {i: (sum(map(AMINO.index, s)), len(s)) for i, s in enumerate(seqs)}


def test_entry_takes_all_rows(spark):
    n = len(sequences(entry.ENTRY_DIR, "part", "p_partkey", "p_name"))
    assert entry.entry(spark).count() == n * (n - 1) // 2 == 19_900


def test_filter_takes_as_many_rounds_as_a_chain_needs(spark, monkeypatch):
    from quillweave.operators import similarity_filter

    monkeypatch.setattr(similarity_filter, "MAX_ROUNDS", 3, raising=False)
    chain = [AMINO[(i + 1) // 2] + AMINO[i // 2] for i in range(12)]  # each shares one of two letters with its neighbours
    seqs = spark.createDataFrame(list(enumerate(chain)), "ord int, seq string")
    got = sorted(tuple(r) for r in similarity_filter.greedy_filter(seqs, 0.5).collect())
    assert got == list(enumerate(survivors(chain, 0.5))) == list(enumerate(chain[::2]))


def test_benchmark_queries_equal_plain_loops(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list(AMINO[:20]), n)) for n in (1, 2, 7, 19, 30, 31, 64, 65, 90)]
    texts += [texts[5], texts[8][:40] + texts[6], texts[7].lower() + " 1 é", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seqs = [s for t in texts if (s := letters_of(t, AMINO))]
    for method in ("nw", "ga", "sw"):
        assert pair_scores(QUERIES[f"q_{method}_benchmark"](spark, str(tmp_path))) == wanted(seqs, CONFIGS[method, "protein"])
    kept = survivors(seqs, 0.1)
    assert sorted(tuple(r) for r in QUERIES["q_filter_benchmark"](spark, str(tmp_path)).collect()) == list(enumerate(kept)) and len(kept) < len(seqs)
