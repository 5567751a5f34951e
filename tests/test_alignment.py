import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillweave.functions.kernels import align_scores
from quillweave.functions.matrices import AMINO, BLOSUM_NAMES, NUCLEOTIDE_NAMES, PAM_NAMES, catalog_text, get_matrix, list_matrices, read_matrix
from quillweave.operators.score import register_functions, score_all, score_pairs
from quillweave.plans.config import ScoringConfig

GOLDEN = [
    ("HEAGAWGHEE", "PAWHEAE", "blosum62", 4, 10, 1, (12, 3, 18)),
    ("HEAGAWGHEE", "PAWHEAE", "pam250", 0, 12, 2, (34, 6, 22)),
    ("MKTAYIAKQR", "MKTAYIAKQK", "blosum62", 4, 10, 1, (46, 46, 46)),
    ("W", "ACDEFGHIKLMNPQRSTVWY", "blosum62", 4, 10, 1, (-65, -26, 11)),
    ("AAAA*X", "W", "blosum62", 4, 10, 1, (-22, -16, 0)),
    ("X", "X", "blosum62", 4, 10, 1, (-1, -1, 0)),
    ("A", "AAAAA", "blosum62", 4, 1, 6, (-12, 0, 4)),
    ("GATTACA", "GCATGCT", "dnafull", 5, 10, 1, (2, -1, 10)),
    ("GATTACA", "GCATGCT", "nuc44", 5, 10, 1, (2, -1, 10)),
    ("T*", "**", "dnafull", 5, 10, 1, (10, 10, 10)),
    ("T*", "**", "nuc44", 5, 10, 1, (-8, -8, 0)),
]


def cell_by_cell(a, b, m, method, o, e):
    """The recurrences as they are written down, one cell at a time."""
    lookup, s = m.lookup, m.scores
    if method == "nw":
        e = o
    low = -(2**30)
    n, k = len(b), len(a)
    h = np.zeros((n + 1, k + 1), int)
    x = np.full((n + 1, k + 1), low)
    y = np.full((n + 1, k + 1), low)
    if method != "sw":
        for j in range(1, k + 1):
            h[0, j] = x[0, j] = max(h[0, j - 1] + o, x[0, j - 1] + e)
        for i in range(1, n + 1):
            h[i, 0] = y[i, 0] = max(h[i - 1, 0] + o, y[i - 1, 0] + e)
    best = 0
    for i in range(1, n + 1):
        for j in range(1, k + 1):
            x[i, j] = max(h[i, j - 1] + o, x[i, j - 1] + e)
            y[i, j] = max(h[i - 1, j] + o, y[i - 1, j] + e)
            h[i, j] = max(h[i - 1, j - 1] + s[lookup[ord(a[j - 1])], lookup[ord(b[i - 1])]], x[i, j], y[i, j])
            if method == "sw":
                h[i, j] = max(h[i, j], 0)
                best = max(best, h[i, j])
    return best if method == "sw" else h[n, k]


@pytest.mark.parametrize("a,b,name,gap,o,e,want", GOLDEN)
def test_golden(a, b, name, gap, o, e, want):
    m = get_matrix(name)
    got = tuple(int(align_scores([a], [b], m.lookup, m.scores, k, -(gap if k == "nw" else o), -e)[0]) for k in ("nw", "ga", "sw"))
    assert got == want


words = st.lists(st.text(AMINO, min_size=1, max_size=12), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(words, words, st.sampled_from(["nw", "ga", "sw"]), st.integers(0, 12), st.integers(0, 12))
def test_batches_equal_cells(a, b, method, o, e):
    m = get_matrix("blosum62")
    n = min(len(a), len(b))
    got = align_scores(a[:n], b[:n], m.lookup, m.scores, method, -o, -e)
    assert got.tolist() == [cell_by_cell(x, y, m, method, -o, -e) for x, y in zip(a, b)]
    assert got.tolist() == align_scores(b[:n], a[:n], m.lookup, m.scores, method, -o, -e).tolist()


def test_matrices(spark, tmp_path):
    for name in [*PAM_NAMES, "blosum62", *NUCLEOTIDE_NAMES]:
        s = get_matrix(name).scores
        assert (s == s.T).all()
    at = lambda n, x, y: get_matrix(n).scores[AMINO.index(x), AMINO.index(y)]
    assert (at("BLOSUM62", "A", "A"), at("blosum62", "W", "W"), at("blosum62", "*", "*"), at("pam250", "W", "W")) == (4, 11, 1, 17)
    a, b = get_matrix("dnafull").scores, get_matrix("nuc44").scores
    assert (a[:15, :15] == b[:15, :15]).all() and not a[16:].any()
    assert list_matrices(spark).groupBy("kind").count().rdd.collectAsMap() == {"amino": 65, "nucleotide": 2}
    assert "Amino acid matrices (65):" in catalog_text()
    with pytest.raises(ValueError):
        get_matrix("blosum45")
    text = "# comment\n   " + "  ".join(AMINO) + "\n" + "\n".join(f"{x} " + " ".join(str(i + j) for j in range(24)) for i, x in enumerate(AMINO))
    (tmp_path / "BLOSUM45").write_text(text)
    assert (get_matrix("blosum45", tmp_path).scores == np.add.outer(np.arange(24), np.arange(24))).all()
    assert read_matrix(tmp_path / "BLOSUM45", AMINO).shape == (24, 24)
    assert len(BLOSUM_NAMES) == 15 and len(PAM_NAMES) == 50


def test_config():
    assert ScoringConfig("Gotoh", "pam30", gap_open=3, gap_extend=3).resolved().method == "nw"
    assert ScoringConfig("ga", "pam30", gap_open=3, gap_extend=3, rewrite_equal_affine=False).resolved().method == "ga"
    assert ScoringConfig("Smith-Waterman", "pam30", gap_open=3, gap_extend=1).resolved().gaps == (-3, -1)
    for bad in (dict(method="nw"), dict(method="nw", gap=1, gap_open=2), dict(method="sw", gap=1), dict(method="sw", gap_open=1), dict(method="zz", gap=1), dict(method="nw", gap=-1)):
        with pytest.raises(ValueError):
            ScoringConfig(matrix="blosum62", **bad)


def test_backends_agree(spark):
    pairs = spark.createDataFrame([(a, b) for a, b, *_ in GOLDEN[:7]], "seq_i string, seq_j string")
    for cfg in (ScoringConfig("nw", "blosum62", gap=4), ScoringConfig("ga", "blosum62", gap_open=10, gap_extend=1), ScoringConfig("sw", "blosum62", gap_open=1, gap_extend=6)):
        a, b = (sorted(map(tuple, score_pairs(pairs, cfg, x).collect())) for x in ("arrow", "sql"))
        assert a == b


def test_partitions_do_not_matter_and_sql_functions(spark):
    seqs = spark.createDataFrame([(i, s) for i, s in enumerate(["HEAGAW", "PAWHE", "MKT", "W", "AAAA"])], "ord int, seq string")
    cfg = ScoringConfig("nw", "blosum62", gap=4)
    want = sorted(map(tuple, score_all(seqs, cfg).collect()))
    assert len(want) == 10
    for block, parts in ((2, 3), (1, 1), (3, 5)):
        assert sorted(map(tuple, score_all(seqs.repartition(parts), cfg, block).collect())) == want
    register_functions(spark, cfg)
    row = spark.sql("select align_score('HEAGAWGHEE', 'PAWHEAE') as s, positional_identity('AC', 'ACDEF') as p").first()
    assert (row["s"], row["p"]) == (12, 1.0)
