"""The packed triangle: written by tasks, read whole, by rows and by cell; nothing of a failed run is visible."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillweave.operators.copies import Copies
from quillweave.sources.tiles import TriangleReader, TriangleWriter, first_of, lookup, manifest, pairs_from, pairs_of, read_triangle, row_totals, write_triangle, write_triangle_runs


def scores_of(spark, n):
    rows = [(i, j, (i * 7919 + j * 104729) % 1001 - 500) for j in range(n) for i in range(j)]
    return rows, spark.createDataFrame(rows, "i int, j int, score int").repartition(5)


def test_numbers_and_pairs():
    j = np.array([1, 2, 3, 1 << 20, (1 << 31) - 1], dtype=np.int64)
    for number in (first_of(j), first_of(j + 1) - 1):
        a, b = pairs_of(number)
        assert (b == j).all() and (first_of(b) + a == number).all()


@pytest.mark.parametrize("n, chunk", [(2, 4), (40, 7), (40, 780), (61, 64)])
def test_write_and_read_back(spark, tmp_path, n, chunk):
    rows, df = scores_of(spark, n)
    path = f"{tmp_path}/t"
    write_triangle(df, n, path, chunk=chunk)
    read = lambda **k: sorted(tuple(r) for r in read_triangle(spark, path, **k).collect())
    assert read() == sorted(rows)
    whole = sorted(rows + [(j, i, s) for i, j, s in rows])
    assert read(symmetric=True) == whole
    for lo, hi in ((0, 1), (n // 2, n // 2 + 3), (n - 1, n), (n, n + 5)):
        assert read(rows=(lo, hi), symmetric=True) == [r for r in whole if lo <= r[0] < hi]
        assert read(rows=(lo, hi)) == sorted(r for r in rows if lo <= r[0] < hi or lo <= r[1] < hi)
    assert all(lookup(path, i, j) == lookup(path, j, i) == s for i, j, s in rows[::11])
    assert lookup(path, 0, 0) == 0
    with pytest.raises(IndexError):
        lookup(path, 0, n)


def test_half_of_the_dense_bytes(spark, tmp_path):
    n = 300
    _, df = scores_of(spark, n)
    write_triangle(df, n, f"{tmp_path}/t", level=0, chunk=4096)
    size = sum(os.path.getsize(f"{tmp_path}/t/{x}") for x in os.listdir(f"{tmp_path}/t"))
    assert size < 4 * n * n * 0.51 and len(manifest(f"{tmp_path}/t")["parts"]) > 1


def test_faults_leave_nothing_visible(spark, tmp_path):
    n = 30
    rows, df = scores_of(spark, n)
    path = f"{tmp_path}/t"
    faulty = [df.where("i > 0 or j < 25"), df.union(df.limit(1)), df.withColumn("j", F.col("j") + 1), df.withColumn("score", F.when(F.col("j") < 20, F.col("score"))), df.where("j < 3")]
    for bad in faulty:
        with pytest.raises(Exception, match="pair|chunk"):
            write_triangle(bad, n, path, chunk=50)
        assert not os.path.exists(f"{path}/manifest.json")
    write_triangle(df, n, path, chunk=50)
    with pytest.raises(Exception, match="FileExists"):
        write_triangle(df, n, path)
    with pytest.raises(Exception, match="pair|chunk"):
        write_triangle(df.limit(9), n, path, overwrite=True)
    assert sorted(tuple(r) for r in read_triangle(spark, path).collect()) == sorted(rows)
    before = {p[2] for p in manifest(path)["parts"]}
    write_triangle(df.withColumn("score", -F.col("score")), n, path, overwrite=True)
    assert sorted(tuple(r) for r in read_triangle(spark, path).collect()) == sorted((i, j, -s) for i, j, s in rows)
    assert not before & set(os.listdir(path))


def test_no_pairs(spark, tmp_path):
    _, df = scores_of(spark, 1)
    write_triangle(df, 1, f"{tmp_path}/t")
    assert read_triangle(spark, f"{tmp_path}/t").count() == 0


def test_a_whole_run_writes_it(spark, tmp_path):
    from quillweave.plans.config import ScoringConfig
    from quillweave.plans.run import align

    seqs = spark.createDataFrame([(0, "ACDE"), (1, "ACD"), (2, "WWW")], "ord int, seq string")
    run = align(spark, seqs, ScoringConfig("nw", "blosum62", gap=4), f"{tmp_path}/out", compression=3, format="triangle")
    got = sorted(tuple(r) for r in read_triangle(spark, f"{tmp_path}/out/similarity").collect())
    assert got == sorted(tuple(r) for r in run.scores.select("i", "j", "score").collect()) and len(got) == 3
    assert spark.read.parquet(f"{tmp_path}/out/sequences").count() == 3


@pytest.mark.parametrize("first, count", [(0, 1), (0, 10), (1, 2), (2, 9), (5, 1), (((1 << 31) - 2) * ((1 << 31) - 3) // 2 - 5, 9)])
def test_pairs_from_a_number_on(first, count):
    got, want = pairs_from(first, count), pairs_of(np.arange(first, first + count, dtype=np.int64))
    assert all((x == y).all() for x, y in zip(got, want))


@pytest.mark.parametrize("n, chunk", [(2, 4), (40, 7), (40, 780), (61, 64)])
def test_rows_of_scores_are_written_without_a_row_for_each_pair(spark, tmp_path, n, chunk):
    rows, _ = scores_of(spark, n)
    score = lambda i: ((i * 7919 + F.col("j").cast("long") * 104729) % 1001 - 500).cast("int")
    scores, beside = F.transform(F.sequence(F.col("lo"), F.col("hi") - 1), score), spark.range(1).select(F.lit(1).alias("one"))
    of = spark.range(n).select(F.col("id").cast("int").alias("j")).repartition(3)
    write_triangle_runs(of, n, f"{tmp_path}/t", scores, beside, chunk=chunk)
    assert sorted(tuple(r) for r in read_triangle(spark, f"{tmp_path}/t").collect()) == sorted(rows)


def test_faulty_runs_of_scores():
    def chunks(*runs):
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in runs], pa.int64()), pa.array([x for _, x in runs], pa.list_(pa.int32()))], ["first", "scores"])
        return [(at, x.tolist()) for at, x in TriangleWriter({"path": "/tmp/none", "n": 5, "chunk": 4}, False, packed=True).chunks_of(iter([batch.slice(0, 1), batch.slice(1)]))]

    assert chunks((2, [5, 6]), (0, [3, 4]), (4, [7, 8, 9, 1]), (8, [2, 2])) == [(0, [3, 4, 5, 6]), (1, [7, 8, 9, 1]), (2, [2, 2])]
    for bad in ([(0, [1, 2, 3])], [(0, [1, 2, 3, 4]), (1, [2])], [(2, [1, 2, 3])], [(8, [1, 2, 3])], [(-1, [1])], [(0, [1, None, 3, 4])], [(0, None)]):
        with pytest.raises(ValueError, match="pair|chunk"):
            chunks(*bad)


def test_copies_are_written_from_their_rows(spark, tmp_path, monkeypatch):
    from quillweave.operators import matrix, score
    from quillweave.plans.config import ScoringConfig

    nw, names = ScoringConfig("nw", "blosum62", gap=4), ["ACD", "WW", "ACD", "A", "WW", "ACD", "ACD", "C"]
    seqs = spark.createDataFrame(list(enumerate(names)), "ord int, seq string")
    monkeypatch.setattr(matrix, "PIECE", 3)
    monkeypatch.setattr(Copies, "pairs", None)  # pairs of ordinals are not made as rows
    score.write_scores(seqs, nw, f"{tmp_path}/t")
    want = sorted(tuple(r) for r in score._by_blocks(seqs, nw).collect())
    assert sorted(tuple(r) for r in read_triangle(spark, f"{tmp_path}/t").collect()) == want and len(want) == 28


@pytest.mark.parametrize("n, chunk", [(2, 4), (40, 7), (61, 64)])
def test_totals_of_rows_take_few_tasks(spark, tmp_path, monkeypatch, n, chunk):
    rows, df = scores_of(spark, n)
    write_triangle(df, n, f"{tmp_path}/t", chunk=chunk)
    got = sorted(tuple(r) for r in row_totals(spark, f"{tmp_path}/t").collect())
    whole = {k: [s for i, j, s in rows if k in (i, j)] for k in range(n)}
    assert got == [(k, n - 1, sum(x), min(x), max(x)) for k, x in whole.items()]
    parts = TriangleReader({"path": f"{tmp_path}/t"}).partitions()
    assert len(parts) == 1 < len(manifest(f"{tmp_path}/t")["parts"]) or n == 2


@pytest.mark.parametrize("chunk", [3, 7, 1 << 18])
def test_copies_are_coded_and_read_as_before(spark, tmp_path, monkeypatch, chunk):
    from quillweave.operators import matrix, score
    from quillweave.plans.config import ScoringConfig
    from quillweave.sources import tiles

    nw, n = ScoringConfig("nw", "blosum62", gap=4), 60
    names = [("ACD", "WW", "A", "ACDWY")[k * k % 4 if k != 33 else 3] if k != 7 else "C" for k in range(n)]
    seqs = spark.createDataFrame(list(enumerate(names)), "ord int, seq string")
    monkeypatch.setattr(matrix, "PIECE", 8)
    monkeypatch.setattr(score, "write_coded", lambda *x: tiles.write_coded(*x, chunk=chunk))
    path = f"{tmp_path}/t"
    score.write_scores(seqs, nw, path)
    facts = manifest(path)
    assert facts["distinct"] == len(set(names))
    assert sum(p[1] for p in facts["parts"]) == -(-(n + len(set(names)) ** 2) // chunk)  # not a number for each pair
    rows = sorted(tuple(r) for r in score._by_blocks(seqs, nw).collect())
    assert sorted(tuple(r) for r in read_triangle(spark, path).collect()) == rows
    assert sorted(tuple(r) for r in read_triangle(spark, path, rows=(7, 9)).collect()) == [r for r in rows if r[0] in (7, 8) or r[1] in (7, 8)]
    assert all(lookup(path, i, j) == lookup(path, j, i) == s for i, j, s in rows[::17])
    whole = {k: [s for i, j, s in rows if k in (i, j)] for k in range(n)}
    assert sorted(tuple(r) for r in row_totals(spark, path).collect()) == [(k, n - 1, sum(x), min(x), max(x)) for k, x in whole.items()]
