import subprocess
import sys

import pytest

from quillweave import cli
from quillweave.functions.matrices import AMINO, NUCLEOTIDE
from quillweave.operators.sequences import SequenceError, from_dataframe, stats
from quillweave.operators.similarity_filter import greedy_filter, removed
from quillweave.plans.config import ScoringConfig
from quillweave.plans.run import align
from quillweave.sources.readers import parse_dsv, read_dsv_relaxed, read_sequences


def read(spark, tmp_path, name, data, alphabet=NUCLEOTIDE, **options):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return [r["seq"] for r in read_sequences(spark, str(path), alphabet, **options).orderBy("ord").collect()]


GOOD = [
    ("a.fasta", ">h1 x > y\nACG\nT g>bad\r\nGG\n>h2\nTT\n", {}, ["ACGTG", "GG", "TT"]),
    ("a.FA", ">a\nac\n>b\ng\n", {}, ["AC", "G"]),
    ("a.csv", 'id,seq\n1,"AC ""G""\nT"\n2,ac\n', {}, ["ACGT", "AC"]),
    ("b.csv", "id,seq\n1,ACGT,\n2,A\n", {}, ["ACGT", "A"]),
    ("a.tsv", "DNA\tx\nAC\t1\n\n\nGT\t2", {}, ["AC", "GT"]),
    ("a.psv", "a|b\nx|AC\ny|GT\n", {"seq_col": "B"}, ["AC", "GT"]),
    ("a.ssv", "x;AC\ny;GT\n", {"seq_col": 1, "header": False}, ["AC", "GT"]),
]
BAD = [
    ("a.fasta", "ACG\n", "before first header"),
    ("a.fasta", ">h1\nAC\n>h2", "no data"),
    ("a.fasta", ">h1\nAC\n>h2\n", "no data"),
    ("a.fasta", ">h1\n>h2\nAC\n", "#1 is empty"),
    ("a.fasta", ">h\nAC-T\n>g\nA\n", "#1 is invalid"),
    ("a.fasta", ">h\nACU\n>g\nA\n", "#1 is invalid"),
    ("a.fasta", b">h\nAC\n>g\nA\xc3\n", "#2 is corrupted"),
    ("a.fasta", b">h\nA\0C\n>g\nA\n", "#1 is corrupted"),
    ("a.fasta", ">h\nAC\n", "not enough"),
    ("a.fasta", "", "empty"),
    ("a.csv", "id,seq,lab\n1,ACGT,\n", "too few columns"),
    ("a.csv", "id,seq\n1,ACGT,x\n", "too many columns"),
    ("a.csv", "id,seq\n1\n", "no sequence column"),
    ("a.csv", "id,seq,lab\n1,,x\n", "#1 is empty"),
    ("a.csv", "id,,seq\n1,2,A\n", "empty column"),
    ("a.csv", "id,seq\n1,AC\n2,A!\n3\n", "#2 is invalid"),
    ("a.csv", "a,b\nx,AC\n", "not known"),
    ("seqs", "x", "extension not found"),
    (".csv", "x", "extension not found"),
    ("seqs.txt", "x", "Unsupported"),
]


@pytest.mark.parametrize("name,data,options,want", GOOD)
def test_reads(spark, tmp_path, name, data, options, want):
    assert read(spark, tmp_path, name, data, **options) == want


@pytest.mark.parametrize("name,data,error", BAD)
def test_refuses(spark, tmp_path, name, data, error):
    with pytest.raises(SequenceError, match=error):
        read(spark, tmp_path, name, data)


def test_length_limit(spark, tmp_path):
    with pytest.raises(SequenceError, match="#2 exceeds length limits"):
        read(spark, tmp_path, "a.fa", ">a\nAC\n>b\nACGT\n", max_length=3)


def test_parse_keeps_rows_before_the_fault():
    assert parse_dsv("seq,x\nAC,1\nGT\n", ",") == (["AC", "GT"], "DSV row #2 has too few columns")


def test_relaxed_reader(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,seq\n2,"ac g"\n1,tt\n')
    got = from_dataframe(read_dsv_relaxed(spark, str(tmp_path / "r.csv"), "seq", "id"), "seq", "id", NUCLEOTIDE)
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(0, "TT"), (1, "ACG")]


def seq_set(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "ord int, seq string")


FILTER = [
    (["AAAA", "AAAA", "CCCC"], 1.0, ["AAAA", "CCCC"]),
    (["AC", "ACDEF", "WWWW"], 1.0, ["AC", "WWWW"]),
    (["AAAA", "AAAC", "AACC"], 0.75, ["AAAA", "AACC"]),
    (["AAA", "AAC", "WWW"], 0.66666667, ["AAA", "WWW"]),
    (["AAA", "CCC"], 0.0, ["AAA", "CCC"]),
]


@pytest.mark.parametrize("seqs,threshold,want", FILTER)
def test_filter(spark, seqs, threshold, want):
    before = seq_set(spark, seqs)
    after = greedy_filter(before, threshold)
    assert [tuple(r) for r in after.orderBy("ord").collect()] == list(enumerate(want))
    assert removed(before, after) == f"Filtered out {len(seqs) - len(want)} sequences"


def test_filter_leaves_too_few(spark):
    with pytest.raises(SequenceError):
        greedy_filter(seq_set(spark, ["AAA", "AAA"]), 0.9)


def test_filter_equals_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("AC"), rng.integers(2, 7))) for _ in range(60)]
    kept = []
    for s in seqs:
        share = lambda a: np.float32(sum(x == y for x, y in zip(a, s))) / np.float32(min(len(a), len(s)))
        if all(share(k) < np.float32(0.8) for k in kept):
            kept.append(s)
    assert [r["seq"] for r in greedy_filter(seq_set(spark, seqs), 0.8).orderBy("ord").collect()] == kept


def test_stats(spark):
    assert tuple(stats(seq_set(spark, ["AC", "ACG"])).first()) == (2, 3, 7, 2.5)


def test_run_and_sinks(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text(">a\nHEAGAWGHEE\n>b\nPAWHEAE\n>c\nPAWHEAE\n>d\nMKT\n")
    cfg = ScoringConfig("nw", "blosum62", gap=4)
    out = str(tmp_path / "out")
    result = align(spark, str(path), cfg, out, filter_threshold=0.9, compression=3)
    assert "Filtered out 1 sequences" in result.notes and set(result.seconds) == {"input", "filtering", "alignment", "output", "total"}
    rows = {r["ord"]: r["scores"] for r in spark.read.parquet(f"{out}/similarity").collect()}
    assert rows[0][1] == rows[1][0] == 12 and [rows[i][i] for i in range(3)] == [0, 0, 0]
    assert [r["seq"] for r in spark.read.parquet(f"{out}/sequences").orderBy("ord").collect()] == ["HEAGAWGHEE", "PAWHEAE", "MKT"]
    with pytest.raises(Exception, match="(?i)exists"):
        align(spark, str(path), cfg, out)
    with pytest.raises(ValueError):
        align(spark, str(path), cfg)
    with pytest.raises(RuntimeError, match="h5py"):
        align(spark, str(path), cfg, str(tmp_path / "x.h5"), format="hdf5")


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["-l"]) == 0 and "pam250" in capsys.readouterr().out
    path = tmp_path / "in.fa"
    path.write_text(">a\nHEAGAW\n>b\nPAW\n")
    base = ["-i", str(path), "-m", "BLOSUM62", "-a", "NW", "-p", "4"]
    assert cli.main([*base, "-o", str(tmp_path / "o"), "-B", "-z", "1"]) == 0
    assert "alignment" in capsys.readouterr().out
    assert cli.main([*base, "-W", "-Q", "-f", "0.5"]) in (0, 1)
    for wrong in ([*base], [*base, "-W", "-s", "3"], ["-i", "x", "-W"], [*base, "-W", "-f", "2"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
    (tmp_path / "bad.fa").write_text("A")
    assert cli.main(["-i", str(tmp_path / "bad.fa"), *base[2:], "-W"]) == 1
    assert "before first header" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    from quillweave.streaming.incremental import score_stream

    source = tmp_path / "in"
    spark.createDataFrame([("n", "PAWHEAE")], "name string, seq string").write.parquet(str(source))
    new = spark.readStream.schema("name string, seq string").parquet(str(source))
    q = score_stream(new, seq_set(spark, ["HEAGAWGHEE", "PAW"]), ScoringConfig("nw", "blosum62", gap=4)).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {r["ord"]: r["score"] for r in spark.table("scored").collect()}[0] == 12


def test_rest_stands_without_corpus_parts(tmp_path):
    """The entry module works where the corpus subpackage and the pipeline are gone."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quillweave", tmp_path / "quillweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 20, 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert got.stdout.split() == ["True", "False"], got.stderr


def test_alphabets():
    assert len(AMINO) == 24 and len(NUCLEOTIDE) == 16


def test_folders_of_files(spark, tmp_path):
    """Several files in order of their names; numbers go on; records and header checks are per file."""
    fasta = tmp_path / "many.fasta"
    fasta.mkdir()
    (fasta / "b.fasta").write_text(">h3 x > y\nAC\nGT>h4\n\nTT\n")
    (fasta / "a.fasta").write_text(">h1\nAAA\n\nCC\n>h2\nGG")
    assert sorted(map(tuple, read_sequences(spark, str(fasta), NUCLEOTIDE).collect())) == list(enumerate(["AAACC", "GG", "ACGT", "TT"]))
    (fasta / "c.fasta").write_text("AC\n>h\nAC\n")
    with pytest.raises(SequenceError, match="before first header"):
        read_sequences(spark, str(fasta), NUCLEOTIDE)
    dsv = tmp_path / "many.csv"
    dsv.mkdir()
    (dsv / "2.csv").write_text('name,seq\n"a\nb",TT\nc,"GG"\n')
    (dsv / "1.csv").write_text("seq,name\nAC,x\nGT,y\n")
    assert sorted(map(tuple, read_sequences(spark, str(dsv), NUCLEOTIDE).collect())) == list(enumerate(["AC", "GT", "TT", "GG"]))


def test_large_fasta_is_read_in_pieces(spark, tmp_path):
    import numpy as np

    rng, want, out = np.random.default_rng(1), [], []
    for k in range(3000):
        s = "".join(rng.choice(list("ACGT"), int(rng.integers(1, 200))))
        want.append(s)
        out.append(f">s{k} > more\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n")
    want.append("ACGT" * 100_000)
    (tmp_path / "big.fa").write_text("".join(out) + ">long\n" + "\n".join(["ACGT" * 25] * 4000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = sorted(map(tuple, read_sequences(spark, str(tmp_path / "big.fa"), NUCLEOTIDE).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(want))


def test_ties_are_numbered_by_sequence(spark):
    from quillweave.operators.sequences import from_dataframe

    rows = [(1, "TT"), (1, "AC"), (0, "GG"), (1, "CA")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "k int, seq string").repartition(parts)
        assert sorted(map(tuple, from_dataframe(df, "seq", "k", NUCLEOTIDE).collect())) == list(enumerate(["GG", "AC", "CA", "TT"]))


def test_registered_methods_bring_their_kernel(spark):
    import numpy as np

    from quillweave.operators.score import score_all, score_pairs
    from quillweave.plans.config import METHODS, Method, ScoringConfig, linear_gap, register_method

    def shared_letters(cols, rows, lookup, scores, o, e):
        return np.array([len(set(a) & set(b)) + o for a, b in zip(cols, rows)], np.int32)

    with pytest.raises(ValueError, match="kernel"):
        register_method(Method("none", None, linear_gap))
    register_method(Method("letters", shared_letters, linear_gap, ("common",)))
    try:
        seqs = spark.createDataFrame([(0, "ACG"), (1, "CGT"), (2, "TTT")], "ord int, seq string")
        config = ScoringConfig("common", "dnafull", gap=1)
        assert sorted(map(tuple, score_all(seqs, config).collect())) == [(0, 1, 1), (0, 2, -1), (1, 2, 0)]
        with pytest.raises(ValueError, match="SQL"):
            score_pairs(seqs, config, "sql")
        with pytest.raises(ValueError, match="letters takes gap"):
            ScoringConfig("letters", "dnafull", gap_open=1, gap_extend=1)
    finally:
        METHODS.pop("letters"), METHODS.pop("common")


def test_hdf5_sink(spark, tmp_path, monkeypatch):
    """The writer against a stand-in for h5py, which this machine lacks: datasets, chunks, compression, rows."""
    import sys
    import types

    import numpy as np

    from quillweave.plans.run import write_hdf5

    made = {}

    class File:
        def __init__(self, path, mode):
            made["mode"] = mode

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def create_dataset(self, name, shape, dtype, **layout):
            made[name] = np.zeros(shape, object if name == "sequences" else dtype)
            made[name + " layout"] = layout
            return made[name]

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File, string_dtype=lambda _: object))
    n = 300
    seqs = spark.createDataFrame([(i, "AC" * (i + 1)) for i in range(n)], "ord int, seq string")
    scores = spark.createDataFrame([(i, j, i * j) for j in range(n) for i in range(j)], "i int, j int, score int")
    write_hdf5(seqs, scores, str(tmp_path / "x.h5"), 3, True)
    table = made["similarity_matrix"]
    assert made["mode"] == "w" and made["similarity_matrix layout"] == {"chunks": (256, 256), "compression": 3}
    assert table.dtype == np.dtype("<i4") and (table == table.T).all() and table[7, 9] == 63 and not table.diagonal().any()
    assert made["sequences"][4] == "AC" * 5
    write_hdf5(seqs.where("ord < 2"), scores.where("j < 2"), str(tmp_path / "y.h5"), 0, False)
    assert made["mode"] == "x" and made["similarity_matrix layout"] == {}


def test_fasta_lines_are_put_together_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    from quillweave.sources import readers

    path, counted = tmp_path / "x.fasta", []
    path.write_text("".join(f">h {k}\n" + "ACGT\n" * 50 + f"G{'T' * k}" + ("\n" if k % 2 else "") for k in range(9)) + "\n")
    numbered = readers._numbered
    monkeypatch.setattr(readers, "_numbered", lambda rows, *a: counted.append(rows.count()) or numbered(rows, *a))
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = sorted(tuple(r) for r in readers.read_sequences(spark, str(path), "ATGC").collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == [(k, "ACGT" * 50 + "G" + "T" * k) for k in range(9)]
    assert counted[0] == 9


def test_letters_are_encoded_without_a_function_for_each(spark):
    from quillweave.operators.sequences import encoded

    rows = encoded(spark.createDataFrame([(0, "AR*"), (1, ""), (2, None), (3, "A")], "ord int, seq string"), AMINO)
    assert sorted(map(tuple, rows.collect())) == [(0, 1, 0), (0, 2, 1), (0, 3, len(AMINO) - 1), (3, 1, 0)]
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_stores_sorted_ranges_and_shuffles_no_second_time(spark):
    from pyspark.sql import functions as F

    from quillweave.operators.sequences import derive, renumber

    rows = [(k // 3, "a-r n"[: k % 5 + 1] * (k % 4 + 1)) for k in range(200)] + [(None, "w")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(7)
    want = sorted((-1 if k is None else k, "".join(c for c in t.upper() if c in "ARNW")) for k, t in rows)
    for got in (renumber(df.select("k", derive(F.col("text"), AMINO).alias("seq")), "k"), renumber(df, "k", derive(F.col("text"), AMINO))):
        assert sorted(map(tuple, got.collect())) == [(i, s) for i, (_, s) in enumerate(want)]
        assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_fasta_records_are_whole_whatever_the_batches(spark, tmp_path, monkeypatch):
    from quillweave.sources import readers

    path, counted = tmp_path / "x.fasta", []
    path.write_text("".join(f">h {k}\n" + "acgt\n" * 50 + f"G{'T' * k}\n" for k in range(9)))
    numbered = readers._numbered
    monkeypatch.setattr(readers, "_numbered", lambda rows, *a: counted.append(rows.count()) or numbered(rows, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert readers.read_sequences(spark, str(path), "ATGC").count() == 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert counted == [9]


@pytest.mark.parametrize("size", [3, 40])
def test_fasta_folder_is_equal_at_every_cut(spark, tmp_path, size):
    import random

    rng, want = random.Random(size), []
    folder = tmp_path / "many.fasta"
    folder.mkdir()
    for f in range(4):
        text = ""
        for _ in range(rng.randint(1, 6)):
            data = ["".join(rng.choices("ACGT acgt", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 4))] + ["A"]
            want.append("".join(data).replace(" ", "").upper())
            text += ("" if not text or text.endswith(("\n", "\r")) or rng.random() < 0.3 else "\n") + ">h > x\n" + rng.choice(["\n", "\r\n", "\n\n"]).join(data) + rng.choice(["\n", ""])
        (folder / f"{f}.fasta").write_bytes(text.encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, (size, 1)):
        spark.conf.set(n, str(v))
    from quillweave.sources import readers

    text = readers._text
    try:
        lines = readers.saved(text(spark, str(folder)).mapInPandas(readers._fasta_fragments, readers.FRAGMENT), "fragments")
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    got = readers._records(lines, "").collect()
    assert lines.where("_k = 0").count() > 0
    assert [r["data"].replace(" ", "").upper() for r in sorted(got, key=lambda r: r["_row"])] == want and {r["_row"] for r in got} == set(range(1, len(want) + 1))
