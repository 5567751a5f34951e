"""Delimited text in pieces: the same as reading each file from its start, wherever it is cut."""

import random

import pytest

from quillweave.functions.matrices import AMINO
from quillweave.operators.sequences import SequenceError
from quillweave.sources import readers
from quillweave.sources.readers import bare, parse_dsv, read_sequences


def _field(rng):
    word = lambda: "".join(rng.choices("ARNDC", k=rng.randint(1, 4)))
    return rng.choice([word, lambda: f'"{word()}"', lambda: f'"{word()}\n{word()}"', lambda: f'"{word()}\r\n\r\n{word()}"', lambda: f'{word()}"\n"{word()}', lambda: f'"{word()}""{word()}"', lambda: '"' + word() + ' , "" \n'])() if rng.random() < 0.8 else f'"{word()},{word()}"'


def _file(rng):
    """Rows of three columns whose quotes are closed, in any line ends, with blank lines between."""
    end = lambda: rng.choice(["\n", "\r\n", "\r", "\n\n", "\r\n\n\r"])
    rows = ["name,seq,note"]
    for _ in range(rng.randint(1, 12)):
        fields = [_field(rng) for _ in range(3)]
        rows.append(",".join(f if f.count('"') % 2 == 0 else f + '"' for f in fields))
    return "".join(r + end() for r in rows[:-1]) + rows[-1] + rng.choice(["", "\n", end()])


def _expected(texts):
    raw, error = [], None
    for text in texts:
        try:
            more, error = parse_dsv(text, ",") if text else ([], None)
        except SequenceError as e:
            more, error = [], str(e)
        raw += more
        if error:
            break
    seqs = ["".join(c for c in r.upper() if c not in '\r\n "') for r in raw]
    if not raw and not error:
        return "the file is empty"
    for k, s in enumerate(seqs, 1):
        if not s or any(ord(c) > 127 for c in s) or set(s) - set(AMINO):
            return f"Sequence #{k} is {'empty' if not s else 'corrupted' if any(ord(c) > 127 for c in s) else 'invalid'}"
    return error or (seqs if len(seqs) > 1 else "not enough sequences, at least 2 are needed")


@pytest.fixture
def cut(spark, monkeypatch):
    """Cut files into pieces of so many bytes when their lines are read, and only then."""
    names, lines = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), readers._lines

    def set_size(size):
        def cut_lines(*args):
            before = {n: spark.conf.get(n) for n in names}
            try:
                for n, v in zip(names, (size, 1)):
                    spark.conf.set(n, str(v))
                return lines(*args)
            finally:
                for n, v in before.items():
                    spark.conf.set(n, v)

        monkeypatch.setattr(readers, "_lines", cut_lines)

    return set_size


def _read(spark, path):
    try:
        return [r["seq"] for r in read_sequences(spark, str(path), AMINO).orderBy("ord").collect()]
    except SequenceError as e:
        return str(e)


@pytest.mark.parametrize("size", [3, 17, 10_000])
def test_equal_at_every_cut(spark, tmp_path, cut, size):
    rng = random.Random(size)
    texts = [t for t in (_file(rng) for _ in range(400)) if isinstance(_expected([t, t]), list)][:6]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k, t in enumerate(texts):
        (folder / f"{k:03}.csv").write_bytes(t.encode("latin-1"))
    cut(size)
    assert len(texts) == 6 and _read(spark, folder) == _expected(texts)


ODD = [
    ["", ""], ["\n"], ["name,seq\n"], ["name,seq,\na,b,c\n"], ["name,other\nx,AA\n"], ["seq\nAA\n\nCC"], ["seq,x\nAA,1\nCC\n"], ["seq,x\nAA,1\nCC,2,3\n"], ["x,seq\n1,AA\n2\n3,CC\n"],
    ["seq,x\nAA,1\n", "seq,x\nAA,1\nC\n"], ["seq,x\nAA,1\nBJ,2\nCC\n"], ["seq,x\nAA,1\n\xe9,2\n"], ["seq,x\nAA,1\n\"\",2\n"], ['seq,x\nAA,"1\nCC,2\nDD,3'], ["seq,x\nAA,1\nCC,2,\n"], ["seq,x\nAA,1", "", "seq\nCC"], ["seq,x\n,1\nCC,2\n"], ["\"a\nb\",seq\n1,AA\n2,CC\n"],
]


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_files(spark, tmp_path, cut, k):
    folder = tmp_path / "odd.csv"
    folder.mkdir()
    for n, t in enumerate(ODD[k]):
        (folder / f"{n}.csv").write_bytes(t.encode("latin-1"))
    cut(4)
    assert _read(spark, folder) == _expected(ODD[k])


def test_without_header_and_by_number(spark, tmp_path, cut):
    path = tmp_path / "bare.tsv"
    path.write_text('x\t"A\nC"\n\ny\tGG\n')
    cut(3)
    assert [r["seq"] for r in read_sequences(spark, str(path), AMINO, seq_col=1, header=False).orderBy("ord").collect()] == ["AC", "GG"]
    with pytest.raises(SequenceError, match="there is no column 5"):
        read_sequences(spark, str(path), AMINO, seq_col=5, header=False)
    assert bare('"x"') == "x" and bare('"') == '"'


def test_many_tasks_read_one_file(spark, tmp_path, cut):
    path = tmp_path / "one.csv"
    path.write_text("seq,note\n" + "".join(f'{"ARND"[k % 4] * 5},"n{k}\nmore"\n' for k in range(500)))
    cut(1000)
    assert readers._lines(spark, str(path), "lines").select("_piece").distinct().count() > 5
    assert _read(spark, path) == [c * 5 for c in "ARND" * 125]


def test_lines_of_a_row_are_put_together_where_they_are_read(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("seq,note\n" + "".join(f'{"ARND"[k % 4] * 5},"n{k}\nmore"\n\n' for k in range(500)))
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rows = readers._lines(spark, str(path), "rows").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(r["_k"] for r in rows) == list(range(1, 502))
    assert _read(spark, path) == [c * 5 for c in "ARND" * 125]


def test_only_rows_that_pieces_cut_meet_again(spark, tmp_path, cut, monkeypatch):
    path, met = tmp_path / "one.csv", []
    path.write_text("seq,note\n" + "".join(f'{"ARND"[k % 4] * 5},"n{k}\nmore"\n' for k in range(500)))
    cut(1000)
    sent = readers._sent
    monkeypatch.setattr(readers, "_sent", lambda small, name: met.append((name, small.count())) or sent(small, name))
    assert _read(spark, path) == [c * 5 for c in "ARND" * 125]
    sizes = dict(met)
    assert 0 < sizes["cut"] <= sizes["pieces"] < 20
