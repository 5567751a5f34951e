"""FASTA as a data source: the same records, wherever ranges are cut."""

import io
import random

import pytest

from quillweave.functions.matrices import NUCLEOTIDE
from quillweave.sources.fasta_source import files_of, read_records, records
from quillweave.sources.readers import read_sequences


def _text(seed):
    rng = random.Random(seed)
    out = b""
    for k in range(rng.randint(0, 8)):
        out += b">" + rng.choice([b"", b"a > b", b"x" * 30, b">>"]) + rng.choice([b"\n", b"\r\n", b"\r"])
        for _ in range(rng.randint(0, 3)):
            out += bytes(rng.choices(b"ACGT", k=rng.randint(0, 12))) + rng.choice([b"\n", b"\r\n", b"", b"\n\n"])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_ranges_give_each_record_once(seed):
    text = _text(seed)
    whole = list(records(io.BytesIO(text), 0, len(text)))
    # by hand: a header runs from the first > of a line to the line's end
    want, lines = [], text.replace(b"\r", b"\n").split(b"\n")
    for line in lines:
        before, mark, header = line.partition(b">")
        if want:
            want[-1][1] += before.decode()
        if mark:
            want.append([header.decode(), ""])
    assert [[h, d] for _, h, d in whole] == want
    for size in (1, 2, 7, 31):
        parts = [r for lo in range(0, len(text), size) for r in records(io.BytesIO(text), lo, min(lo + size, len(text)), chunk=5)]
        assert parts == whole


def test_read_by_format(spark, tmp_path):
    folder = tmp_path / "two.fasta"
    folder.mkdir()
    (folder / "2.fa").write_text(">c\nGG\nTT>d > e\nA")
    (folder / "1.fa").write_text(">a\nAC\n\nGT\n>b\n\nTT\n")
    (folder / "_SUCCESS").write_text("")
    got = read_records(spark, str(folder), 3).orderBy("of").collect()
    assert [(r["file"][-4:], r["header"], r["data"]) for r in got] == [("1.fa", "a", "ACGT"), ("1.fa", "b", "TT"), ("2.fa", "c", "GGTT"), ("2.fa", "d > e", "A")]
    assert [r["data"] for r in got] == [r["seq"] for r in read_sequences(spark, str(folder), NUCLEOTIDE).orderBy("ord").collect()]
    assert read_records(spark, f"file://{folder}", 3).count() == 4
    with pytest.raises(FileNotFoundError):
        files_of(str(folder / "none"))
