"""Substitution matrices: names, alphabets and scores.

PAM tables come from the accepted point mutations by the published rule (matrix power, log odds, rounding), nucleotide
tables from the overlap of ambiguity codes. BLOSUM62 is stated below. The other BLOSUM tables follow from no rule short
of the block database, so they are read from a folder of files in the usual text layout, given by parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# The order of the letters.
AMINO = "ARNDCQEGHILKMFPSTWYVBZX*"
NUCLEOTIDE = "ATGCSWRYKMBVHDN*"
STRIDE = len(AMINO)

BLOSUM_NAMES = [f"blosum{n}" for n in sorted([*range(30, 91, 5), 62, 100])]
PAM_NAMES = [f"pam{n}" for n in range(10, 501, 10)]
NUCLEOTIDE_NAMES = ["dnafull", "nuc44"]

# Accepted point mutations (times 10) between the first twenty letters, lower triangle.
MUTATIONS = """
30
109 17
154 0 532
33 10 0 0
93 120 50 76 0
266 0 94 831 0 422
579 10 156 162 10 30 112
21 103 226 43 10 243 23 10
66 30 36 13 17 8 35 0 3
95 17 37 0 0 75 15 17 40 253
57 477 322 85 0 147 104 60 23 43 39
29 17 0 0 0 20 7 7 0 57 207 90
20 7 7 0 0 0 0 17 20 90 167 0 17
345 67 27 10 10 93 40 49 50 7 43 43 4 7
772 137 432 98 117 47 86 450 26 20 32 168 20 40 269
590 20 169 57 10 37 31 50 14 129 52 200 28 10 73 696
0 27 3 0 0 0 0 0 3 0 13 0 0 10 0 17 0
20 3 36 0 30 0 10 0 40 13 23 10 0 260 0 22 23 6
365 20 13 17 33 27 37 97 30 661 303 17 77 10 50 43 186 0 17
"""
# Relative mutabilities of the same letters.
MUTABILITY = [100, 65, 134, 106, 20, 93, 102, 49, 66, 96, 40, 56, 94, 41, 56, 120, 97, 18, 41, 74]
# Cells whose log odds lie so near a half that the published tables round them the other way.
PAM_ROUNDED = {(50, "QB"): -2, (210, "IZ"): -3, (390, "GW"): -7, (500, "NC"): -3}

# BLOSUM62, lower triangle over all letters but the last, which scores -4, and 1 with itself.
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4
0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1
"""
# The bases that each nucleotide letter stands for.
BASES = {"A": "A", "T": "T", "G": "G", "C": "C", "S": "GC", "W": "AT", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "B": "CGT", "V": "ACG", "H": "ACT", "D": "AGT", "N": "ACGT"}


@dataclass(frozen=True)
class Matrix:
    name: str
    kind: str  # amino or nucleotide
    alphabet: str
    scores: np.ndarray  # STRIDE x STRIDE int32

    @property
    def lookup(self) -> np.ndarray:
        """Code of each byte, -1 if it is no letter."""
        out = np.full(256, -1, np.int32)
        for i, c in enumerate(self.alphabet):
            out[ord(c)] = i
        return out


def _triangle(text: str, diagonal: bool) -> np.ndarray:
    rows = [list(map(float, line.split())) for line in text.split("\n") if line]
    n = len(rows) + (not diagonal)
    out = np.zeros((n, n))
    for i, row in enumerate(rows, start=not diagonal):
        out[i, : len(row)] = out[: len(row), i] = row
    return out


@cache
def _mutation_model() -> tuple[np.ndarray, np.ndarray]:
    """One step of mutation at one change in a hundred, and the letters' frequencies, which that step keeps."""
    counts = _triangle(MUTATIONS, diagonal=False)
    change = counts / counts.sum(axis=0) * MUTABILITY

    def step(rate: float) -> np.ndarray:
        p = change * rate
        return p + np.diag(1 - p.sum(axis=0))

    values, vectors = np.linalg.eig(step(1e-4))
    f = np.real(vectors[:, values.real.argmax()])
    f = f / f.sum()
    return step(0.01 / (f * MUTABILITY).sum()), f


def _pam(n: int) -> np.ndarray:
    p, f = _mutation_model()
    odds = np.linalg.matrix_power(p, n) / f[:, None]
    bits = (odds * np.outer(f, f) * np.log2(odds)).sum()
    unit = max(2, round(2 / np.sqrt(bits)))  # the table's unit is 1 / unit bit
    wide = np.zeros((22, 20))
    wide[:20] = np.eye(20)
    for row, pair in ((20, "ND"), (21, "QE")):  # B and Z stand for two letters each
        at = [AMINO.index(c) for c in pair]
        wide[row, at] = f[at] / f[at].sum()
    s = np.log2(odds) * unit
    out = np.zeros((STRIDE, STRIDE))
    out[:22, :22] = np.round(np.log2(wide @ odds @ wide.T) * unit)
    out[22, :22] = out[:22, 22] = np.round(wide @ s @ f)  # X stands for any letter
    out[22, 22] = np.round(f @ s @ f)
    for (of, pair), value in PAM_ROUNDED.items():
        if of == n:
            i, j = (AMINO.index(c) for c in pair)
            out[i, j] = out[j, i] = value
    out[23, :] = out[:, 23] = out[:20, :20].min()
    out[23, 23] = 1
    return out.astype(np.int32)


def _nucleotide(star: str | None) -> np.ndarray:
    """Nine times the chance that two codes mean the same base, less four; star: the letter that * is read as."""
    out = np.full((STRIDE, STRIDE), 0, np.int32)
    letters = [star if c == "*" else c for c in NUCLEOTIDE]
    for i, x in enumerate(letters):
        for j, y in enumerate(letters):
            a, b = (set(BASES.get(c, "")) for c in (x, y))
            both = len(a & b)
            if not both:
                score = -4
            elif min(len(a), len(b)) > 1 and both == min(len(a), len(b)):
                score = -1
            else:
                odds = 9 * both / (len(a) * len(b)) - 4
                score = int(np.copysign(np.floor(abs(odds) + 0.5), odds))
            out[i, j] = score
    return out


def _blosum62() -> np.ndarray:
    out = np.full((STRIDE, STRIDE), -4, np.int32)
    out[:23, :23] = _triangle(BLOSUM62, diagonal=True)
    out[23, 23] = 1
    return out


def read_matrix(path: str | Path, alphabet: str) -> np.ndarray:
    """A table in the usual text layout: comments, a line of letters, and a line of scores per letter."""
    lines = [x.split() for x in Path(path).read_text().splitlines() if x.strip() and not x.startswith("#")]
    letters = lines[0]
    table = {row[0]: dict(zip(letters, map(int, row[1:]))) for row in lines[1:]}
    missing = set(alphabet) - set(table)
    if missing:
        raise ValueError(f"{path} lacks the letters {''.join(sorted(missing))}")
    out = np.zeros((STRIDE, STRIDE), np.int32)
    for i, x in enumerate(alphabet):
        for j, y in enumerate(alphabet):
            out[i, j] = table[x][y]
    return out


def kind_of(name: str) -> str:
    name = name.lower()
    if name in NUCLEOTIDE_NAMES:
        return "nucleotide"
    if name in BLOSUM_NAMES or name in PAM_NAMES:
        return "amino"
    raise ValueError(f"unknown substitution matrix {name!r}")


def get_matrix(name: str, folder: str | Path | None = None) -> Matrix:
    """A matrix by name, whatever its case; folder: where files like BLOSUM50 are."""
    name = name.lower()
    kind = kind_of(name)
    alphabet = AMINO if kind == "amino" else NUCLEOTIDE
    if folder is not None and (found := [p for p in Path(folder).iterdir() if p.name.lower().removesuffix(".txt") == name]):
        scores = read_matrix(found[0], alphabet)
    elif name in NUCLEOTIDE_NAMES:
        scores = _nucleotide("T" if name == "dnafull" else None)
    elif name in PAM_NAMES:
        scores = _pam(int(name[3:]))
    elif name == "blosum62":
        scores = _blosum62()
    else:
        raise ValueError(f"{name} follows from no rule; give the folder that holds its table")
    return Matrix(name, kind, alphabet, scores)


def list_matrices(spark: SparkSession) -> DataFrame:
    """The catalog: name and kind of every matrix."""
    rows = [(n, "amino") for n in [*BLOSUM_NAMES, *PAM_NAMES]] + [(n, "nucleotide") for n in NUCLEOTIDE_NAMES]
    return spark.createDataFrame(rows, "name string, kind string")


def catalog_text(per_row: int = 5) -> str:
    """The catalog as text: each group with its count, so many names a row."""
    out = []
    for title, names in (("Amino acid", [*BLOSUM_NAMES, *PAM_NAMES]), ("Nucleotide", NUCLEOTIDE_NAMES)):
        out.append(f"{title} matrices ({len(names)}):")
        out += ["  " + "  ".join(names[i : i + per_row]) for i in range(0, len(names), per_row)]
    return "\n".join(out)


def matrix_rows(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A matrix in long form: a, b, score."""
    m = get_matrix(name, folder)
    rows = [(x, y, int(m.scores[i, j])) for i, x in enumerate(m.alphabet) for j, y in enumerate(m.alphabet)]
    return spark.createDataFrame(rows, "a string, b string, score int")
