"""The alignment scores as Column expressions, without Python on the executors: for small data and as a cross-check.

Rows of the table are built by aggregate() over the letters of one sequence, cells by aggregate() over the other's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillweave.functions.matrices import STRIDE, Matrix

FLOOR = -(2**30)


def codes(seq: Column, alphabet: str) -> Column:
    """The codes of a sequence's letters, from 0."""
    chars = F.filter(F.split(seq, ""), lambda c: c != "")
    place = F.create_map(*[F.lit(x) for i, c in enumerate(alphabet) for x in (c, i)])
    return F.transform(chars, lambda c: place[c])


def table_of(matrix: Matrix) -> Column:
    return F.array(*[F.lit(int(x)) for x in matrix.scores.ravel()])


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def linear_score(rows: Column, cols: Column, table: Column, gap: int) -> Column:
    """Global score with a linear gap (negative); rows, cols: codes; table: the flat matrix."""
    steps = lambda a: F.sequence(F.lit(1), F.size(a))
    top = F.transform(F.sequence(F.lit(0), F.size(cols)), lambda k: k * gap)

    def row(above: Column, y: Column) -> Column:
        def cell(done: Column, x: Column) -> Column:
            diagonal = above[x - 1] + table[rows[y - 1] * STRIDE + cols[x - 1]]
            return F.array_append(done, F.greatest(diagonal, above[x] + gap, done[x - 1] + gap))

        return F.aggregate(steps(cols), F.array(y * gap), cell)

    return _last(F.aggregate(steps(rows), top, row)).cast("int")


def affine_score(rows: Column, cols: Column, table: Column, gap_open: int, gap_extend: int, local: bool) -> Column:
    """Global or local score with affine gaps (negative). A row is h and g (the gap down), gx the gap along it."""
    steps = lambda a: F.sequence(F.lit(1), F.size(a))
    o, e = gap_open, max(gap_open, gap_extend)
    floor = F.lit(FLOOR)
    if local:
        top = F.transform(F.sequence(F.lit(0), F.size(cols)), lambda k: F.lit(0))
        edge = lambda y: F.lit(0)
    else:
        top = F.transform(F.sequence(F.lit(0), F.size(cols)), lambda k: F.when(k == 0, F.lit(0)).otherwise(o + (k - 1) * e))
        edge = lambda y: o + (y - 1) * e
    pack = lambda h, g, gx, best: F.struct(h.alias("h"), g.alias("g"), gx.alias("gx"), best.alias("best"))
    first = pack(top, F.transform(top, lambda _: floor), floor, F.lit(0))

    def row(above: Column, y: Column) -> Column:
        def cell(w: Column, x: Column) -> Column:
            diagonal = above["h"][x - 1] + table[rows[y - 1] * STRIDE + cols[x - 1]]
            gx = F.greatest(_last(w["h"]) + o, w["gx"] + e)
            g = F.greatest(above["h"][x] + o, above["g"][x] + e)
            h = F.greatest(diagonal, gx, g, F.lit(0)) if local else F.greatest(diagonal, gx, g)
            return pack(F.array_append(w["h"], h), F.array_append(w["g"], g), gx, F.greatest(w["best"], diagonal))

        start = pack(F.array(edge(y)), F.array(floor), floor, above["best"])
        return F.aggregate(steps(cols), start, cell)

    done = F.aggregate(steps(rows), first, row)
    return (done["best"] if local else _last(done["h"])).cast("int")
