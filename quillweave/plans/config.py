"""What to score with: method, matrix and gaps, checked as a whole."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np

from quillweave.functions.kernels import align_scores
from quillweave.functions.matrices import Matrix, get_matrix

MAX_LENGTH = 2**30 - 1


#: Scores of the pairs (cols[p], rows[p]) from the letters' codes, the table, and open and extend as negative numbers.
Kernel = Callable[[Sequence[str], Sequence[str], np.ndarray, np.ndarray, int, int], np.ndarray]


@dataclass(frozen=True)
class Method:
    """A way to score pairs: its kernel, and what it asks of a configuration's gaps."""

    name: str
    kernel: Kernel
    validate: Callable[[ScoringConfig], None]
    aliases: tuple[str, ...] = ()


METHODS: dict[str, Method] = {}


def register_method(method: Method) -> None:
    if not callable(method.kernel) or not callable(method.validate):
        raise ValueError(f"method {method.name!r} needs a kernel and a validator")
    for alias in (method.name, *method.aliases):
        METHODS[alias.lower()] = method


def linear_gap(config: ScoringConfig) -> None:
    if config.gap is None or config.gap_open is not None or config.gap_extend is not None:
        raise ValueError(f"{find_method(config.method).name} takes gap, and neither gap_open nor gap_extend")


def affine_gaps(config: ScoringConfig) -> None:
    if config.gap is not None or config.gap_open is None or config.gap_extend is None:
        raise ValueError(f"{find_method(config.method).name} takes gap_open and gap_extend, and not gap")


def _kernel(method: str) -> Kernel:
    return lambda cols, rows, lookup, scores, o, e: align_scores(cols, rows, lookup, scores, method, o, e)


register_method(Method("nw", _kernel("nw"), linear_gap, ("needleman-wunsch",)))
register_method(Method("ga", _kernel("ga"), affine_gaps, ("gotoh",)))
register_method(Method("sw", _kernel("sw"), affine_gaps, ("smith-waterman",)))


def find_method(name: str) -> Method:
    if name.lower() not in METHODS:
        raise ValueError(f"unknown alignment method {name!r}")
    return METHODS[name.lower()]


@dataclass(frozen=True)
class ScoringConfig:
    """Gaps are entered as they are in commands, zero or more: gap for nw; gap_open and gap_extend for ga and sw.

    A gap of length k costs gap_open + (k - 1) * gap_extend. ga with equal gaps is nw, which is cheaper, unless
    rewrite_equal_affine is off.
    """

    method: str
    matrix: str
    gap: int | None = None
    gap_open: int | None = None
    gap_extend: int | None = None
    rewrite_equal_affine: bool = True
    matrix_folder: str | None = None

    def __post_init__(self) -> None:
        kind = find_method(self.method)
        for name in ("gap", "gap_open", "gap_extend"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or not 0 <= value < 2**31):
                raise ValueError(f"{name} must be an integer from 0 to 2147483647")
        kind.validate(self)

    def resolved(self) -> ScoringConfig:
        """Method by its short name, and ga with equal gaps as nw."""
        name = find_method(self.method).name
        if name == "ga" and self.gap_open == self.gap_extend and self.rewrite_equal_affine:
            return replace(self, method="nw", gap=self.gap_open, gap_open=None, gap_extend=None)
        return replace(self, method=name)

    @property
    def kernel(self) -> Kernel:
        return find_method(self.method).kernel

    @property
    def gaps(self) -> tuple[int, int]:
        """Open and extend as the kernels take them."""
        return (-self.gap, -self.gap) if self.gap is not None else (-(self.gap_open or 0), -(self.gap_extend or 0))

    @property
    def max_length(self) -> int:
        return MAX_LENGTH // self.gap if self.gap else MAX_LENGTH

    def load(self) -> Matrix:
        return get_matrix(self.matrix, self.matrix_folder)
