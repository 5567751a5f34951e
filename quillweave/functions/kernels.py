"""Alignment scores of many pairs at once, one row of the table a step for all pairs.

Within a row, the score of a gap along the row is a running maximum, so a row takes a few array operations: with
h the row's scores without such gaps, x[k] = max over q < k of (h[q] - q * e) + o + (k - 1) * e, where a gap that
is opened again wherever opening costs less than extending gives e = max(o, e). Gaps are negative numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quillweave.functions.matrices import STRIDE

FLOOR = -(2**30)
#: Table cells of one step for all pairs of a batch, at most.
CELLS = 1 << 16


def encode(seqs: Sequence[str], lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, padded with 0, and lengths."""
    size = np.array([len(s) for s in seqs], np.int64)
    out = np.zeros((len(seqs), int(size.max(initial=0))), np.int32)
    flat = lookup[np.frombuffer("".join(seqs).encode("latin-1"), np.uint8)]
    if (flat < 0).any():
        raise ValueError("a sequence holds a letter outside the alphabet")
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def _batch(profile: np.ndarray, which: np.ndarray, nc: np.ndarray, rows: np.ndarray, nr: np.ndarray, o: int, e: int, local: bool) -> np.ndarray:
    """Scores of pairs. profile: per sequence along the row and letter, the scores of its places with that letter; which:
    the sequence of each pair; rows: codes of the sequences down the table."""
    n, width, kind = len(which), profile.shape[2], profile.dtype.type
    flat = profile.reshape(-1, width)
    k = np.arange(width + 1, dtype=kind)
    slope, shift = k * kind(e), kind(o) + k[:-1] * kind(e)
    edge = lambda i: 0 if local else o + (i - 1) * e
    h = np.zeros((n, width + 1), kind)
    if not local:
        h[:, 1:] = o + (k[1:] - 1) * e
    y = np.full((n, width + 1), FLOOR, kind)
    row, gap = np.empty_like(h), np.empty_like(h)
    best = np.zeros(n, kind)
    outside = k[1:] > nc[:, None]
    pairs = np.arange(n)
    out = h[pairs, nc].copy()
    for i in range(1, rows.shape[1] + 1):
        y += kind(e)
        np.add(h, kind(o), out=gap)
        np.maximum(y, gap, out=y)
        row[:, 0] = edge(i)
        np.add(flat[which * STRIDE + rows[:, i - 1]], h[:, :-1], out=row[:, 1:])
        np.maximum(row[:, 1:], y[:, 1:], out=row[:, 1:])
        if local:
            np.maximum(row, 0, out=row)
        np.subtract(row, slope, out=gap)
        np.maximum.accumulate(gap, axis=1, out=gap)
        gap[:, :-1] += shift
        np.maximum(row[:, 1:], gap[:, :-1], out=row[:, 1:])
        h, row = row, h
        if local:
            inside = np.where(outside, 0, h[:, 1:]).max(axis=1, initial=0)
            best = np.where(i <= nr, np.maximum(best, inside), best)
        else:
            last = np.flatnonzero(i == nr)
            out[last] = h[last, nc[last]]
    return best if local else out


def align_scores(cols: Sequence[str], rows: Sequence[str], lookup: np.ndarray, scores: np.ndarray, method: str, gap_open: int, gap_extend: int) -> np.ndarray:
    """Scores of the pairs (cols[p], rows[p]) by nw (gap_open is the linear gap), ga or sw; gaps as negative numbers.

    Pairs go in order of length, so that little is padded, in batches of bounded size.
    """
    if method == "nw":
        gap_extend = gap_open
    e = max(gap_open, gap_extend)
    n = len(cols)
    out = np.zeros(n, np.int64)
    names, at = np.unique(np.array([*cols, *rows], dtype=object), return_inverse=True) if n else ([], np.zeros(0, int))
    if not n:
        return out.astype(np.int32)
    codes, size = encode(list(names), lookup)
    a, b = at[:n], at[n:]
    order = np.lexsort((size[b], size[a]))
    reach = (2 * int(size.max()) + 2) * max(int(np.abs(scores).max()), -gap_open, -e)
    kind = np.int32 if reach < -FLOOR // 2 else np.int64
    s = scores.astype(kind)
    step = max(1, CELLS // (codes.shape[1] + 1))
    for lo in range(0, n, step):
        p = order[lo : lo + step]
        along, which = np.unique(a[p], return_inverse=True)
        z = b[p]
        profile = s[:, codes[along][:, : size[along].max()]].transpose(1, 0, 2).copy()
        out[p] = _batch(profile, which, size[a[p]], codes[z][:, : size[z].max()], size[z], gap_open, e, method == "sw")
    if (np.abs(out) > 2**31 - 1).any():
        raise OverflowError("a score is beyond 32 bits")
    return out.astype(np.int32)
