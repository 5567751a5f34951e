"""The share of equal letters at equal places over the shorter length, in single precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def positional_identity(a: Column, b: Column) -> Column:
    """The share as a Column, for pairs that are at hand."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] == p["y"]))
    return (same / n).cast("float")


def identity_shares(a: list[str], b: list[str]) -> np.ndarray:
    """All pairs' shares, in blocks of places."""
    size = lambda s: np.array([len(x) for x in s])
    na, nb = size(a), size(b)
    width = int(min(na.max(), nb.max()))
    table = lambda s, pad: np.array([list((x[:width] + pad * width)[:width].encode("latin-1")) for x in s], np.uint8)
    x, y = table(a, "\0"), table(b, "\1")
    same = np.zeros((len(a), len(b)), np.int32)
    for k in range(width):
        same += x[:, k, None] == y[:, k]
    return same.astype(np.float32) / np.minimum(na[:, None], nb).astype(np.float32)


#: Letters that all pairs of two lists are compared by before the unlike ones are left out.
FIRST = 192
#: Letters that are compared at once for the pairs that are left.
AT_ONCE = 1 << 24


def near_pairs(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all pairs whose share is at least the threshold, in order. Letters are compared from the start
    on, and a pair is left out as soon as its mismatches so far are too many."""
    limit = np.float32(threshold)
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    width = int(min(na.max(), nb.max()))
    table = lambda s, pad: np.array([list((x[:width] + pad * width)[:width].encode("latin-1")) for x in s], np.uint8).reshape(len(s), width)
    p, q = table(a, "\0"), table(b, "\1")
    at = min(width, FIRST)
    same = np.zeros((len(a), len(b)), np.int32)
    for k in range(at):
        same += p[:, k, None] == q[:, k]
    n = np.minimum(na[:, None], nb)
    x, y = np.nonzero((n - (np.minimum(n, at) - same)).astype(np.float32) / n.astype(np.float32) >= limit)
    n, same = n[x, y], same[x, y]
    while at < width and len(x):
        to = min(width, 2 * at)
        step = max(1, AT_ONCE // (to - at))
        for lo in range(0, len(x), step):
            some = slice(lo, lo + step)
            same[some] += (p[x[some], at:to] == q[y[some], at:to]).sum(axis=1, dtype=np.int32)
        at = to
        left = (n - (np.minimum(n, at) - same)).astype(np.float32) / n.astype(np.float32) >= limit
        x, y, n, same = x[left], y[left], n[left], same[left]
    return x, y


def paired_identity(a: list[str], b: list[str]) -> np.ndarray:
    """The shares of the pairs (a[p], b[p]), all pairs of a length together."""
    n = np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    out = np.zeros(len(a), np.float32)
    for width in np.unique(n[n > 0]):
        at = np.flatnonzero(n == width)
        x, y = ("".join(s[k][:width] for k in at) for s in (a, b))
        same = np.frombuffer(x.encode("utf-32-le"), np.uint32) == np.frombuffer(y.encode("utf-32-le"), np.uint32)
        out[at] = same.reshape(len(at), width).sum(axis=1).astype(np.float32) / np.float32(width)
    return out


def first_apart(seqs: list[str], threshold: float) -> np.ndarray:
    """Which of the sequences stay, taken in order: those that no earlier one which stays is too similar to."""
    limit, n = np.float32(threshold), np.array([len(s) for s in seqs])
    held, size, out = np.zeros((len(seqs), int(n.max(initial=0))), np.uint8), np.zeros(len(seqs), np.int64), np.zeros(len(seqs), bool)
    kept = 0
    for k, s in enumerate(seqs):
        row = np.frombuffer(s.encode("latin-1"), np.uint8)
        least = np.minimum(size[:kept], len(row))
        first = (held[:kept, : min(FIRST, len(row))] == row[:FIRST]).sum(axis=1)  # too many mismatches in these rule most out
        near = np.flatnonzero((least - (np.minimum(least, FIRST) - first)).astype(np.float32) / least.astype(np.float32) >= limit)
        same = (held[near, : len(row)] == row).sum(axis=1)
        if not (same.astype(np.float32) / least[near].astype(np.float32) >= limit).any():
            held[kept, : len(row)], size[kept], out[k] = row, len(row), True
            kept += 1
    return out
