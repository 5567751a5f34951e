"""The whole run: read, filter, score, write; and the sinks."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillweave.operators.matrix import dense_matrix
from quillweave.operators.score import score_all
from quillweave.operators.sequences import stats
from quillweave.operators.similarity_filter import greedy_filter
from quillweave.plans.config import ScoringConfig
from quillweave.plans.store import saved
from quillweave.sources.readers import read_sequences
from quillweave.sources.tiles import write_triangle

Writer = Callable[[DataFrame, DataFrame, str, int, bool], None]
WRITERS: dict[str, Writer] = {}


def register_writer(name: str, writer: Writer) -> None:
    WRITERS[name] = writer


def write_parquet(seqs: DataFrame, scores: DataFrame, path: str, compression: int, overwrite: bool) -> None:
    """sequences (ord, seq) and similarity (ord, scores), both in order of ord; compression 0 to 9, 0 for none."""
    if not 0 <= compression <= 9:
        raise ValueError("compression is a level from 0 to 9")
    mode = "overwrite" if overwrite else "errorifexists"
    options = {"compression": "zstd" if compression else "none", "parquet.compression.codec.zstd.level": str(max(1, compression))}
    seqs.repartitionByRange("ord").sortWithinPartitions("ord").write.mode(mode).options(**options).parquet(f"{path}/sequences")
    dense = dense_matrix(scores, seqs).repartitionByRange("ord").sortWithinPartitions("ord")
    dense.write.mode(mode).options(**options).parquet(f"{path}/similarity")


def write_hdf5(seqs: DataFrame, scores: DataFrame, path: str, compression: int, overwrite: bool) -> None:
    """One file of /sequences and /similarity_matrix, row by row, where h5py is installed."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("writing hdf5 needs h5py; write parquet instead") from e
    n = seqs.count()
    with h5py.File(path, "w" if overwrite else "x") as f:
        names = f.create_dataset("sequences", n, h5py.string_dtype("ascii"))
        for row in seqs.orderBy("ord").toLocalIterator():
            names[row["ord"]] = row["seq"]
        edge = 64
        while edge * 2 <= min(n, 4096):
            edge *= 2
        layout = {"chunks": (edge, edge), "compression": compression or None} if n > 256 else {}
        table = f.create_dataset("similarity_matrix", (n, n), "<i4", **layout)
        for row in dense_matrix(scores, seqs).orderBy("ord").toLocalIterator():
            table[row["ord"]] = row["scores"]


def write_packed(seqs: DataFrame, scores: DataFrame, path: str, compression: int, overwrite: bool) -> None:
    """sequences as Parquet, similarity as a packed triangle, which is read by rows (sources/tiles.py)."""
    if not 0 <= compression <= 9:
        raise ValueError("compression is a level from 0 to 9")
    mode = "overwrite" if overwrite else "errorifexists"
    seqs.repartitionByRange("ord").sortWithinPartitions("ord").write.mode(mode).parquet(f"{path}/sequences")
    write_triangle(scores, seqs.count(), f"{path}/similarity", overwrite, compression)


register_writer("parquet", write_parquet)
register_writer("triangle", write_packed)
register_writer("hdf5", write_hdf5)


@dataclass
class Result:
    sequences: DataFrame
    scores: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def align(spark: SparkSession, input: str | DataFrame, config: ScoringConfig, output: str | None = None, filter_threshold: float | None = None, compression: int = 0, overwrite: bool = False, write: bool = True, format: str = "parquet", **read_options) -> Result:
    """All-against-all scores of a file or a checked sequence set, with seconds per stage."""
    if write and output is None:
        raise ValueError("output is needed unless write is off")
    if not write and output is not None:
        raise ValueError("output and write=False exclude each other")
    took: dict[str, float] = {}

    def timed(name: str, f):
        began = time.perf_counter()
        out = f()
        took[name] = time.perf_counter() - began
        return out

    m = config.load()
    seqs = timed("input", lambda: saved(read_sequences(spark, input, m.alphabet, config.max_length, **read_options) if isinstance(input, str) else input, "sequences"))
    facts, notes = stats(seqs).first(), []
    notes.append(f"Loaded {facts['num']} sequences of {facts['mean_len']:.2f} letters on average")
    if filter_threshold is not None:
        kept = timed("filtering", lambda: saved(greedy_filter(seqs, filter_threshold), "filtered"))
        left = kept.count()
        notes.append(f"Filtered out {facts['num'] - left} sequences")
        seqs = kept
    scores = timed("alignment", lambda: saved(score_all(seqs, config), "scores"))
    if write:
        timed("output", lambda: WRITERS[format](seqs, scores, output, compression, overwrite))
    n = seqs.count()
    took["total"] = sum(took.values())
    notes.append(f"Alignments per second: {n * (n - 1) / 2 / max(took['alignment'], 1e-9):.0f}")
    return Result(seqs, scores, took, notes)
