"""Scoring pairs: a set against itself by blocks, given pairs, and SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.functions import sql_kernels
from quillweave.operators.copies import Copies, by_distinct, found_once, worth_it
from quillweave.operators.matrix import dense_matrix, dense_of_copies, dense_texts_of_copies, diagonal, long_matrix, short_rows, which_runs
from quillweave.operators.pairs import all_pairs, block_pairs, tiles
from quillweave.operators.similarity_filter import paired_identity
from quillweave.plans.config import ScoringConfig
from quillweave.sources.tiles import write_coded, write_triangle


def score_all(seqs: DataFrame, config: ScoringConfig, block: int | None = None) -> DataFrame:
    """i, j, score of all pairs i < j; copies are not scored again, unless a block is asked for."""
    if block or not symmetric(config):
        return _by_blocks(seqs, config, block)
    return by_distinct(seqs, lambda once: _by_blocks(once, config), lambda same: score_pairs(same, config).select("i", "j", "score"))


def long_scores(seqs: DataFrame, config: ScoringConfig) -> DataFrame:
    """i, j, score for all i and j; the diagonal is 0. Pairs of copies are turned around list by list."""
    if not symmetric(config) or not worth_it(seqs):
        return long_matrix(_by_blocks(seqs, config), seqs)
    copies, found = _once(seqs, config)
    return copies.pairs(found, both=True).union(diagonal(seqs))


def dense_scores(seqs: DataFrame, config: ScoringConfig) -> DataFrame:
    """ord and scores: one row of the matrix per sequence, of copies from that of the first."""
    if not symmetric(config) or not worth_it(seqs):
        return dense_matrix(_by_blocks(seqs, config), seqs)
    return dense_of_copies(*_once(seqs, config))


def dense_texts(seqs: DataFrame, config: ScoringConfig) -> DataFrame:
    """The same rows as texts, scores apart by a space."""
    if not symmetric(config) or not worth_it(seqs):
        return dense_matrix(_by_blocks(seqs, config), seqs).select("ord", F.array_join("scores", " ").alias("scores"))
    return dense_texts_of_copies(*_once(seqs, config))


def write_scores(seqs: DataFrame, config: ScoringConfig, path: str) -> None:
    """All pair scores of a saved set as a packed triangle. Where there are copies it is coded: a row of scores for each distinct
    sequence, and which of these each ordinal is, so that neither bytes nor time follow the number of pairs."""
    n = seqs.count()
    if not symmetric(config) or not worth_it(seqs):
        return write_triangle(_by_blocks(seqs, config), n, path)
    copies, found = _once(seqs, config)
    write_coded(which_runs(copies), short_rows(copies, found).select(F.col("i").alias("k"), F.col("short").alias("numbers")), n, copies.once.count(), path)


def _once(seqs: DataFrame, config: ScoringConfig) -> tuple[Copies, DataFrame]:
    """The copies of a set, and the scores of its distinct sequences, with themselves where they have copies."""
    copies = Copies(seqs)
    return copies, found_once(copies, lambda once: _by_blocks(once, config), lambda same: score_pairs(same, config).select("i", "j", "score"))


def score_all_sql(seqs: DataFrame, config: ScoringConfig) -> DataFrame:
    """The same by Column expressions alone."""
    tasks = seqs.sparkSession.sparkContext.defaultParallelism
    scored = lambda pairs: score_pairs(pairs, config, "sql").select("i", "j", "score")
    every = lambda once: scored(all_pairs(once).repartition(tasks))
    return by_distinct(seqs, every, scored) if symmetric(config) else every(seqs)


def symmetric(config: ScoringConfig) -> bool:
    """Whether a pair's score is that of the pair turned around; a table from a file need not be so."""
    scores = config.resolved().load().scores
    return bool((scores == scores.T).all())


def _by_blocks(seqs: DataFrame, config: ScoringConfig, block: int | None = None) -> DataFrame:
    """Blocks make even tasks; each scores its pairs in order of length."""
    cfg = config.resolved()
    m, (o, e), kernel = cfg.load(), cfg.gaps, cfg.kernel
    lookup, scores = m.lookup, m.scores

    def of_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        i, j = left["ord"].to_numpy(), right["ord"].to_numpy()
        a, b = np.nonzero(i[:, None] < j)
        x, y = left["seq"].to_numpy(object)[a], right["seq"].to_numpy(object)[b]
        return pd.DataFrame({"i": i[a], "j": j[b], "score": kernel(y, x, lookup, scores, o, e)})

    return block_pairs(seqs, of_blocks, "i int, j int, score int", block)


def score_pairs(pairs: DataFrame, config: ScoringConfig, backend: str = "arrow") -> DataFrame:
    """pairs (with seq_i and seq_j) and their score; backend sql keeps all work in Column expressions."""
    cfg = config.resolved()
    if backend == "arrow":
        return pairs.withColumn("score", _scorer(cfg)("seq_j", "seq_i"))
    if backend != "sql":
        raise ValueError(f"unknown backend {backend!r}")
    if cfg.method not in ("nw", "ga", "sw"):
        raise ValueError(f"{cfg.method} has no SQL backend")
    m, (o, e) = cfg.load(), cfg.gaps
    names = pairs.columns
    coded = pairs.withColumns({"_r": sql_kernels.codes(F.col("seq_i"), m.alphabet), "_c": sql_kernels.codes(F.col("seq_j"), m.alphabet), "_t": sql_kernels.table_of(m)})
    r, c, t = F.col("_r"), F.col("_c"), F.col("_t")
    score = sql_kernels.linear_score(r, c, t, o) if cfg.method == "nw" else sql_kernels.affine_score(r, c, t, o, e, cfg.method == "sw")
    return coded.select(*names, score.alias("score"))


def _scorer(cfg: ScoringConfig):
    m, (o, e), kernel = cfg.load(), cfg.gaps, cfg.kernel
    lookup, scores = m.lookup, m.scores

    @F.pandas_udf("int")
    def scorer(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kernel(a.to_numpy(object), b.to_numpy(object), lookup, scores, o, e))

    return scorer


def register_functions(spark: SparkSession, config: ScoringConfig) -> None:
    """align_score(a, b) under a configuration, and positional_identity(a, b), for SQL."""
    spark.udf.register("align_score", _scorer(config.resolved()))

    @F.pandas_udf("float")
    def identity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(paired_identity(a.tolist(), b.tolist()))

    spark.udf.register("positional_identity", identity)


def register_table_function(spark: SparkSession, config: ScoringConfig, name: str = "align_tiles") -> None:
    """A table function for SQL: i, j, score of the pairs i < j of each tile of a table as tiles() makes it, called as
    align_tiles(table(t) partition by (lo, hi)). A tile's sequences come one by one, its pairs are scored at once."""
    cfg = config.resolved()
    m, (o, e), kernel = cfg.load(), cfg.gaps, cfg.kernel
    lookup, scores = m.lookup, m.scores

    class AlignTiles:
        def __init__(self):
            self.left, self.right = {}, {}

        def eval(self, row):
            for side, block in ((self.left, row["lo"]), (self.right, row["hi"])):
                if row["mine"] == block:
                    side[row["ord"]] = row["seq"]

        def terminate(self):
            pairs = [(i, j) for j in sorted(self.right) for i in sorted(self.left) if i < j]
            if pairs:
                found = kernel([self.right[j] for _, j in pairs], [self.left[i] for i, _ in pairs], lookup, scores, o, e)
                yield from ((i, j, int(x)) for (i, j), x in zip(pairs, found))

    spark.udtf.register(name, F.udtf(AlignTiles, returnType="i int, j int, score int"))


def tiles_view(seqs: DataFrame, name: str, block: int | None = None) -> None:
    """Sequences as a temporary view of tiles, for the table function."""
    tiles(seqs, block)[0].createOrReplaceTempView(name)
