"""Extension: scores of newly arriving sequences against a fixed set, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.operators.score import score_pairs
from quillweave.plans.config import ScoringConfig


def score_stream(new: DataFrame, fixed: DataFrame, config: ScoringConfig, block: int = 512) -> DataFrame:
    """new: a stream of name and seq; fixed: a sequence set. name, ord and score of every pair, batch by batch.

    The fixed set is dealt in blocks, and each new sequence is sent to every block: a join on the block's number, so that
    nothing is broadcast, however large the fixed set.
    """
    blocks = max(1, -(-fixed.count() // block))
    known = fixed.select("ord", F.col("seq").alias("seq_i"), F.pmod(F.col("ord"), F.lit(blocks)).cast("int").alias("_block"))
    sent = new.select("name", F.col("seq").alias("seq_j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return score_pairs(sent.join(known.hint("shuffle_hash"), "_block"), config).select("name", "ord", "score")
