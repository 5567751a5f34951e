"""The corpus pipeline: quality, near-duplicates, repeated passages, source weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, and further columns of any name with them.

Cases, for all stages: empty tables give empty results; what a stage does with null doc_ids, null and empty texts and
repeated rows is said at the stage; very long texts are taken whole; ties are settled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm import bpe_automaton, chosen_path, line_crf, mixing, sentence_spans
from quillweave.llm.common import WORD, drop, scratch, table
from quillweave.plans.store import made, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are one empty line, and repeated rows score
    alike; a null doc_id is scored like others."""
    model = line_crf.train(table(spark, sf_dir, "documents"), line_crf.learnable(table(spark, sf_dir, "labels")))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # so that no column clashes with those of the score
    scored = line_crf.score(docs.toDF(*inner), model, text_col=inner[names.index("text")], keep=inner)
    return scored.where(F.col("_score") >= line_crf.THRESHOLD).select(*inner).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the least doc_id; of rows with equal doc_id and equal text one.

    Rows are told apart by doc_id and text, so that rows which share a doc_id (or have none) are judged each by its own
    text. Repeated rows are put together before the shuffle. Rows with neither doc_id nor words all stay, as they link
    with nothing.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # so that columns may have any name
    docs, doc_id, text = docs.toDF(*inner), inner[names.index("doc_id")], inner[names.index("text")]
    stay = chosen_path.jaccard_join(docs, id_col=doc_id, text_col=text, hashed=True).where("kept").select(F.col("doc_id").alias("_stay"), F.col("text_hash").alias("_hash")).distinct()
    bare = F.col(doc_id).isNull() & ~F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    rows = docs.where(~bare).select(F.col(doc_id).alias("_of"), F.xxhash64(text).alias("_text"), F.struct(*inner).alias("_row"), F.xxhash64(*inner).alias("_order"))
    one = rows.groupBy("_of", "_text").agg(F.min_by("_row", "_order").alias("_row"))
    kept = one.join(stay, one["_of"].eqNullSafe(stay["_stay"]) & (one["_text"] == stay["_hash"]), "left_semi")
    return kept.select("_row.*").union(docs.where(bare)).toDF(*names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; those of which nothing is left go. Null texts and rows without a
    doc_id pass as they are; rows with equal doc_id and text stay equal."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]
    out = sentence_spans.dedup(docs.toDF(*inner), id_col=inner[names.index("doc_id")], text_col=text)
    return out.where((F.col("_n_removed") == 0) | (F.col(text) != "")).select(*inner).toDF(*names)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as their source's quota takes them. Null and empty texts are never taken; repeated rows are
    separate; a null source is a source; null doc_ids are dealt by their texts."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes and ids of each row; null and empty texts have no ids."""
    return bpe_automaton.encode(docs, bpe_automaton.word_tokenizer())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("tokens", tokens),
]

#: SQL cannot train and apply the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, since = scratch(spark, f"stage-{name}"), made()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since)
        drop(before) if before is not None else None
        docs = before = spark.read.parquet(path)
        before._saved_at = path
    return docs
