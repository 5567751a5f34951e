"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Sources weigh 5, 2, 1 and so on by code point order (null last) and share all words; a target stops at max_repeats
times its source's words and the excess goes to the others by weight. Words are then dealt in blocks of equal size:
sources get whole blocks by the highest quotients target / (2k + 1), the sections of a source get its blocks in the same
way by their words, and so do the shards of a section, so that no task ranks more than a section's shards or a source's
sections. Each shard takes its documents in a seeded order, whole passes first and then one run of blocks that starts at a
seeded block. A shard is a bounded part of a source, so a source with a third of all rows is spread over many tasks.

Cases: null and empty texts have size 0 and are never taken; a null source is a source of its own and comes last; null
doc_ids are dealt by the hash of the text; repeated rows are separate documents of equal size; quotients that tie go to
the lower source, section or shard; a very long text is cut by blocks like others; an empty table gives an empty result;
only the id, text and source columns are read, so others may have any name. Reruns agree, whatever the partitions, as
order and starts come from hashes of ids, texts and a seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillweave.llm.common import WORD, saved, table

#: Fixed values of the contract: weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[int, ...] = WEIGHTS
    max_repeats: int = 3
    block_words: int = 64
    shard_words: int = 200_000  # words of a shard, about
    section_shards: int = 1000  # shards of a section
    seed: int = 17


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """Per source its words and target, from rows of source and size.

    A target is min(cap, weight * rate) with one rate for all, at which the targets add up to all words: sources in
    order of cap / weight reach their caps one after the other, so running sums give the rate. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (((F.row_number().over(order) - 1) % len(plan.weights)) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * plan.max_repeats).cast("double"))
    all_rows = Window.partitionBy(F.lit(0))
    before = all_rows.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(all_rows).cast("double"),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    rate = (F.col("total") - F.col("capped")) / F.col("open")
    # the first source in that order that stays below its cap sets the rate
    rate = F.min(F.when(F.col("cap") >= rate * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), rate.alias("rate")))).over(all_rows)["rate"]
    return per.withColumn("rate", rate).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("rate"), F.col("cap"))).alias("target"))


def apportion(df: DataFrame, keys: list[str], claim: str, seats: Column, name: str, order: list) -> DataFrame:
    """Add name: the whole seats of each row by Sainte-Lague among the rows with equal keys; ties go by order.

    With n claims, the divisor sum / (seats - n / 2) gives no claim more than its due and leaves at most n seats, and
    sum / (seats + n / 2) shows all quotients that these can come from, 2 n at most; so only those are ranked.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    df = df.withColumn("_id", F.row_number().over(w.orderBy(*order)))
    df = df.withColumns({"_sum": F.sum(claim).over(w), "_n": F.count(F.lit(1)).over(w), "_seats": seats.cast("long")})
    due = lambda seats: F.when((F.col("_sum") > 0) & (seats > 0), F.floor(F.col(claim) / F.col("_sum") * seats + 0.5)).otherwise(F.lit(0)).cast("long")
    df = df.withColumns({"_sure": due(F.col("_seats") - F.col("_n") / 2 - 1e-9), "_most": due(F.col("_seats") + F.col("_n") / 2 + 1e-9) + 1})
    df = df.withColumn("_left", F.col("_seats") - F.sum("_sure").over(w))
    df = df.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
    df = df.withColumn("_rank", F.row_number().over(w.orderBy(F.when(F.col(claim) > 0, F.col(claim) / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0)).desc(), F.col("_id"))))
    out = [c for c in df.columns if not c.startswith("_")]
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col(claim) > 0), 1).otherwise(0))
    df = df.groupBy(*keys, "_id").agg(*[F.first(c).alias(c) for c in out if c not in keys], (F.first("_sure") + won).cast("long").alias(name))
    return df.drop("_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", plan: MixPlan = MixPlan(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken, and the columns to carry."""
    more = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carry)]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("t"), *more)
    slim = saved(sized.select("doc_id", "source", "size", "t"), "mix-sizes")  # texts are read once for these
    sized = sized if carry else slim
    per = targets(slim, plan)
    blocks = lambda words: F.ceil(words / plan.block_words)
    # whole blocks for all words; a source's blocks are its target's share of them
    per = apportion(per, [], "target", F.sum(blocks(F.col("source_size"))).over(Window.partitionBy(F.lit(0))), "source_blocks", [F.col("source").asc_nulls_last()])
    per = per.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / plan.shard_words)).cast("int"))
    per = per.select(F.col("source").alias("of"), "source_size", "target", "source_blocks", "shards")

    def sharded(df: DataFrame, *extra) -> DataFrame:
        shard = F.pmod(F.xxhash64(F.lit(plan.seed), F.col("doc_id"), F.col("t")), F.col("shards"))
        return df.join(per, df["source"].eqNullSafe(per["of"])).select("source", "source_size", "target", "source_blocks", shard.alias("shard"), "size", "t", *extra)

    of_shard = sharded(slim).groupBy("source", "source_blocks", "shard").agg(F.sum("size").cast("long").alias("shard_words"))
    of_shard = saved(of_shard.withColumn("section", F.floor(F.col("shard") / plan.section_shards).cast("int")), "mix-shards")
    of_section = of_shard.groupBy("source", "source_blocks", "section").agg(F.sum("shard_words").cast("double").alias("claim"))
    of_section = apportion(of_section, ["source"], "claim", F.col("source_blocks"), "section_blocks", [F.col("section")])
    of_section = of_section.select(F.col("source").alias("of"), F.col("section").alias("of_section"), "section_blocks")
    of_shard = of_shard.join(of_section, of_shard["source"].eqNullSafe(of_section["of"]) & (of_shard["section"] == of_section["of_section"]))
    of_shard = of_shard.select("source", "section", "section_blocks", "shard", "shard_words", F.col("shard_words").cast("double").alias("claim"))
    of_shard = apportion(of_shard, ["source", "section"], "claim", F.col("section_blocks"), "quota", [F.col("shard")])
    of_shard = of_shard.select(F.col("source").alias("of"), F.col("shard").alias("of_shard"), "shard_words", "quota")
    rows = sharded(sized, "doc_id", *[f"c_{i}" for i in range(len(carry))])
    inside = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(plan.seed + 1), F.col("doc_id"), F.col("t")), "doc_id", "t", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum("size").over(inside))
    rows = rows.join(of_shard, rows["source"].eqNullSafe(of_shard["of"]) & (rows["shard"] == of_shard["of_shard"]))
    return rows.select("doc_id", "size", "source_size", "target", _taken(plan).alias("taken"), *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)])


def _taken(plan: MixPlan) -> Column:
    """Words taken of a row's words [stop - size, stop) in its shard: whole passes and the run of blocks."""
    b, words, quota = F.lit(plan.block_words), F.col("shard_words"), F.col("quota")
    n = F.greatest(F.lit(1), F.ceil(words / b)).cast("long")
    passes = F.least(F.lit(plan.max_repeats).cast("long"), F.floor(quota / n).cast("long"))
    run = F.when(passes < plan.max_repeats, quota - passes * n).otherwise(F.lit(0)).cast("long")
    first = F.pmod(F.xxhash64(F.lit(plan.seed + 2), F.col("source"), F.col("shard")), n)
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(hi, F.col("stop")) - F.greatest(lo, F.col("stop") - F.col("size")))
    straight = overlap(first * b, (first + run) * b)
    around = F.when(first + run > n, overlap(F.lit(0), (first + run - n) * b)).otherwise(F.lit(0))
    return (passes * F.col("size") + straight + around).cast("long")


def take(docs: DataFrame, plan: MixPlan = MixPlan(), source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as often as it was taken, a part of half a text or more as the whole text."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # so that no column of docs clashes with those of the mix
    out = mix(docs, source_col=source_col, plan=plan, carry=tuple(names)).toDF("_id", "_size", "_source_size", "_target", "_taken", *inner)
    copies = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(F.lit(0)).cast("int")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*inner).toDF(*names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
