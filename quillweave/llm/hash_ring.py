"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

A ring has a fixed number of points. Each shard stands at several of them (virtual nodes), each row at one, by a hash of
its id, text and further columns. A row belongs to the next virtual node clockwise whose shard has room: in rounds, each
shard takes the rows that reach it, in order of the ring, until it is full; the others go on clockwise past full shards.
A round with rows left over fills a shard, so there are no more rounds than shards. Loads are bounded by rows: with a load
of 1, shard s of m holds n // m rows, and one more where s < n % m, so that counts are at most one apart; with a load c > 1
a shard holds c * n / m rows at most, rounded up, and fewer rows move when a shard is added.

Rounds work on the number of rows at each point, a table whose size is a parameter; a point's rows are numbered by their
hash, and the outcome of the rounds is a list of runs of these numbers, each with its shard and first slot. So one small
task decides, and rows are touched only to count, to number and to deal them. Repeated rows are one key with a number of
copies, put together before the shuffle, and are dealt in blocks of copies; an id that many rows share does not matter, as
the texts differ. Texts are shuffled once.

Cases: null ids and null columns are values of their own; null and empty texts have size 1; repeated rows are separate rows
with slots of their own; hashes that tie come in order of id, text hash and further columns; a very long text is one row;
an empty table gives an empty result; further columns may have any name and come with their rows. Reruns agree, whatever
the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillweave.llm.common import saved, table

#: What identifies a row: id, 64-bit hash of the text, and that of the further columns.
KEY = ["_k", "_t", "_r"]


@dataclass(frozen=True)
class RingPlan:
    shards: int = 8
    load: float = 1.0  # rows of a shard at most, as a multiple of the mean
    replicas: int = 128  # virtual nodes of a shard
    points: int = 1 << 14  # of the ring; bounds the table that one task works on
    block: int = 1024  # copies of a repeated row that one row stands for while they are dealt
    seed: int = 11


def virtual_nodes(spark: SparkSession, plan: RingPlan) -> DataFrame:
    """at and shard of every virtual node; those of a shard do not depend on how many shards there are."""
    shard, replica = F.expr(f"id div {plan.replicas}").cast("int"), F.pmod("id", F.lit(plan.replicas)).cast("int")
    nodes = spark.range(plan.shards * plan.replicas).select(shard.alias("shard"), replica.alias("replica"))
    return nodes.select(F.pmod(F.xxhash64(F.lit(plan.seed), "shard", "replica"), F.lit(plan.points)).alias("at"), "shard")


def capacities(n: int, plan: RingPlan) -> list[int]:
    """Rows that each shard may hold."""
    if plan.load < 1:
        raise ValueError("the load is 1 or more")
    if plan.load == 1:
        return [n // plan.shards + (s < n % plan.shards) for s in range(plan.shards)]
    return [-int(-plan.load * n // plan.shards)] * plan.shards


def _rounds(counts: DataFrame, plan: RingPlan) -> DataFrame:
    """Runs of numbers at a point: at, lo, hi, shard and base (the slot of lo). counts: at and n, a row per point."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = capacities(total, plan)
    held = [0] * plan.shards
    nodes = saved(virtual_nodes(spark, plan), "ring-nodes")
    waiting, steps = counts.select("at", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")), []
    of_shard = lambda values: F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), F.col("shard") + 1)
    one = F.lit(0).alias("one")
    while True:
        free = nodes.where(of_shard([m - h for m, h in zip(most, held)]) > 0)
        both = free.select(one, "at", F.lit(True).alias("node"), "shard", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
        both = both.union(waiting.select(one, "at", F.lit(False), F.lit(None).cast("int"), "lo", "hi"))
        whole = Window.partitionBy("one")
        # going down the ring, the last node seen is the next one clockwise; beyond the last node it is the first again
        clockwise = F.last("shard", ignorenulls=True).over(whole.orderBy(F.desc("at"), F.desc("node"), F.desc("shard")).rowsBetween(Window.unboundedPreceding, 0))
        first = F.min(F.when(F.col("node"), F.struct("at", "shard"))).over(whole)["shard"]
        step = both.select("*", clockwise.alias("next"), first.alias("first")).where(~F.col("node"))
        step = step.select("one", "at", "lo", "hi", F.coalesce("next", "first").alias("shard"))
        before = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("one", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("hi") - F.col("lo"))
        step = step.withColumn("before", before)
        room = of_shard([m - h for m, h in zip(most, held)]) - F.col("before")
        step = step.withColumn("cut", F.col("lo") + F.least(F.greatest(room, F.lit(0)), F.col("hi") - F.col("lo")))
        step = saved(step.select("at", "lo", "cut", "hi", "shard", (of_shard(held) + F.col("before")).alias("base")), "ring-round")
        steps.append(step)
        for row in step.groupBy("shard").agg(F.sum(F.col("cut") - F.col("lo")).alias("n")).collect():  # a row per shard
            held[row["shard"]] += row["n"]
        if sum(held) == total:
            break
        waiting = step.where("cut < hi").select("at", F.col("cut").alias("lo"), "hi")
    runs = steps[0]
    for step in steps[1:]:
        runs = runs.union(step)
    return saved(runs.where("cut > lo").select("at", "lo", F.col("cut").alias("hi"), "shard", "base"), "ring-runs", nodes, *steps)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: RingPlan = RingPlan()) -> DataFrame:
    """The rows of docs with _shard (from 0) and _slot (from 0 in each shard, without gaps)."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # so that no column clashes with those of the ring
    docs = docs.toDF(*inner)
    of, text = (F.col(inner[names.index(c)]) for c in (id_col, text_col))
    more = [c for c in inner if c not in (inner[names.index(id_col)], inner[names.index(text_col)])]
    plain = [F.col(c).cast("string") if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in docs.dtypes if c in more]
    rest = F.xxhash64(*plain, *[c.isNull() for c in (text, *plain)])  # hashes pass over nulls
    key = [F.coalesce(F.concat(F.lit("="), of.cast("string")), F.lit("")), F.xxhash64(F.coalesce(text, F.lit(""))), rest]
    keyed = docs.select(*[x.alias(k) for x, k in zip(key, KEY)], F.struct(*inner).alias("_row"))
    keys = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    keys = keys.withColumn("h", F.xxhash64(F.lit(plan.seed), *KEY)).withColumn("at", F.pmod("h", F.lit(plan.points)))
    order = Window.partitionBy("at").orderBy("h", *KEY).rowsBetween(Window.unboundedPreceding, 0)
    keys = saved(keys.select(*KEY, "n", "at", (F.sum("n").over(order) - F.col("n")).alias("start")), "ring-keys")
    counts = saved(keys.groupBy("at").agg(F.sum("n").alias("n")), "ring-points")
    runs = _rounds(counts, plan)
    # a row per point, and one more where a shard's last rows or a point's last rows end: bounded by the plan
    lo, hi = F.greatest("start", "lo"), F.least(F.col("start") + F.col("n"), F.col("hi"))
    dealt = keys.join(F.broadcast(runs), "at").where(lo < hi).select(*KEY, "shard", (F.col("base") + lo - F.col("lo")).alias("slot"), (hi - lo).alias("copies"))
    once = keyed.groupBy(*KEY).agg(F.first("_row").alias("_row"))
    rows = saved(once.join(dealt, KEY).select("_row", "shard", "slot", "copies"), "ring-rows", keys, counts, runs)
    few = rows.where(F.col("copies") <= plan.block)
    blocks = rows.where(F.col("copies") > plan.block).withColumn("from", F.explode(F.sequence("slot", F.col("slot") + F.col("copies") - 1, F.lit(plan.block).cast("long"))))
    blocks = blocks.select("_row", "shard", F.col("from").alias("slot"), F.least(F.lit(plan.block), F.col("slot") + F.col("copies") - F.col("from")).alias("copies"))
    every = few.union(blocks.repartition("shard", "slot")).select("_row.*", "shard", F.explode(F.sequence("slot", F.col("slot") + F.col("copies") - 1)).alias("slot"))
    return every.toDF(*names, "_shard", "_slot")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", plan: RingPlan = RingPlan()) -> None:
    """A folder per shard (_shard=0 and on) of Parquet files, rows in order of their slots from file to file."""
    rows = assign(docs, id_col, text_col, plan)
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def size_of(text: Column) -> Column:
    """UTF-8 bytes, and one for the row's end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
