"""Hard-negative mining with a pivot table.

Vectors are whole numbers, floor(scale * x). One more coordinate, the root of (greatest squared length less the vector's
own), puts them all on a sphere, so that an anchor (with 0 there) has the inner product s with a vector at the distance d
where d * d = |anchor|^2 + greatest squared length - 2 s. The table stores every vector's distances to a few pivots. By
the triangle inequality the anchor's own distances to the pivots then bracket d, hence s, for a whole block of vectors
(whose least and greatest distances are known) and for each vector in it. Only what can fall into a wanted range of scores
is multiplied out, exactly.

A search asks, for each anchor and each of its ranges of scores, for the first k vectors of its own label or of others.
Blocks hold vectors with the same nearest two pivots, split by hash to a bounded size. A first pass visits the block of
the anchor's own vector; the k-th score found there raises the range's lower end for the second pass over all blocks that
the bracket leaves. An anchor is sent to those blocks only; a task holds one block and reads its anchors in batches, so
memory does not follow the number of anchors, and no pair but those kept leaves a task. The contract's anchors are a share
of all rows, so work is quadratic where brackets exclude little, as for vectors without clusters.

Pivots are taken from a sample of SAMPLE rows by hash, farthest first; they bear on speed only, results are exact.

Cases: rows without id, label or vector, or with a null or non-finite component (before or after scaling) take no part;
empty vectors have the inner product 0 with all; of two vectors of different length the common places count; repeated
rows (equal id, label and vector) are one; rows that share an id only are told apart, and none is its own positive; equal
scores go by id; ranges with nothing in them give no rows; an empty table gives an empty result; further columns are not
read. Sums beyond 2^53 are made in whole numbers of any size, and scores beyond 64 bits are cut to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillweave.llm.common import saved, table, thinned

#: Rows from which pivots are chosen.
SAMPLE = 2000
#: Largest number of blocks whose ranges are sent to all tasks (some 200 bytes each); beyond it they are joined by shuffle.
SENT_BLOCKS = 1 << 15
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class PivotPlan:
    pivots: int = 8
    block: int = 8192  # vectors of a block, about
    chunk: int = 256  # anchors that a task compares with its block at once
    positives: int = 5
    negatives: int = 5
    share: tuple[int, int] = (80, 100)  # a negative scores at least this share of the positive
    seed: int = 13


@dataclass(frozen=True)
class Pivots:
    """Pivots with their last coordinate, and the greatest squared length."""

    at: np.ndarray
    last: np.ndarray
    most: float

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of vectors on the sphere to the pivots."""
        size = (x * x).sum(axis=1)
        apart = size[:, None] + (self.at * self.at).sum(axis=1) - 2 * x @ self.at.T
        own = np.sqrt(np.maximum(self.most - size, 0))
        return np.sqrt(np.maximum(apart + (own[:, None] - self.last) ** 2, 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        """The same of vectors with 0 as their last coordinate."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.most - 2 * q @ self.at.T, 0))


def _matrix(vectors, width: int | None = None) -> np.ndarray:
    """Rows of numbers, short ones filled up with 0, cut to a width if one is given."""
    vectors = [np.frombuffer(v) if isinstance(v, bytes) else np.asarray(v, float) for v in vectors]
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0) if width is None else width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v[: len(row)]
    return out


def pivots_of(rows: DataFrame, plan: PivotPlan) -> Pivots:
    """Pivots farthest first from a sample by hash; rows: rid and v (numbers as an array)."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.max(F.size("v")).alias("width")).first()
    some = thinned(rows, F.col("rid"), facts["n"], SAMPLE).orderBy("rid").limit(SAMPLE).select("v").collect() if facts["n"] else []
    x = _matrix([r["v"] for r in some], facts["width"] or 0)
    most = float(facts["most"] or 0)
    last = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))
    x = np.column_stack([x, last])
    chosen, gap = [], np.full(len(x), np.inf)
    for _ in range(min(plan.pivots, len(x))):
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return Pivots(x[chosen, :-1], x[chosen, -1], most)


def pivot_table(rows: DataFrame, plan: PivotPlan) -> tuple[DataFrame, Pivots]:
    """rid, id, label, v (as bytes), d (distances to the pivots), q (the same as an anchor), size (squared length) and block."""
    pivots = pivots_of(rows, plan)
    width = pivots.at.shape[1]

    def measure(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            d = pivots.of_rows(x)
            near = np.argsort(d, axis=1, kind="stable")[:, :2]
            cell = near[:, 0] * plan.pivots + near[:, -1]
            yield pdf.assign(v=[np.asarray(v, float).tobytes() for v in pdf["v"]], d=list(d), q=list(pivots.of_anchors(x)), size=(x * x).sum(axis=1), cell=cell)

    kept = "rid long, id long, label long, v binary, d array<double>, q array<double>, size double"
    out = saved(rows.select("rid", "id", "label", "v").mapInPandas(measure, f"{kept}, cell long"), "pivot-cells")
    cells = {r["cell"]: -(-r["count"] // plan.block) for r in out.groupBy("cell").count().collect()}  # pivots^2 rows at most
    first = dict(zip(cells, np.cumsum([0, *cells.values()]).tolist()))
    of = lambda values: F.coalesce(F.create_map(*[F.lit(x).cast("long") for pair in values.items() for x in pair])[F.col("cell")], F.lit(0)) if values else F.lit(0)
    return out.withColumn("block", of(first) + F.pmod(F.col("rid"), F.greatest(of(cells), F.lit(1)))).drop("cell"), pivots


def _products(x: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """x @ q in whole numbers; small: no partial sum is beyond 2^53."""
    if small:
        return (x @ q).astype(np.int64)
    whole = [int(b) for b in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), LEAST), MOST) for row in x], np.int64)


def _first(score: np.ndarray, ids: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, id and row (~score falls as score rises, at the ends of 64 bits, too)."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((rid[near], ids[near], ~score[near]))[:k]]
    return np.lexsort((rid, ids, ~score))[:k]


def search(anchors: DataFrame, rows: DataFrame, pivots: Pivots, same: bool, k: int, plan: PivotPlan) -> DataFrame:
    """rid, range, found (rid), id, score: the first k rows of each range by score, then id.

    anchors: rid, label, v, q, size, block and ranges (number, lo, hi, both ends included); rows: the pivot table. same:
    rows of the anchor's label but itself, else of other labels.
    """
    seeds = saved(_visited(anchors.withColumn("to", F.col("block")), rows, same, k, plan, pivots.most), "pivot-seeds")
    ranked = Window.partitionBy("rid", "range").orderBy(F.desc("score"), "id", "found")
    kth = seeds.withColumn("n", F.row_number().over(ranked)).where(F.col("n") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("range", "score"))).alias("kth"))  # a row per range
    raised = F.transform("ranges", lambda r: F.struct(r["number"].alias("number"), F.greatest(r["lo"], F.col("kth")[r["number"]]).alias("lo"), r["hi"].alias("hi")))
    anchors = saved(anchors.join(kth, "rid", "left").withColumn("ranges", raised).drop("kth"), "pivot-anchors", seeds)
    n = len(pivots.at)
    spans = saved(rows.groupBy("block").agg(F.array(*[F.min(F.col("d")[p]) for p in range(n)]).alias("low"), F.array(*[F.max(F.col("d")[p]) for p in range(n)]).alias("high")), "pivot-spans")
    top = (rows.agg(F.max("block")).first()[0] or 0) + 1
    ends = anchors.select("rid", "q", "size", F.array_min(F.transform("ranges", lambda r: r["lo"])).alias("lo"), F.array_max(F.transform("ranges", lambda r: r["hi"])).alias("hi"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top - 1).cast("long"))).alias("block"))
    met = ends.join(F.broadcast(spans) if top <= SENT_BLOCKS else spans, "block")
    sphere = F.col("size") + F.lit(pivots.most)
    slack = 1 + 1e-9 * sphere
    nearest = F.array_max(F.transform(F.arrays_zip("q", "low", "high"), lambda z: F.greatest(z["low"] - z["q"], z["q"] - z["high"], F.lit(0.0))))
    farthest = F.array_min(F.transform(F.arrays_zip("q", "high"), lambda z: z["q"] + z["high"]))
    above, below = (sphere - nearest * nearest) / 2 + slack, (sphere - farthest * farthest) / 2 - slack
    # written so that distances which are no numbers exclude nothing, nor do ends to which scores are cut
    met = met.where(~((above < F.col("lo")) & ~F.isnan(above) & (F.col("lo") > LEAST)) & ~((below > F.col("hi")) & ~F.isnan(below) & (F.col("hi") < MOST))).select("rid", F.col("block").alias("to"))
    found = _visited(anchors.join(met, "rid"), rows, same, k, plan, pivots.most)
    found = saved(found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n"), "pivot-found", anchors, spans)
    return found


def _visited(anchors: DataFrame, rows: DataFrame, same: bool, k: int, plan: PivotPlan, most: float) -> DataFrame:
    """The first k of each range in each block (column to) that an anchor is sent to."""
    empty = "array<struct<number:int,lo:long,hi:long>>"
    sent = anchors.select("to", F.lit(1).alias("kind"), "rid", F.lit(None).cast("long").alias("id"), "label", "v", F.col("q").alias("d"), "size", "ranges")
    held = rows.select(F.col("block").alias("to"), F.lit(0).alias("kind"), "rid", "id", "label", "v", "d", "size", F.lit(None).cast(empty).alias("ranges"))

    def compare(block: dict, pdf: pd.DataFrame):
        out = []
        x, d = block["x"], block["d"]
        for lo in range(0, len(pdf), plan.chunk):
            part = pdf.iloc[lo : lo + plan.chunk]
            q, ranges = _matrix(part["v"], x.shape[1]), part["ranges"].tolist()
            low, high = (np.array([f(r[end] for r in rs) for rs in ranges], float) for f, end in ((min, "lo"), (max, "hi")))
            low[low <= LEAST], high[high >= MOST] = -np.inf, np.inf  # as scores are cut to 64 bits
            size, own = part["size"].to_numpy(), np.stack(part["d"].to_numpy())
            near, far = np.zeros((len(q), len(x))), np.full((len(q), len(x)), np.inf)
            for p in range(own.shape[1]):
                np.maximum(near, np.abs(own[:, p, None] - d[:, p]), out=near)
                np.minimum(far, own[:, p, None] + d[:, p], out=far)
            sphere = (size + most)[:, None]
            slack = 1 + 1e-9 * sphere
            with np.errstate(invalid="ignore", over="ignore"):
                hit = ~((sphere - near * near) / 2 + slack < low[:, None]) & ~((sphere - far * far) / 2 - slack > high[:, None])
            equal = block["label"] == part["label"].to_numpy()[:, None]
            hit &= equal & (block["rid"] != part["rid"].to_numpy()[:, None]) if same else ~equal
            for i, rid in enumerate(part["rid"]):
                at = np.flatnonzero(hit[i])
                if not len(at):
                    continue
                score = _products(x[at], q[i], np.sqrt(size[i]) * block["longest"] < 2**53)
                for r in ranges[i]:
                    inside = np.flatnonzero((score >= r["lo"]) & (score <= r["hi"]))
                    if len(inside):
                        inside = inside[_first(score[inside], block["id"][at[inside]], block["rid"][at[inside]], k)]
                        out += [(rid, r["number"], f, i_, s) for f, i_, s in zip(block["rid"][at[inside]], block["id"][at[inside]], score[inside])]
        return pd.DataFrame(out, columns=["rid", "range", "found", "id", "score"])

    def run(batches):
        """A block's rows come before its anchors, which are compared batch by batch."""
        now, parts, block = None, [], None
        for pdf in batches:
            for to, own in pdf.groupby("to", sort=True):
                if to != now:
                    now, parts, block = to, [], None
                mine = own[own["kind"] == 0]
                if len(mine):
                    parts.append(mine)
                come = own[own["kind"] == 1]
                if len(come) and parts:
                    whole = pd.concat(parts)
                    x = _matrix(whole["v"])
                    block = {"x": x, "d": np.stack(whole["d"].to_numpy()), "longest": float(np.sqrt(whole["size"].max()))} | {c: whole[c].to_numpy(np.int64) for c in ("rid", "id", "label")}
                    parts = []
                if len(come) and block is not None:
                    yield compare(block, come)

    schema = "rid long, range int, found long, id long, score long"
    return held.union(sent).repartition("to").sortWithinPartitions("to", "kind").mapInPandas(run, schema)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, plan: PivotPlan = PivotPlan()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchor: which rows of id are anchors."""
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * scale)
    fine = F.forall(whole, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), _floor(whole).alias("v")).dropna()
    rows = saved(rows.dropDuplicates().withColumn("rid", F.xxhash64("id", "label", "v")), "pivot-rows")
    held, pivots = pivot_table(rows, plan)
    held = saved(held, "pivot-table", rows)
    anchors = held.where(anchor).select("rid", "id", "label", "v", "q", "size", "block")
    span = lambda number, lo, hi: F.struct(number.cast("int").alias("number"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    found = search(anchors.withColumn("ranges", F.array(span(F.lit(0), F.lit(LEAST), F.lit(MOST)))), held, pivots, True, plan.positives, plan)
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "id", "found")
    positives = saved(found.select("rid", (F.row_number().over(order) - 1).cast("int").alias("range"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "pivot-positives", found)
    part, all_ = plan.share
    score = F.col("positive_score").cast("decimal(38,0)")
    least = F.ceil(score * part / all_).cast("long")
    ranges = positives.where(F.col("positive_score") >= 0).groupBy("rid").agg(F.collect_list(span(F.col("range"), least, F.col("positive_score"))).alias("ranges"))  # one per positive
    found = search(anchors.join(ranges, "rid"), held, pivots, False, plan.negatives, plan)
    order = Window.partitionBy("rid", "range").orderBy(F.desc("score"), "id", "found")
    found = found.select("rid", "range", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.row_number().over(order).cast("int").alias("rank"))
    named = anchors.select("rid", F.col("id").alias("anchor_id"))
    return found.join(positives, ["rid", "range"]).join(named, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor(whole: Column) -> Column:
    """floor() of a double as a double, also beyond 64 bits, where all doubles are whole."""
    return F.transform(whole, lambda x: F.when(F.abs(x) < float(2**53), F.floor(x).cast("double")).otherwise(x))


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


ORACLE = """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as s from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b as positive_id, s as ps from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a as anchor_id, positive_id, s.b as negative_id, ps as positive_score, s.s as negative_score, cast(row_number() over (partition by p.a, positive_id order by s.s desc, s.b) as integer) as rank
  from p join s on p.a = s.a where not same and 80 * ps <= 100 * s.s and s.s <= ps)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""
