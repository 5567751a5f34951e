"""Jaccard join on word n-grams by chosen paths.

Texts with equal shingle sets are one set with a count. Every set has a signature of min-hashes, that is a sample of
tokens shared in proportion to similarity. In each of several runs, all sets start in one bucket. A bucket samples
several positions, and for each of them its sets go to a bucket for every value there, so that sets which share the
sampled tokens stay together; buckets of few sets end, and so do those that splitting would not part, while others are
split again. As every node branches, a pair at the least similarity shares a path with a chance that stays above zero
however deep buckets split (0.94 at 0.8 with two branches); the number of runs follows from the target recall.

Within a bucket all pairs of signatures are compared; those that agree in enough positions are candidates, and only sets
with candidates have their shingles sent to the bucket, where pairs are verified by exact Jaccard similarity. A pair
that meets in several buckets counts in the one of least key, which both know from their own lists of buckets. Buckets
beyond a block's size are dealt as pairs of blocks; results are counts and spanning links, never the pairs themselves,
and components are those of verified links.

Cases: texts of 1 to n - 1 words have one shingle, all their words; null texts and texts without words have none, link
with nothing and are their own component; repeated rows are documents that link with each other; ties have no part in
the result; a null doc_id takes part but is never a component's name unless no member has one; very long texts are taken
whole, and buckets with many shingles are cut into more blocks; an empty table gives an empty result; only the id and
text columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import chunks, joined, saved, table, tidy
from quillweave.llm.components import connected_components


@dataclass(frozen=True)
class JoinPlan:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999
    positions: int = 64  # min-hashes of a signature
    branches: int = 2  # sampled positions that a node splits on
    bucket: int = 128  # sets of a bucket that is compared as a whole
    alike: float = 0.5  # chance that two sets of a bucket stay together, beyond which it is compared as a whole
    block: int = 1024  # sets of a block, for larger buckets
    shingles: int = 1 << 21  # shingles of a block, about
    seed: int = 11

    @property
    def runs(self) -> int:
        """Runs after which a pair of the least similarity has met with the target recall, however deep its buckets split."""
        return _runs(self)

    @property
    def agree(self) -> float:
        """Share of positions that candidates agree in: four deviations below the similarity."""
        return self.similarity - 4 * math.sqrt(self.similarity * (1 - self.similarity) / self.positions)


def meeting(share: np.ndarray, branches: int) -> np.ndarray:
    """Chance that a pair which agrees in this share of the positions shares a path of any length in a run.

    At each node every branch keeps the pair with that chance: p = 1 - (1 - share * p) ** branches.
    """
    p = np.ones_like(share)
    for _ in range(10_000):
        p = 1 - (1 - share * p) ** branches
    return p


def recall_of(plan: JoinPlan, runs: int) -> float:
    """Chance that a pair of the least similarity agrees in enough positions and meets in one of the runs.

    The runs are independent only given the positions in which the pair agrees, which all of them share.
    """
    m = np.arange(math.ceil(plan.agree * plan.positions), plan.positions + 1)
    chance = np.array([math.comb(plan.positions, k) * plan.similarity**k * (1 - plan.similarity) ** (plan.positions - k) for k in m.tolist()])
    return float((chance * (1 - (1 - meeting(m / plan.positions, plan.branches)) ** runs)).sum())


@functools.cache
def _runs(plan: JoinPlan) -> int:
    if recall_of(plan, 1 << 40) < plan.recall:
        raise ValueError(f"{plan.positions} positions are too few for a recall of {plan.recall}")
    return next(n for n in itertools.count(1) if recall_of(plan, n) >= plan.recall)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_table: dict[int, np.ndarray] = {}
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _table or len(_table[base]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _table[base] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _table[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of all runs of so many words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    solid = _SOLID[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    first, stop = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)])
    h = _mixed((total[stop] - total[first]) * _powers(_INVERSE, len(raw))[first])
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(31) + h[k : k + len(out)])
    return np.unique(out)


def signature(s: np.ndarray, plan: JoinPlan) -> np.ndarray:
    rng = np.random.default_rng(plan.seed)
    a = rng.integers(1, 2**63, plan.positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(plan.positions, 2**32 - 1, np.uint32)
    for lo in range(0, len(s), 2048):
        out = np.minimum(out, ((s[lo : lo + 2048, None] * a) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def set_name(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def features(docs: DataFrame, plan: JoinPlan, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, name of its shingle set (null if it has none), signature and hash of its text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = 0
            for part in chunks(batch.column(1)):
                names, signs = [], []
                for t in part:
                    s = shingles(t, plan.words)
                    names.append(set_name(s) if len(s) else None)
                    signs.append(signature(s, plan).tobytes() if len(s) else None)
                of = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([of.column(0), pa.array(names, pa.binary()), pa.array(signs, pa.binary()), of.column(2)], ["doc_id", "h", "sig", "text_hash"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, h binary, sig binary, text_hash long")


def split_keys(keys: np.ndarray, sig: np.ndarray, plan: JoinPlan) -> np.ndarray:
    """The children (rows x branches) of nodes: each branch samples a position, and its value names the child."""
    out, taken = [], []
    row = np.arange(len(keys))
    for k in range(plan.branches):
        at = _mixed(keys + np.uint64(k + 1)) % np.uint64(plan.positions - k)
        for other in np.sort(np.array(taken, np.uint64).reshape(len(taken), len(keys)), axis=0):  # sampled without putting back
            at = at + (at >= other).astype(np.uint64)
        taken.append(at)
        value = sig[row, at.astype(np.int64)].astype(np.uint64)
        out.append(_mixed(_mixed(keys + np.uint64(77)) ^ value ^ (at << np.uint64(40))))
    return np.stack(out, axis=1)


def children(nodes: DataFrame, plan: JoinPlan) -> DataFrame:
    """h, key, parent and branch from rows of h, sig and key."""
    fields = ["h", "key", "parent", "branch"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, plan.positions)
            parent = batch.column(2).to_numpy().view(np.uint64)
            keys = split_keys(parent, sig, plan)
            for k in range(plan.branches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, k].view(np.int64)), batch.column(2), pa.array(np.full(len(keys), k, np.int32))], fields)

    return nodes.select("h", "sig", "key").mapInArrow(tidy(run), "h binary, key long, parent long, branch int")


def buckets(sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """h and key of the buckets that splitting ends in, without those of one set.

    A bucket ends if it is small, or if splitting would not part its sets: where two of them stay together with a chance
    of alike or more, they are near copies. Each split therefore leaves parts of at most sqrt(alike * branches) of the
    bucket on average, so that splitting comes to an end by itself, at any size.
    """
    roots = [F.lit(int(k)) for k in _mixed(np.arange(1, plan.runs + 1, dtype=np.uint64) + np.uint64(plan.seed * 1000)).view(np.int64)]
    rest = sets.select("h", "sig", F.explode(F.array(*roots)).alias("key"))
    done, parents = [], None  # parents: the large buckets that rest was made from
    while True:
        made = saved(children(rest, plan), "children")
        sizes = saved(made.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"), F.first("branch").alias("branch")), "bucket-sizes")
        if parents is not None:
            # chance that two sets of a parent stay together, as the mean over its branches
            same = sizes.groupBy("parent").agg((F.sum(F.col("n") * F.col("n")) / plan.branches).alias("both"), (F.sum("n") / plan.branches).alias("all"))
            stay = saved(same.where(F.col("both") >= plan.alike * F.col("all") * F.col("all")).select(F.col("parent").alias("key"), F.col("all").cast("long").alias("n")), "alike")
            total = parents.count()
            done.append(saved(joined(parents, stay, "key", "n", total, "inner").select("h", "key"), "buckets"))
            gone = stay.select(F.col("key").alias("parent"), "n")
            sizes = sizes.join(gone.drop("n"), "parent", "left_anti")
        sizes = sizes.where("n > 1").select("key", "n", F.col("n").alias("size"))
        members = saved(joined(made.select("h", "key"), sizes, "key", "n", made.count(), "inner"), "members", made)
        done.append(members.where(F.col("size") <= plan.bucket).select("h", "key"))
        parents = members.where(F.col("size") > plan.bucket).select("h", "key")
        if parents.isEmpty():
            break
        rest = parents.join(sets.select("h", "sig"), "h")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return saved(out, "leaves")


def tiled(df: DataFrame, blocks: Column) -> DataFrame:
    """Rows of buckets, each with the pairs of blocks (tile) it belongs to and whether it is on the second side."""
    df = df.withColumn("_blocks", blocks.cast("int")).withColumn("_mine", F.pmod(F.xxhash64("h"), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    return df.withColumns({"tile": (low * F.col("_blocks") + high).cast("long"), "side": (F.col("_mine") > F.col("_other")).cast("int"), "alone": F.col("_mine") == F.col("_other")}).drop("_blocks", "_mine", "_other")


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition("key", "tile").sortWithinPartitions("key", "tile")


def grouped(batches, keys: int):
    """Groups of consecutive rows with equal values in the first columns, as lists of columns; rows come sorted."""
    held: list = []

    def columns(rows):
        return list(zip(*rows))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:keys] != row[:keys]:
                yield columns(held)
                held = []
            held.append(row)
    if held:
        yield columns(held)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the least node of its component under links a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def met_before(key: int, keys: list[bytes]) -> np.ndarray:
    """Which sets of a bucket meet in another of their buckets with a lower key; there the pair is counted."""
    n = len(keys)
    flat = np.frombuffer(b"".join(keys), np.int64)
    of = np.repeat(np.arange(n), [len(k) // 8 for k in keys])
    low = flat < key
    names, at, count = np.unique(flat[low], return_inverse=True, return_counts=True)
    out = np.zeros((n, n), bool)
    use = np.flatnonzero(count > 1)
    column = np.full(len(names), -1)
    column[use] = np.arange(len(use))
    c, row = column[at], of[low]
    for lo in range(0, len(use), 4096):
        hit = (c >= lo) & (c < lo + 4096)
        m = np.zeros((n, min(4096, len(use) - lo)), np.float32)
        m[row[hit], c[hit] - lo] = 1
        out |= m @ m.T > 0
    return out


def candidates(leaves: DataFrame, keys: DataFrame, plan: JoinPlan) -> DataFrame:
    """h and key of the sets whose signatures agree with another's in a bucket that is the first both are in."""
    sizes = saved(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n")), "leaf-sizes")
    rows = joined(leaves, sizes, "key", "n", leaves.count(), "inner").join(keys.select("h", "sig", "keys"), "h")
    rows = dealt(tiled(rows, F.ceil(F.col("size") / plan.block)).select("key", "tile", "side", "alone", "h", "sig", "keys"))
    fields = ["h", "key"]

    def run(batches):
        a, b = [], []
        for key, _, side, alone, h, sig, keys in grouped(batches, 2):
            if len(h) == 1:
                continue
            s = np.frombuffer(b"".join(sig), np.uint32).reshape(len(h), -1)
            side, cross = np.array(side), not alone[0]
            near = np.zeros((len(h), len(h)), bool)
            for i in range(len(h) - 1):
                near[i, i + 1 :] = (s[i + 1 :] == s[i]).mean(axis=1) >= plan.agree
            if cross:
                near &= side[:, None] != side
            if near.any():
                near &= ~met_before(key[0], keys)
                hit = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
                a += [h[i] for i in hit]
                b += [key[0]] * len(hit)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64())], fields)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64())], fields)

    return rows.mapInArrow(tidy(run), "h binary, key long").distinct()


def shingle_sets(docs: DataFrame, named: DataFrame, plan: JoinPlan, id_col: str, text_col: str) -> DataFrame:
    """h, shingles and size of the sets named (h with the doc_id and text hash of one of its rows), each once."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    named = named.select("h", F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash"))
    rows = texts.join(named, texts["doc_id"].eqNullSafe(named["_of"]) & (texts["text_hash"] == named["_hash"])).select("h", "text")

    def run(batches):
        for batch in batches:
            h = iter(batch.column(0).to_pylist())
            for part in chunks(batch.column(1)):
                sets = [shingles(t, plan.words) for t in part]
                names = [next(h) for _ in part]
                same = [k for k, s in enumerate(sets) if set_name(s) == names[k]]  # else the hash of another text is equal
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in same], pa.binary()), pa.array([sets[k].tobytes() for k in same], pa.binary())], ["h", "shingles"])

    return rows.mapInArrow(tidy(run), "h binary, shingles binary").groupBy("h").agg(F.first("shingles").alias("shingles")).withColumn("size", F.octet_length("shingles") / 8)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over the shingles in two sets or more."""
    n = len(sets)
    value, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.full((n, n), float((df == n).sum()), np.float32)
    use = np.flatnonzero((df > 1) & (df < n))
    column = np.full(len(value), -1)
    column[use] = np.arange(len(use))
    c = column[at]
    order = np.argsort(c, kind="stable")
    c, doc = c[order], doc[order]
    for lo in range(0, len(use), 4096):
        p, q = np.searchsorted(c, [lo, lo + 4096])
        m = np.zeros((n, min(4096, len(use) - lo)), np.float32)
        m[doc[p:q], c[p:q] - lo] = 1
        out += m @ m.T
    return out


def verified(members: DataFrame, sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """h, root (the least set linked in the tile) and links (copies of linked sets) from rows of key and h."""
    rows = saved(members.join(sets, "h"), "candidate-sets")  # a set is sent to the buckets in which it has a candidate
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    sizes = saved(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("n") / plan.block, F.col("all") / plan.shingles))).drop("all"), "candidate-sizes")
    rows = joined(rows, sizes, "key", "n", rows.count(), "inner")
    rows = dealt(tiled(rows, F.col("blocks")).select("key", "tile", "side", "alone", "h", "copies", "keys", "shingles"))
    fields = ["h", "root", "links"]
    kinds = (pa.binary(), pa.binary(), pa.int64())

    def run(batches):
        out = []
        for key, _, side, alone, h, copies, keys, found in grouped(batches, 2):
            n = len(h)
            if n < 2:
                continue
            s = [np.frombuffer(x, np.uint64) for x in found]
            size = np.array([len(x) for x in s], np.float64)
            shared = shared_counts(s)
            linked = shared >= plan.similarity * (size[:, None] + size - shared) - 1e-6
            np.fill_diagonal(linked, False)
            if not alone[0]:
                mine = np.array(side)
                linked &= mine[:, None] != mine
            linked &= ~met_before(key[0], keys)
            total = linked @ np.array(copies, np.float64)
            root = spanning(*np.nonzero(linked), n)
            out += [(h[k], h[root[k]], int(total[k])) for k in range(n) if total[k]]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], fields)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], fields)

    return rows.mapInArrow(tidy(run), "h binary, root binary, links long")


def jaccard_join(docs: DataFrame, plan: JoinPlan = JoinPlan(), id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """Per row: doc_id, n_links (other rows linked directly), component_id (least doc_id of its component) and kept.

    With hashed also text_hash (xxhash64), which tells rows of one doc_id but different texts apart.
    """
    rows = saved(features(docs, plan, id_col, text_col), "signatures")
    of = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("of")
    sets = rows.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("copies"), of, F.min("text_hash").alias("any_hash"), F.max("sig").alias("sig"))
    sets = saved(sets.select("h", "copies", "sig", F.col("of.doc_id").alias("doc_id"), F.coalesce("of.text_hash", "any_hash").alias("text_hash")), "sets")
    leaves = buckets(sets, plan)
    own = leaves.groupBy("h").agg(F.collect_list("key").alias("keys"))  # as many as its paths
    keys = saved(_packed(sets.join(own, "h")), "bucket-keys")
    members = saved(candidates(leaves, keys, plan), "candidates")
    named = keys.join(members.select("h").distinct(), "h", "left_semi")
    full = shingle_sets(docs, named, plan, id_col, text_col).join(named.select("h", "copies", "keys"), "h")
    found = saved(verified(members, full, plan), "verified")
    final = saved(connected_components(found.select(F.col("h").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("h"), "root"), "components")
    least = saved(final.join(sets.select("h", "doc_id"), "h").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-names")
    info = (
        sets.select("h", "copies", "doc_id")
        .join(found.groupBy("h").agg(F.sum("links").alias("links")), "h", "left")
        .join(joined(final, least, "root", "n", final.count()).select("h", "component_id"), "h", "left")
        .select("h", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
    out = joined(rows.select("doc_id", "h", "text_hash"), saved(info, "set-facts"), "h", "copies", rows.count())
    component = F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_hash"] if hashed else []))


def _packed(df: DataFrame) -> DataFrame:
    """keys as the bytes of 64-bit integers."""
    names = [c for c in df.columns if c != "keys"]

    def run(batches):
        for batch in batches:
            keys = [np.array(k, np.int64).tobytes() for k in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], [*names, "keys"])

    return df.select(*names, "keys").mapInArrow(tidy(run), ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names) + ", keys binary")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as k from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 5 * c >= 4 * (nx.k + ny.k - c)),
r(x, root) as (select doc_id, doc_id from documents union select l.x, r.root from r join l on l.y = r.x),
c as (select x, min(root) as component_id from r group by 1)
select d.doc_id, (select count(*) from l where l.x = d.doc_id) as n_links, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.x = d.doc_id
"""
