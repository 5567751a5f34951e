"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook of its own, and the pairs of codes form a grid of cells. Every
vector is indexed in its nearest cell. As a query it visits cells in order of the two halves' summed distances
(multi-sequence order), as many as reach the target recall, and is verified against all vectors in them by the cosine
in double precision. How many cells that takes is measured: vectors of the sample are turned by random directions to
exactly the least cosine, the hardest case, and the place of the turned vector's cell in the visiting order is noted;
a pair is found if either of the two visits the other's cell.

The number of codes follows the number of vectors, so that a cell holds about the same at any size, up to a grid of
codes * codes cells (16 million, a billion vectors); beyond that cells grow. Vectors of each length have a grid of their
own, as only vectors of equal length can link. Codebooks are fitted on a sample of at most sample vectors of a length.

Copies with equal bytes are one vector with a count, so they never meet each other. Neighbouring cells
form bins of about a block of vectors, to which queries are sent once; a cell that is larger, with a third of all rows
perhaps, is dealt in blocks of queries times blocks of indexed vectors over many tasks. Blocks return counts and spanning
links, not pairs, and hold fewer vectors the longer these are.

Cases: null vectors and those that are empty, zero, or with null or non-finite components link with nothing and are their
own component; repeated rows are vectors that link with each other; ties in distance go to the lower cell; a null id takes
part but names no component unless no member has one; very long vectors make smaller blocks; an empty table gives an empty
result; only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import joined, saved, table, thinned, tidy
from quillweave.llm.chosen_path import grouped, spanning
from quillweave.llm.components import connected_components


@dataclass(frozen=True)
class IndexPlan:
    cosine: float = 0.9
    recall: float = 0.98  # one-sided, at the least cosine; both sides together reach more
    sample: int = 65_536  # vectors of a length that codebooks and visits are fitted on, at most
    least_sample: int = 8192  # and at least, if there are so many; else 16 for every code
    cell: int = 64  # vectors of a cell, about
    codes: int = 4096  # codes of a half, at most
    block: int = 1024  # vectors of a block
    doubles: int = 1 << 18  # components of a block, at most
    rounds: int = 12  # of k-means
    seed: int = 5


#: Vectors of the sample that the number of visits is fitted on; the others train the codebooks.
PROBES = 2000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 24) // max(1, len(codes)))
    return np.concatenate([distances(x[lo : lo + step], codes).argmin(axis=1) for lo in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = nearest(x, codes)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return codes


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def k(self) -> int:
        return len(self.first)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return distances(x[:, :h], self.first), distances(x[:, h:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return nearest(x[:, :h], self.first) * self.k + nearest(x[:, h:], self.second)

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of each vector in multi-sequence order.

        The cell of ranks (i, j) comes after all (i + 1)(j + 1) - 1 cells of no greater ranks, so only pairs of ranks with
        (i + 1)(j + 1) <= visits can be among the first visits; these are sorted by their sums.
        """
        i, j = np.array([(i, j) for i in range(min(self.k, visits)) for j in range(min(self.k, visits // (i + 1)))]).T
        step = max(1, (1 << 21) // max(self.k, len(i)))
        if len(x) > step:
            return np.concatenate([self.order(x[lo : lo + step], visits) for lo in range(0, len(x), step)])
        a, b = self.split(x)
        ra, rb = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        row = np.arange(len(x))[:, None]
        total = a[row, ra[:, i]] + b[row, rb[:, j]]
        best = total.argsort(axis=1, kind="stable")[:, :visits]
        return ra[row, i[best]] * self.k + rb[row, j[best]]


def codes_for(n: int, plan: IndexPlan) -> int:
    return int(min(plan.codes, max(1, round(math.sqrt(n / plan.cell)))))


def fit(sample: np.ndarray, n: int, plan: IndexPlan) -> Codebooks:
    """Codebooks and the number of visits, from a sample of unit vectors; n: all vectors of their length."""
    rng = np.random.default_rng(plan.seed)
    k = min(codes_for(n, plan), len(sample))
    h = sample.shape[1] // 2
    if k == 1:
        return Codebooks(sample[:1, :h], sample[:1, h:], 1)
    # vectors lie nearer to codes that they trained than others do, so visits are fitted on vectors held out of that
    apart = rng.permutation(len(sample))
    held = min(PROBES, len(sample) // 4, len(sample) - k)
    probe, rest = sample[apart[:held]], sample[apart[held:]]
    if not held:
        probe = rest
    books = Codebooks(k_means(rest[:, :h], k, plan.rounds, rng), k_means(rest[:, h:], k, plan.rounds, rng), 1)
    turn = rng.normal(size=probe.shape)
    turn -= (turn * probe).sum(axis=1, keepdims=True) * probe
    norm = np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    turned = plan.cosine * probe + math.sqrt(1 - plan.cosine**2) * turn / np.where(norm > 0, norm, 1)
    most = min(k * k, 256)
    while True:
        there, back = (books.order(x, most) == books.home(y)[:, None] for x, y in ((turned, probe), (probe, turned)))
        place = lambda hit: np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most + 1)
        visits = int(np.quantile(np.minimum(place(there), place(back)), plan.recall, method="higher"))
        if visits <= most or most == k * k:
            return Codebooks(books.first, books.second, min(k * k, max(1, visits)))
        most = min(k * k, 4 * most)


def binned(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each cell, with about block vectors in a bin and a larger cell alone in its own; and the blocks of each bin."""
    bins, parts, held = np.zeros(len(sizes), np.int32), [0], 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            parts.append(0)
            held = 0
        bins[cell] = len(parts) - 1
        held += n
        parts[-1] = max(1, -(-held // block))
    return bins, np.maximum(parts, 1)


@dataclass(frozen=True)
class Grid:
    """The codebooks of one length of vectors, and where its cells and bins begin among those of all lengths."""

    books: Codebooks
    cells: int
    block: int


def grids(sets: DataFrame, plan: IndexPlan) -> dict[int, Grid]:
    """One grid per length of vectors; one row per length reaches the driver, and a sample of each that needs codes."""
    out, cells = {}, 0
    counts = sets.groupBy((F.octet_length("h") / 8).cast("int").alias("d")).count().collect()
    for d, n in sorted((r["d"], r["count"]) for r in counts):
        k = codes_for(n, plan)
        sample = min(plan.sample, max(plan.least_sample, 16 * k)) if k > 1 else 1
        of = sets.where(F.octet_length("h") == 8 * d)
        some = thinned(of, F.col("id"), n, sample) if k > 1 else of.limit(1)
        rows = sorted(some.select("id", "h").collect())[:sample]
        books = fit(np.frombuffer(b"".join(r["h"] for r in rows), np.float64).reshape(len(rows), d), n, plan)
        out[d] = Grid(books, cells, int(max(8, min(plan.block, plan.doubles // d))))
        cells += books.k**2
    return out


def near_duplicates(vectors: DataFrame, plan: IndexPlan = IndexPlan(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def packed(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else None
                ok = x is not None and np.isfinite(x).all() and x.any()
                if ok:
                    x = x / np.abs(x).max()  # no overflow in the norm
                    x = x / np.sqrt(x @ x)
                out.append((x + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "h"])

    rows = saved(rows.mapInArrow(tidy(packed), f"vec_id {kind}, h binary"), "vectors")
    sets = saved(rows.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id")).withColumn("id", F.sha2("h", 256)), "distinct-vectors")
    grid = grids(sets, plan)
    sent = spark.sparkContext.broadcast(grid)  # 2 * codes * dims doubles of each length, at most

    def placed(batches):
        for batch in batches:
            h = batch.column(1).to_pylist()
            size = np.array([len(x) // 8 for x in h], np.int64)
            home, cells = np.zeros(len(h), np.int64), [b""] * len(h)
            for d in np.unique(size):
                at, g = np.flatnonzero(size == d), sent.value[int(d)]
                x = np.frombuffer(b"".join([h[k] for k in at]), np.float64).reshape(len(at), d)
                home[at] = g.books.home(x) + g.cells
                for k, c in zip(at, np.sort(g.books.order(x, g.books.visits) + g.cells, axis=1).astype(np.int32)):
                    cells[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(cells, pa.binary())], ["id", "h", "copies", "home", "cells"])

    at = saved(sets.select("id", "h", "copies").mapInArrow(tidy(placed), "id string, h binary, copies long, home long, cells binary"), "cells")
    found = at.groupBy("home").count().toArrow()  # a number per cell, the squares of codes at most
    sizes = np.zeros(sum(g.books.k**2 for g in grid.values()), np.int64)
    sizes[found["home"].to_numpy()] = found["count"].to_numpy()
    bins, facts = np.zeros(len(sizes), np.int32), []
    for g in grid.values():
        own, parts = binned(sizes[g.cells : g.cells + g.books.k**2], g.block)
        bins[g.cells : g.cells + len(own)] = own + len(facts)
        facts += [(len(facts) + i, int(n), 16 * g.block) for i, n in enumerate(parts)]
    sent_bins = spark.sparkContext.broadcast(bins)  # 4 bytes per cell

    def spread(batches):
        for batch in batches:
            seen = [np.unique(sent_bins.value[np.frombuffer(c, np.int32)]).tolist() for c in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent_bins.value[batch.column(3).to_numpy()]), pa.array(seen, pa.list_(pa.int32()))], [*batch.schema.names, "bin", "bins"])

    base = ["id", "h", "copies", "home", "cells"]
    at = at.mapInArrow(tidy(spread), "id string, h binary, copies long, home long, cells binary, bin int, bins array<int>")
    queries = at.select(*base, F.explode("bins").alias("bin"), F.lit(1).alias("side"))
    both = at.select(*base, "bin", F.lit(0).alias("side")).union(queries)
    # blocks of each bin: of its indexed vectors (only a large cell has more than one) and of the queries to it
    asked = queries.groupBy("bin").agg(F.count(F.lit(1)).alias("asked"))
    blocks = spark.createDataFrame(facts, "bin int, b0 int, q int").join(asked, "bin").select("bin", "b0", F.ceil(F.col("asked") / F.col("q")).cast("int").alias("b1"))
    both = both.join(F.broadcast(blocks), "bin")  # a row per bin, fewer than cells
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1")))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1))
    tiles = both.withColumn("_mine", mine).withColumn("_other", others)
    tile = F.when(F.col("side") == 0, F.col("_mine") * F.col("b1") + F.col("_other")).otherwise(F.col("_other") * F.col("b1") + F.col("_mine"))
    tiles = tiles.select("bin", tile.cast("long").alias("tile"), "side", *base).repartition("bin", "tile").sortWithinPartitions("bin", "tile")

    def verify(batches):
        of_cell = sent_bins.value
        for own, _, side, ids, h, copies, home, cells in grouped(batches, 2):
            side, home, copies, n = np.array(side), np.array(home), np.array(copies, np.float64), len(ids)
            q, d = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            if not len(q) or not len(d):
                continue
            x = np.frombuffer(b"".join(h), np.float64).reshape(n, -1)
            visits = [len(c) // 4 for c in cells]
            spots, who = np.frombuffer(b"".join(cells), np.int32).astype(np.int64), np.repeat(np.arange(n), visits)
            seen = np.sort(who * len(of_cell) + spots)  # every vector with every cell that it visits
            hit = (side[who] == 1) & (of_cell[spots] == own[0])
            spots, who = spots[hit], who[hit]
            order = spots.argsort(kind="stable")
            spots, who = spots[order], who[order]
            d = d[home[d].argsort(kind="stable")]
            name = np.array(ids, object)
            _, same = np.unique(name, return_inverse=True)  # one vector can be on both sides
            root, total, linked = _firsts(same)[same], np.zeros(n), np.zeros(n, bool)
            for cell in np.unique(home[d]):
                lo, hi = np.searchsorted(home[d], [cell, cell + 1])
                begin, end = np.searchsorted(spots, [cell, cell + 1])
                for at in range(begin, end, 1024):
                    ask = who[at : min(at + 1024, end)]
                    i, j = np.nonzero(x[ask] @ x[d[lo:hi]].T >= plan.cosine)
                    a, c = ask[i], d[lo:hi][j]
                    other = same[a] != same[c]
                    a, c = a[other], c[other]
                    if not len(a):
                        continue
                    # the link of a to c is found from c as well if c visits the home of a; else it counts for both here
                    key = c * len(of_cell) + home[a]
                    alone = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
                    total += np.bincount(a, copies[c], n) + np.bincount(c[alone], copies[a[alone]], n)
                    linked[a] = linked[c] = True
                    root = spanning(root[a], root[c], n)[root]
            use = np.flatnonzero(linked)
            if len(use):
                yield pa.RecordBatch.from_arrays([pa.array(name[use], pa.string()), pa.array(name[root[use]], pa.string()), pa.array(total[use].astype(np.int64))], ["id", "root", "links"])

    links = saved(tiles.mapInArrow(tidy(verify), "id string, root string, links long"), "vector-links")
    final = saved(connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "root"), "components")
    least = saved(final.join(sets.select("id", "vec_id"), "id").groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-names")
    info = (
        sets.join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(joined(final, least, "root", "n", final.count()).select("id", "component_id"), "id", "left")
        .select("h", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    )
    out = joined(rows, saved(info, "vector-facts"), "h", "copies", rows.count())
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _firsts(same: np.ndarray) -> np.ndarray:
    """The first place of each value of 0 to the largest."""
    first = np.full(int(same.max()) + 1, len(same))
    np.minimum.at(first, same, np.arange(len(same)))
    return first


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
g as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from e where v is not null and len(v) = len(list_filter(v, lambda x: isfinite(x)))),
l as (select a.vec_id as x, b.vec_id as y from g a join g b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n),
r(x, root) as (select vec_id, vec_id from e union select l.x, r.root from r join l on l.y = r.x),
c as (select x, min(root) as component_id from r group by 1)
select e.vec_id, (select count(*) from l where l.x = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from e join c on c.x = e.vec_id
"""
