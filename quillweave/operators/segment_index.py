"""Pairs of sequences above a similarity, found by equal segments instead of by comparing all.

A pair at the threshold has at most m mismatches over the shorter length n, where m follows from n. Of m + 1 segments of
equal width, cut from the start, one is therefore equal in both, at the same place: an equi-join on (width, number,
letters) finds every such pair. The width is that of the shorter sequence, rounded down to one of a few, so a sequence is
entered once for each of these as the longer of a pair; at its own width the same entries serve it as the shorter. Sequences whose segments would be
narrower than NARROW letters (short ones, and all at low thresholds) share one bucket with all sequences. Buckets that
would give more than HOT_PAIRS pairs, that one included, are compared by pairs of blocks, whose unlike pairs never leave
the task; pairs of the other buckets are put together. Each is first tried by sketches, a byte for some letters: bytes that
differ are mismatches, so too many of them rule a pair out for certain. Letters are fetched for what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillweave.operators.identity import near_pairs, paired_identity
from quillweave.plans.store import Scope

#: Widths of segments; narrower ones tell too little apart.
WIDTHS = (3, 4, 6, 8, 12, 16, 24, 32)
NARROW = WIDTHS[0]
#: Pairs of a bucket beyond which its sequences are compared by blocks, and sequences of such a block.
HOT_PAIRS, BLOCK = 4096, 512
#: Letters that a byte of a sketch stands for, at most.
SKETCHED = 32


def mismatches_allowed(n: Column, threshold: float) -> Column:
    """Most mismatches over n letters at which the share, in single precision, is still at least the threshold."""
    limit = float(np.float32(threshold))
    fits = lambda m: ((n - m) / n).cast("float") >= F.lit(limit).cast("float")
    m = F.floor((1 - limit) * n).cast("int")
    m = F.when((m < n) & fits(m + 1), m + 1).otherwise(m)  # the product may be off by one either way
    return F.when((m > 0) & ~fits(m), m - 1).otherwise(m)


def entries(seqs: DataFrame, threshold: float) -> DataFrame:
    """key, shorter, ord and size: the buckets that each sequence is entered in. It may be the longer of a pair in each of them;
    shorter: whether it may be the shorter one there, too, which holds for the segments of its own width.

    Where seqs has a column group, only sequences of one group can share a bucket.

    The number of segments of each width is that of the longest sequence that has this width as the shorter, so that the
    longer of a pair is entered no oftener than the shorter may ask for.
    """

    group = [F.col(c) for c in ("group",) if c in seqs.columns]
    more = [c for c in ("group", "of") if c in seqs.columns]
    sized = seqs.select("ord", "seq", *more, F.length("seq").alias("size"))
    sized = sized.withColumn("count", mismatches_allowed(F.col("size"), threshold) + 1)
    fit = F.floor(F.col("size") / F.col("count"))
    width = F.coalesce(*[F.when(fit >= w, F.lit(w)) for w in reversed(WIDTHS)], F.lit(0))
    sized = sized.select("*", F.struct(width.alias("width"), F.col("count")).alias("own"))
    most = dict(sized.groupBy("own.width").agg(F.max("own.count")).collect())  # a row per width
    # one pass over the letters for each width; places found by substring() would be counted from the start each time
    cut = lambda width, count: F.slice(F.regexp_extract_all("seq", F.lit(f".{{{width}}}"), F.lit(0)), F.lit(1), count)
    own = lambda width, k: (F.col("own.width") == width) & (k < F.col("own.count"))
    segments = lambda width, count: F.transform(cut(width, count), lambda x, k: F.struct(F.xxhash64(F.lit(width), k, x, *group).alias("key"), own(width, k).alias("shorter")))
    one = F.array(F.struct(F.xxhash64(F.lit(0), *group).alias("key"), (F.col("own.width") == 0).alias("shorter")))  # the bucket of narrow segments
    every = [segments(width, F.lit(count)) if width else one for width, count in sorted(most.items())]
    every = F.concat(*[F.filter(x, lambda e: e["key"].isNotNull()) for x in every]) if every else one
    of = [c for c in more if c == "of"]
    return sized.select("ord", "size", *of, F.explode(every).alias("e")).select("e.key", "e.shorter", "ord", "size", *of)


def sketch_width(limit: float) -> int:
    """Letters of a sketch's byte: so many that a pair at the threshold still agrees in a fifth of the bytes."""
    return min(SKETCHED, int(0.8 / (1 - limit) + 1e-3)) if limit < 1 else SKETCHED


def sketch(seq: str, width: int) -> bytes:
    """A byte for every width letters; those left over have none."""
    letters = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    whole = letters[: len(letters) // width * width].reshape(-1, width)
    mixed = (whole * (np.arange(width, dtype=np.uint32) * np.uint32(2654435761) + np.uint32(2246822519))).sum(axis=1, dtype=np.uint32)
    return ((mixed * np.uint32(3266489917)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_mismatches(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For pairs of sketches, the bytes that differ, as far as both reach."""
    n = np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    x, y = (np.frombuffer(b"".join(s[:k] for s, k in zip(of, n.tolist())), np.uint8) for of in (a, b))
    before = np.concatenate([[0], np.cumsum(x != y)])
    ends = np.cumsum(n)
    return before[ends] - before[ends - n]


def _possible(pairs: DataFrame, whole: DataFrame, width: int, limit: float) -> DataFrame:
    """The pairs that their sketches do not rule out."""

    @F.pandas_udf("binary")
    def sketched(seq: pd.Series) -> pd.Series:
        return pd.Series([sketch(s, width) for s in seq], dtype=object)

    @F.pandas_udf("boolean")
    def may_be(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        size = n.to_numpy()
        return pd.Series((size - least_mismatches(a.tolist(), b.tolist())).astype(np.float32) / size.astype(np.float32) >= np.float32(limit))

    of = lambda x: whole.select(F.col("ord").alias(x), F.length("seq").alias(f"n_{x}"), sketched("seq").alias(f"sketch_{x}"))
    return pairs.join(of("i"), "i").join(of("j"), "j").where(may_be("sketch_i", "sketch_j", F.least("n_i", "n_j"))).select("i", "j")


class SegmentIndex:
    """The similar pairs between two sets of sequences, or within one; tables between steps belong to scope."""

    def __init__(self, threshold: float, scope: Scope):
        self.threshold, self.scope = threshold, scope

    def enter(self, left: DataFrame, right: DataFrame | None = None) -> tuple[DataFrame, int]:
        """Entries of both sets with the number of pairs in their buckets, and how many pairs the buckets hold in all."""
        names = [c for c in ("ord", "seq", "group") if c in left.columns]
        whole = left.select(*names, F.lit(0).alias("of"))
        if right is not None:
            whole = whole.union(right.select(*names, F.lit(1).alias("of")))
        found = entries(whole, self.threshold)
        # one shuffle of two numbers per entry: those of a bucket meet there, and only what a bucket shares is kept
        packed = F.shiftleft(F.col("size").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("ord").cast("long"), 2)).bitwiseOR((F.col("of") * 2 + F.col("shorter").cast("int")).cast("long"))
        found = found.select("key", packed.alias("packed"))
        shorter, of, ord_ = (F.col("packed").bitwiseAND(F.lit(1)) == 1), F.shiftright("packed", 1).bitwiseAND(F.lit(1)).cast("int"), F.shiftright("packed", 2).bitwiseAND(F.lit(2**31 - 1)).cast("int")
        bucket = Window.partitionBy("key")
        short, every = (lambda which: F.count_if(shorter & (of == which)).over(bucket)), (lambda which: F.count_if(of == which).over(bucket))
        pairs = short(0) * every(1) + short(1) * every(0) if right is not None else short(0) * every(0)
        # most buckets hold one sequence; its entry is not kept
        some = F.min(ord_).over(bucket) != F.max(ord_).over(bucket)
        met = found.select("key", "packed", pairs.alias("pairs"), some.alias("some")).where("some and pairs > 0")
        met = self.scope.saved(met.select("key", shorter.alias("shorter"), ord_.alias("ord"), F.shiftrightunsigned("packed", 33).cast("int").alias("size"), of.alias("of"), "pairs"), "segments")
        met = self._without_twins(met)
        return met, met.select("key", "pairs").distinct().agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]

    def _without_twins(self, met: DataFrame) -> DataFrame:
        """Of buckets with many pairs that hold the same sequences, as those of a long common beginning do, one: it has every
        pair of the others. Equal are their number and two sums of 64 bits."""
        seen = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "ord", "shorter", "of"))
        hot = met.where(F.col("pairs") > HOT_PAIRS).groupBy("key").agg(F.count(F.lit(1)).alias("n"), seen(1).alias("x"), seen(2).alias("y"))
        twins = self.scope.saved(hot.withColumn("first", F.min("key").over(Window.partitionBy("n", "x", "y"))).where("key <> first").select("key"), "twins")
        if twins.isEmpty():
            return met
        return self.scope.saved(met.join(twins, "key", "left_anti"), "segments", met, twins)

    def candidates(self, entered: DataFrame, within: bool) -> DataFrame:
        """i < j (by ord) of the pairs that share a bucket of few pairs, each once."""
        few = entered.where(F.col("pairs") <= HOT_PAIRS)
        a, b = (of.select("key", F.col("ord").alias(f"ord_{x}"), F.col("size").alias(f"size_{x}"), F.col("of").alias(f"of_{x}")) for of, x in ((few.where("shorter"), "a"), (few, "b")))
        met = a.join(b, "key").where((F.col("size_a") <= F.col("size_b")) & (F.col("ord_a") != F.col("ord_b")))
        met = met if within else met.where("of_a <> of_b")
        return met.select(F.least("ord_a", "ord_b").alias("i"), F.greatest("ord_a", "ord_b").alias("j")).distinct()

    def similar(self, left: DataFrame, right: DataFrame | None = None, entered: DataFrame | None = None) -> DataFrame:
        """i < j of all pairs whose share is at least the threshold: between left and right, or within left."""
        within = right is None
        entered = self.enter(left, right)[0] if entered is None else entered
        whole = left if within else left.union(right)
        pairs = self.candidates(entered, within)
        limit = float(np.float32(self.threshold))
        seq = lambda x: whole.select(F.col("ord").alias(x), F.col("seq").alias(f"seq_{x}"))

        @F.pandas_udf("float")
        def share(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(paired_identity(a.tolist(), b.tolist()))

        pairs = pairs if (width := sketch_width(limit)) < NARROW else _possible(pairs, whole, width, limit)
        near = pairs.join(seq("i"), "i").join(seq("j"), "j").where(share("seq_i", "seq_j") >= F.lit(limit).cast("float")).select("i", "j")
        ways = F.when(F.col("shorter"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        hot = entered.where(F.col("pairs") > HOT_PAIRS).withColumn("shorter", F.explode(ways))
        blocks = hot.groupBy("key").agg(*[F.ceil(F.count_if(F.col("shorter") == s) / BLOCK).cast("int").alias(n) for s, n in ((True, "rows"), (False, "cols"))])
        hot = hot.select("key", "shorter", "ord", "of").join(blocks, "key")
        place = F.pmod(F.xxhash64("ord"), F.when(F.col("shorter"), F.col("rows")).otherwise(F.col("cols")))
        others = F.sequence(F.lit(0), F.when(F.col("shorter"), F.col("cols")).otherwise(F.col("rows")) - 1)
        hot = hot.withColumn("mine", place).withColumn("other", F.explode(others))
        hot = hot.select("key", "shorter", "ord", "of", F.when(F.col("shorter"), F.col("mine")).otherwise(F.col("other")).alias("row"), F.when(F.col("shorter"), F.col("other")).otherwise(F.col("mine")).alias("col"))

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["shorter"]], pdf[~pdf["shorter"]]
            if a.empty or b.empty:
                return pd.DataFrame({"i": [], "j": []}, dtype="int32")
            i, j = a["ord"].to_numpy(), b["ord"].to_numpy()
            x, y = near_pairs(a["seq"].tolist(), b["seq"].tolist(), limit)
            ok = i[x] != j[y] if within else (i[x] != j[y]) & (a["of"].to_numpy()[x] != b["of"].to_numpy()[y])
            x, y = x[ok], y[ok]
            return pd.DataFrame({"i": np.minimum(i[x], j[y]), "j": np.maximum(i[x], j[y])})

        tiles = hot.join(whole.select("ord", "seq"), "ord").groupBy("key", "row", "col").applyInPandas(tile, "i int, j int")
        return near.union(tiles).distinct()
