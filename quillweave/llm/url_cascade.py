"""URL filters by Bloom filter cascades.

A cascade answers exactly whether a key is listed, for every key of a known universe: level 0 holds the listed keys,
level 1 the keys of the universe that level 0 takes by mistake, level 2 the listed keys that level 1 takes, and so on
until nothing is taken by mistake. A key's answer is the parity of the first level that refuses it, so no row is joined
or shuffled for the lookup.

Keys are dealt to parts by hash, as many as the list needs for a part of about part_bytes, and every part is a cascade of
its own. Levels are put together by tasks and written to the shared folder, a file for each part and level; a task loads
the parts that its keys need, one after the other, and keeps cache_bytes of them. Lists of any size go the same way, and
the driver gets a row per part and level. Levels grow smaller, so they come to an end by themselves.

Rules are looked up by key as well: a url's candidate keys are each suffix of its host with each prefix of its path
that is as long as some rule's path, and the longest listed candidate is the rule (of equal ones the last by code
point); one cascade holds the rules that
block, another those that allow, and a third the hosts to block where no rule fits.

Cases: a null url, or one without ://, has an empty host and path and no rule; repeated rows and null ids are judged
alike; repeated and null keys of a list count once and not at all, and a rule that blocks and allows blocks; a very long
url costs no more than its length, as only suffixes with no more labels and letters than a listed key are looked up; an
empty table or list gives an empty result or none listed; only the id and url columns are read, so others may have any
name. Tasks write under names of their own attempt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import drop, filesystem, put_bytes, saved, scratch, table

#: Fixed values of the contract: rules as key and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words by which the query lists hosts: a label that holds one between its hyphens is blocked with all below it.
LISTED_WORDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "loans", "pills", "poker", "porn", "spam", "torrent", "warez", "xxx")
PART_BYTES = 8 << 20
CACHE_BYTES = 32 << 20
RATE = 0.5  # of mistakes, of all levels but the first


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(rest, upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, labels: int, letters: int) -> Column:
    """The host and its parent domains of at most so many labels and letters, longest first."""
    parts = F.split(host, "\\.", -1)
    n = F.size(parts)
    found = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.slice(parts, i, n - i + 1))
    short = F.filter(found, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + F.length(y)) + F.size(x) - 1 <= letters)
    return F.transform(short, lambda x: F.array_join(x, "."))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Shape:
    """One Bloom filter: n_hashes places of each key among n_bits, by double hashing under its level's seed."""

    seed: int
    n_bits: int
    n_hashes: int

    @classmethod
    def of(cls, n: int, rate: float, level: int) -> Shape:
        n_bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
        return cls(level + 1, n_bits, max(1, round(n_bits / n * math.log(2))))

    def places(self, keys: list[str]) -> np.ndarray:
        raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k.encode(), self.seed) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
        return (raw[:, 1:] + (raw[:, :1] | np.uint64(1)) * np.arange(self.n_hashes, dtype=np.uint64)) % np.uint64(self.n_bits)

    def takes(self, words: np.ndarray, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        p = self.places(keys)
        return (words[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


@dataclass(frozen=True)
class Cascade:
    """Per part its levels, as shape and file; keys of parts without levels are not listed."""

    parts: int
    levels: dict[int, list[tuple[Shape, str]]]

    def listed(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Whether each key is listed; parts are loaded one after the other."""
        out = np.zeros(len(keys), bool)
        for p in np.unique(part):
            open_ = np.flatnonzero(part == p)
            levels = self.levels.get(int(p), [])
            for depth, (shape, uri) in enumerate(levels):
                took = shape.takes(_loaded(uri), keys[open_].tolist())
                out[open_[~took]] = depth % 2 == 1
                open_ = open_[took]
            out[open_] = len(levels) % 2 == 1
        return out


_cache: dict[str, np.ndarray] = {}


def _loaded(uri: str) -> np.ndarray:
    """A level's bytes, kept by the worker together with others up to CACHE_BYTES."""
    if (found := _cache.get(uri)) is None:
        fs, path = filesystem(uri)
        with fs.open_input_stream(path, compression=None) as f:
            found = np.frombuffer(f.read(), np.uint8)
        while _cache and sum(map(len, _cache.values())) + len(found) > CACHE_BYTES:
            del _cache[next(iter(_cache))]
        _cache[uri] = found
    return found


def _write_level(keys: DataFrame, shapes: dict[int, Shape], folder: str) -> dict[int, str]:
    """Files of one level's parts: tasks find the bits of their keys, and one task puts a part's words together."""

    def places(parts):
        for pdf in parts:
            for part, rows in pdf.groupby("part"):
                p = np.unique(shapes[part].places(rows["key"].tolist()))
                yield pd.DataFrame({"part": np.int32(part), "word": (p >> np.uint64(6)).astype(np.int64), "bit": (p & np.uint64(63)).astype(np.int64)})

    word = F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits")
    words = keys.select("part", "key").mapInPandas(places, "part int, word long, bit long").groupBy("part", "word").agg(word)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        out = np.zeros(shapes[part].n_bits // 64, np.int64)
        out[pdf["word"]] = pdf["bits"]
        uri = f"{folder}/{part:06d}-{shapes[part].seed:03d}-{TaskContext.get().taskAttemptId()}.bits"
        put_bytes(uri, [out.astype("<i8").tobytes()])
        return pd.DataFrame({"part": [part], "uri": [uri]})

    return {r["part"]: r["uri"] for r in words.groupBy("part").applyInPandas(write, "part int, uri string").collect()}


def build(listed: DataFrame, universe: DataFrame, part_bytes: int = PART_BYTES) -> Cascade:
    """The cascade of listed keys over a universe of distinct keys (both with a column key)."""
    spark = listed.sparkSession
    folder = scratch(spark, "cascade")
    listed = saved(listed.where("key is not null").select("key").distinct(), "cascade-listed")
    n, m = listed.count(), universe.count()
    first = min(RATE, n * math.sqrt(RATE) / max(m, 1)) if n else RATE
    parts = max(1, math.ceil(n * -math.log(first) / math.log(2) ** 2 / 8 / part_bytes))
    dealt = lambda df: df.select("key", part_of(F.col("key"), parts).alias("part"))
    take = saved(dealt(listed), "cascade-keys", listed)
    rest = saved(dealt(universe.join(take.select("key"), "key", "left_anti")).sortWithinPartitions("part"), "cascade-rest")
    levels: dict[int, list[tuple[Shape, str]]] = {}
    level = 0
    while counts := {r["part"]: r["count"] for r in take.groupBy("part").count().collect()}:
        shapes = {p: Shape.of(k, RATE if level else first, level) for p, k in counts.items()}
        uris = _write_level(take, shapes, folder)
        for p, uri in uris.items():
            levels.setdefault(p, []).append((shapes[p], uri))

        def wrong(batches, shapes=shapes, uris=uris):
            for pdf in batches:
                for part, rows in pdf.groupby("part"):
                    if part in uris:
                        yield rows[shapes[part].takes(_loaded(uris[part]), rows["key"].tolist())]

        # a level takes all keys that it holds, so of the next level only parts with mistakes go on
        take, rest = saved(rest.mapInPandas(wrong, "key string, part int").sortWithinPartitions("part"), "cascade-level"), take
        level += 1
    drop(take, rest)
    return Cascade(parts, levels)


def candidates(suffix: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a rule for this url could have: suffixes of its host with prefixes of its path."""
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    starts = F.filter(starts, lambda x: x.isNotNull())
    return F.flatten(F.transform(suffix, lambda h: F.transform(starts, lambda p: F.concat(h, p))))


def _limits(hosts: DataFrame) -> tuple[int, int]:
    """Labels and letters of the listed hosts (column key), at most."""
    r = hosts.agg(F.max(F.size(F.split("key", "\\.", -1))).alias("a"), F.max(F.length("key")).alias("b")).first()
    return r["a"] or 0, r["b"] or 0


def url_filter(pages: DataFrame, rules: dict[str, str] | DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    rules: host with path (key) and verdict, as a table or dict; blocked: a table of hosts (key).
    """
    spark = pages.sparkSession
    if isinstance(rules, dict):
        rules = spark.createDataFrame(list(rules.items()) or [("/", "none")], "key string, verdict string")
    slash = F.instr("key", "/")
    rules = rules.where("verdict in ('block', 'allow') and instr(key, '/') > 0")
    lengths = [r["n"] for r in rules.select((F.length("key") - slash + 1).alias("n")).distinct().orderBy("n").collect()]  # of paths
    df = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    of_rules, of_hosts = _limits(rules.select(F.expr("substring(key, 1, instr(key, '/') - 1)").alias("key"))), _limits(blocked)
    none = F.array().cast("array<string>")
    keys = {
        "_rules": candidates(suffixes(F.col("host"), *of_rules), F.col("path"), lengths) if lengths else none,
        "_hosts": suffixes(F.col("host"), *of_hosts) if of_hosts[0] else none,
    }
    df = df.withColumns(keys)
    universe = {c: saved(df.select(F.explode(c).alias("key")).distinct(), "cascade-universe") for c in keys}
    cascades = (
        build(rules.where("verdict = 'block'"), universe["_rules"], part_bytes),
        build(rules.where("verdict = 'allow'"), universe["_rules"], part_bytes),
        build(blocked, universe["_hosts"], part_bytes),
    )
    drop(*universe.values())
    for name, places in (("_rules", (0, 1)), ("_hosts", (2,))):
        for k in places:
            parts = cascades[k].parts
            df = df.withColumn(f"{name}{k}", F.transform(name, lambda x: part_of(x, parts)))
    fields = ["page_id", "host", "path", "rule", "verdict"]

    def judge(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            hits = []
            for k, name in ((0, "_rules"), (1, "_rules"), (2, "_hosts")):
                keys, ends = col[name].flatten(), np.cumsum([0, *col[name].value_lengths().to_pylist()])
                part = col[f"{name}{k}"].flatten().to_numpy(zero_copy_only=False)
                names, first, back = np.unique(np.asarray(keys.to_pylist(), object), return_index=True, return_inverse=True) if len(keys) else (np.zeros(0, object), np.zeros(0, int), np.zeros(0, int))
                hits.append((keys, ends, cascades[k].listed(names, part[first])[back]))
            rule, verdict = [], []
            for i in range(batch.num_rows):
                best, what = None, "allow"
                for (keys, ends, yes), told in zip(hits[:2], ("block", "allow")):
                    for at in np.flatnonzero(yes[ends[i] : ends[i + 1]]) + ends[i]:
                        key = keys[int(at)].as_py()
                        if best is None or (len(key), key) > (len(best), best):
                            best, what = key, told
                if best is None and hits[2][2][hits[2][1][i] : hits[2][1][i + 1]].any():
                    what = "block"
                rule.append(best)
                verdict.append(what)
            yield pa.RecordBatch.from_arrays([col["page_id"], col["host"], col["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], fields)

    kind = df.schema["page_id"].dataType.simpleString()
    return df.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


#: From the first label that holds a listed word to the host's end.
LISTED = "(?:^|[.])((?:[^.]*-)?(?:" + "|".join(LISTED_WORDS) + ")(?:-[^.]*)?(?:[.].*)?)$"


def listed_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The host list of the query: domains of the corpus that are named by a listed word; grows with the corpus."""
    return pages.select(F.regexp_extract(host_of(F.col(url_col)), LISTED, 1).alias("key")).where("key <> ''").distinct()


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, RULES, listed_hosts(pages))


_REST = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
ORACLE = f"""
with u as (select page_id, {_REST} as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b as (select distinct regexp_extract(host, '{LISTED}', 1) as bh from h where regexp_extract(host, '{LISTED}', 1) <> ''),
m as (select h.*, (select max_by(struct_pack(rule := rh || rp, v := v), length(rh || rp)) from r
    where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as hit,
  exists (select 1 from b where host = bh or ends_with(host, '.' || bh)) as bad from h)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, hit.rule as rule,
  coalesce(hit.v, case when bad then 'block' else 'allow' end) as verdict from m
"""
