"""Substring dedup by sliding sentence spans.

Texts are cut into sentences at closing marks followed by white space and at line ends. Only a sentence of more than
long_words words is cut further, after words that a rule on their letters picks (one in six) or after piece_words words,
so that it has spans as well and equal passages in it fall into step wherever they begin.
From every sentence a run goes on for span consecutive sentences, and further until it has min_words words, as shorter
ones are too common; every run is hashed (96 bits), once, and the hashes are written to the shared folder. Runs that
occur more than once keep their first occurrence, by doc_id, then text, then place; all sentences that another
occurrence covers are removed.

The join is on span hashes: first occurrences are aggregated before the shuffle, so a span that very many documents
share is one row on that side, and its occurrences are split by Spark's skew join, as nothing needs them together.

Cases: null texts and rows with a null doc_id are returned as they are and take no part; an empty text has no spans;
rows with equal doc_id and equal text are one document and keep equal texts, while rows that share a doc_id but not the
text are documents of their own (told apart by a 64-bit hash of the text); within a document the earlier of two equal
spans stays; a very long text is cut and hashed whole; an empty table gives an empty result; only the id and text columns
are read, further columns of any name are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import chunks, saved, table, tidy


@dataclass(frozen=True)
class SpanRules:
    """Of 50 equal words, those of a cut-off sentence at either end leave 50 - 2 * 15 = 20, in two sentences or more."""

    span: int = 2  # consecutive sentences of a run
    min_words: int = 20  # a run goes on until it has so many
    long_words: int = 16  # longer sentences are cut
    piece_words: int = 12  # into pieces of so many words at most


#: A sentence ends after closing marks (and quotes) before white space, or at a line end.
END = re.compile(r"\n|[.!?\u3002\uff01\uff1f]+[\"')\]\u201d\u2019]*(?=\s|$)")


def sentences(text: str, rules: SpanRules = SpanRules()) -> list[tuple[int, int, int]]:
    """Start, end and word count of each sentence, or piece of a long one, from its first word to its last."""
    out, lo = [], 0
    for hi in [m.end() for m in END.finditer(text)] + [len(text)]:
        part = text[lo:hi]
        words = part.split()
        n = len(words)
        if n:
            start = lo + part.find(words[0])
            if n <= rules.long_words:
                out.append((start, lo + len(part.rstrip()), n))
            else:
                _cut(out, text, start, words, rules.piece_words)
        lo = hi
    return out


def _cut(out: list, text: str, at: int, words: list[str], piece_words: int) -> None:
    begin, n = at, 0
    for w in words:
        if not text.startswith(w, at):  # more than one character between words
            at = text.find(w, at)
        if not n:
            begin = at
        n += 1
        at += len(w) + 1
        if n == piece_words or (len(w) + 7 * ord(w[0]) + 31 * ord(w[-1])) % 6 == 0:
            out.append((begin, at - 1, n))
            n = 0
    if n:
        out.append((begin, at - 1, n))


def runs_of(parts: list[tuple[int, int, int]], rules: SpanRules) -> np.ndarray:
    """For each sentence that a run starts at, the sentence after the run's end."""
    words = np.concatenate([[0], np.cumsum([w for _, _, w in parts])])
    stop = np.maximum(np.searchsorted(words, words[:-1] + rules.min_words), np.arange(len(parts)) + rules.span)
    return stop[stop <= len(parts)]


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1, *[base] * n], np.uint64))


_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def span_hashes(text: str, rules: SpanRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the runs, and two hashes of each, from running sums of the sentences' hashes."""
    parts = sentences(text, rules)
    stop = runs_of(parts, rules)
    n = len(stop)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    one = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b, _ in parts], np.uint64)
    both = []
    for base, inverse in _BASES:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * _powers(base, len(one))[:-1], dtype=np.uint64)])
        both.append((total[stop] - total[:n]) * _powers(inverse, n)[:-1])
    h, g = both
    return np.arange(n, dtype=np.int32), (h ^ (h >> np.uint64(29))).view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32)


def without(text: str, removed: list[int], parts: list[tuple[int, int, int]]) -> str:
    """The text without the sentences at these places and the white space after each; the rest is untouched."""
    gone = set(removed)
    out, at = [], 0
    for k, (lo, _, _) in enumerate(parts):
        if k in gone:
            out.append(text[at:lo])
            at = parts[k + 1][0] if k + 1 < len(parts) else len(text)
    out.append(text[at:])
    return "".join(out).rstrip(" \n") if gone else text


def repeated_runs(docs: DataFrame, rules: SpanRules = SpanRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (xxhash64 of the text) and starts: the places of the document's runs that are not first occurrences."""
    fields = ["doc_id", "t", "at", "h", "g"]

    def hashed(batches):
        for batch in batches:
            ids, names, done = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            for texts in chunks(batch.column(2)):
                found = [span_hashes(x, rules) for x in texts]
                n = [len(x[0]) for x in found]
                of = np.repeat(np.arange(done, done + len(texts)), n)
                cols = [ids[of], names[of]] + [np.concatenate([x[k] for x in found]) for k in range(3)]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], fields)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    runs = saved(texts.mapInArrow(tidy(hashed), "doc_id long, t long, at int, h long, g int"), "span-hashes")
    first = runs.groupBy("h", "g").agg(F.min(F.struct("doc_id", "t", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own, as Spark splits the tasks of a skewed join only where both sides come straight from a shuffle
    first = saved(first.select("h", "g", F.col("first.doc_id").alias("d"), F.col("first.t").alias("s"), F.col("first.at").alias("a")), "first-spans")
    again = runs.join(first, ["h", "g"]).where("doc_id <> d or t <> s or at <> a")
    # bounded by the sentences of a document
    return saved(again.groupBy("doc_id", "t").agg(F.collect_set("at").alias("starts")), "repeated-runs", runs, first)


def dedup(docs: DataFrame, rules: SpanRules = SpanRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the text cleaned; _n_sentences and _n_removed tell how much went."""
    outer, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # so that further columns may have any name
    docs, id_col, text_col = docs.toDF(*names), names[outer.index(id_col)], names[outer.index(text_col)]
    found = repeated_runs(docs, rules, id_col, text_col).toDF("_of", "_t", "_starts")
    same = (docs[id_col].cast("long") == found["_of"]) & (F.xxhash64(docs[text_col]) == found["_t"])
    df = docs.join(found, same, "left").select(*[docs[c] for c in names], "_starts")
    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", _n_sentences long, _n_removed long"
    at = names.index(text_col)

    def clean(batches):
        for batch in batches:
            starts, texts = batch.column(len(names)).to_pylist(), batch.column(at).to_pylist()
            n, gone, out = [], [], []
            for text, some in zip(texts, starts):
                parts = sentences(text or "", rules)
                stop = runs_of(parts, rules) if some else ()
                removed = sorted({i for k in some or () for i in range(k, stop[k])})
                out.append(without(text, removed, parts) if removed else text)
                n.append(len(parts))
                gone.append(len(removed))
            cols = [*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*names, "_n_sentences", "_n_removed"])

    return df.mapInArrow(tidy(clean), schema).toDF(*outer, "_n_sentences", "_n_removed")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"))
