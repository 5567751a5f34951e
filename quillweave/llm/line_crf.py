"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. A line's score for good comes from features of the line and of the lines before and
after it; a 2 x 2 table scores neighbouring labels. Forward and backward passes give each line's marginal of good, and
their mean, weighted by the lines' lengths, is the document's quality.

Labels exist for documents only. In training every line of a labelled document carries its label, and the weights
maximise one function: the mean over documents of a document's weight times the conditional log likelihood of its chain
per line, less a ridge; the rarer label's documents weigh more.

Training uses at most sample documents, chosen by a hash of doc_id among the labelled rows given, and of these, in that
order, as many as have max_lines lines together, so the features that reach the driver are bounded; every document is
scored, over its whole text.

Cases: a null text counts as empty, which is one empty line and gets that line's marginal; repeated rows and ties score
alike; a null doc_id is scored but never learned from; documents labelled both ways are not learned from, and of several
texts under one doc_id the one of least hash is; a very long text is measured in pieces of CHUNK_BYTES (in a line that is
longer, repeats of a word are looked for within each piece), so that memory follows its lines; with no labelled rows all
scores are 0.5; an empty table gives an empty result; only id, text and the label columns are read, so others may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import chunks, table, thinned, tidy

SAMPLE = 1500
MAX_LINES = 200_000
CHUNK_BYTES = 1 << 18

_LETTER, _UPPER, _DIGIT, _MARK, _STOP, _BAR, _BANG, _OTHER, _SPACE = range(9)


def _classes() -> np.ndarray:
    """The class of each byte; bytes of other scripts count as letters."""
    out = np.full(256, _OTHER, np.uint8)
    for text, kind in (("abcdefghijklmnopqrstuvwxyz", _LETTER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), ("#*$%&<>=@^~\\_{}[]", _MARK), (".,;:?'\"-()", _STOP), ("|", _BAR), ("!", _BANG), (" \t\v\f\r\n", _SPACE)):
        out[np.frombuffer(text.encode(), np.uint8)] = kind
    out[128:] = _LETTER
    return out


CLASSES = _classes()
N_BASE = 14
N_FEATURES = 3 * N_BASE + 1


def _pieces(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of about CHUNK_BYTES that end with a line or, within a longer line, at a blank; and whether a line goes on."""
    at = 0
    while len(data) - at > CHUNK_BYTES:
        end = data.rfind(b"\n", at, at + CHUNK_BYTES) + 1
        if end > at:
            yield data[at:end], False
        else:
            blank = data.rfind(b" ", at + 1, at + CHUNK_BYTES)
            end = blank if blank > 0 else at + CHUNK_BYTES
            yield data[at:end] + b"\n", True
        at = end
    if at < len(data):
        yield data[at:], False


#: What is added up for each line: characters, those of each class, words, repeats, shouts, and a sum of the words' hashes.
_SIZE, _COUNT, _WORDS, _AGAIN, _SHOUT, _HEAD, _TAIL = 0, 1, 10, 11, 12, 13, 14


def _measured(data: bytes) -> np.ndarray:
    """The sums of each line of data, which ends with a line, and the class of its last character."""
    raw = np.frombuffer(data, np.uint8)
    kind = CLASSES[raw]
    stop = np.flatnonzero(raw == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    lines = len(stop)
    out = np.zeros((lines, 15))
    out[:, _SIZE] = stop - start
    line = np.repeat(np.arange(lines), stop - start + 1)
    for k in range(_SPACE):
        out[:, _COUNT + k] = np.bincount(line[kind == k], minlength=lines)
    # words: their places, a hash of each, and whether it equals one of the two words before it in its line
    solid = kind != _SPACE
    first = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    last = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]]))
    place = np.arange(len(raw)) - np.repeat(np.append([0], first), np.diff(np.concatenate([[0], first, [len(raw)]])))
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        step = np.where(solid, raw.astype(np.uint64) * power[place & 63], 0)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step, dtype=np.uint64)])
        word = total[last + 1] - total[first]
    of = line[first]
    same = np.zeros(len(word))
    for back in (1, 2):
        if len(word) > back:
            same[back:] = np.maximum(same[back:], (word[back:] == word[:-back]) & (of[back:] == of[:-back]))
    out[:, _WORDS] = np.bincount(of, minlength=lines)
    out[:, _AGAIN] = np.bincount(of, same, minlength=lines)
    out[:, _SHOUT] = np.bincount(of, (raw[last] == 33).astype(float), minlength=lines)
    out[:, _HEAD] = np.bincount(of, word.astype(np.float64) / 2**64, minlength=lines)
    out[:, _TAIL] = np.where(stop > start, kind[np.maximum(stop - 1, 0)], _SPACE)
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of all texts, the lines' lengths, and the number of lines of each text."""
    parts, goes_on = [], False
    for piece, cut in _pieces("\n".join(texts).encode() + b"\n"):
        rows = _measured(piece)
        if goes_on:
            before = parts[-1][-1]
            tail = rows[0, _TAIL] if rows[0, _SIZE] else before[_TAIL]
            before += rows[0]
            before[_TAIL] = tail
            rows = rows[1:]
        if len(rows):
            parts.append(rows)
        goes_on = cut
    m = np.concatenate(parts)
    lines, size, words = len(m), m[:, _SIZE], m[:, _WORDS]
    count = m[:, _COUNT : _COUNT + _SPACE].T
    letters, full = count[_LETTER] + count[_UPPER], count.sum(axis=0)
    chars, w = np.maximum(full, 1), np.maximum(words, 1)
    base = np.stack(
        [
            np.ones(lines),
            size == 0,
            count[_MARK] / chars * 5,
            count[_BAR] / w * 4,
            count[_BANG] / w * 2,
            count[_UPPER] / np.maximum(letters, 1) * 2,
            count[_DIGIT] / chars * 2,
            m[:, _AGAIN] / w * 2,
            m[:, _SHOUT] / w,
            np.log1p(words) / 4,
            letters / w / 10,
            m[:, _TAIL] == _STOP,
            words < 4,
            count[_OTHER] / chars * 5,
        ],
        axis=1,
    ).clip(-5, 5)
    n = np.array([t.count("\n") + 1 for t in texts])
    begin = np.zeros(lines, bool)
    begin[np.cumsum(n)[:-1]] = True
    begin[0] = True
    end = np.append(begin[1:], True)
    before = np.where(begin[:, None], 0, np.roll(base, 1, axis=0))
    after = np.where(end[:, None], 0, np.roll(base, -1, axis=0))
    twin = np.zeros(lines)  # equal to the line before
    head = np.where(words > 0, m[:, _HEAD], -1)
    twin[1:] = (head[1:] == head[:-1]) & ~begin[1:] & (words[1:] > 0)
    return np.concatenate([base, before, after, twin[:, None]], axis=1), full, n


def forward_backward(emit: np.ndarray, trans: np.ndarray, n: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good, log partition per chain, and the marginals of neighbouring labels, summed with the chains' weights.

    emit: the score of good per line (bad: 0); trans[a, b]: the score of label b after a. Chains stand one after the
    other; all chains move one line a step, longest first, so work follows the number of lines.
    """
    order = np.argsort(-n, kind="stable")
    share = np.ones(len(n)) if weight is None else weight[order]
    begin = (np.cumsum(n) - n)[order]
    size = n[order]
    alpha = np.zeros((len(emit), 2))
    beta = np.zeros((len(emit), 2))
    logz = np.zeros(len(n))
    e = np.stack([np.zeros(len(emit)), emit], axis=1)
    alive = np.searchsorted(-size, -np.arange(1, size.max() + 1), side="right") if len(size) else []
    cur = None
    for t, k in enumerate(alive):
        at = begin[:k] + t
        if t == 0:
            cur = e[at]
        else:
            cur = np.logaddexp(cur[:k, :1] + trans[0], cur[:k, 1:] + trans[1]) + e[at]
        alpha[at] = cur
    done = begin + size - 1
    logz[order] = np.logaddexp(alpha[done, 0], alpha[done, 1])
    nxt = np.zeros((0, 2))
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        here = np.zeros((k, 2))
        if len(nxt):
            m = len(nxt)
            into = e[at[:m] + 1] + nxt
            joint = alpha[at[:m], :, None] + trans + into[:, None, :] - logz[order][:m, None, None]
            pairs += (np.exp(joint) * share[:m, None, None]).sum(axis=0)
            here[:m] = np.logaddexp(trans[:, 0] + into[:, :1], trans[:, 1] + into[:, 1:])
        beta[at] = nxt = here
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), logz, pairs


@dataclass(frozen=True)
class LineCrf:
    weights: np.ndarray
    trans: np.ndarray

    def quality(self, texts: list[str]) -> np.ndarray:
        """Quality of each text: its lines' marginals of good, weighted by length."""
        if not texts:
            return np.zeros(0)
        x, size, n = line_features(texts)
        p, _, _ = forward_backward(x @ self.weights, self.trans, n)
        begin = np.cumsum(n) - n
        weight = size + 1e-6
        return np.add.reduceat(p * weight, begin) / np.add.reduceat(weight, begin)


def document_weights(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weight of each chain's log likelihood: per line, so that long documents do not outweigh the rest, and of the mean."""
    rare = np.where(good == 1, (good == 0).mean(), (good == 1).mean()) ** 0.5 * 2
    return rare / n / len(n)


def objective(theta: np.ndarray, x: np.ndarray, n: np.ndarray, good: np.ndarray, ridge: float, stiff: float) -> tuple[float, np.ndarray]:
    """What training maximises, and its gradient: weighted log likelihoods of the chains, less ridges on the weights of
    features (ridge) and of neighbouring labels (stiff)."""
    trans, weight = theta[-4:].reshape(2, 2), document_weights(n, good)
    emit, y = x @ theta[:-4], np.repeat(good, n).astype(float)
    p, logz, pairs = forward_backward(emit, trans, n, weight)
    share, steps = np.repeat(weight, n), weight * (n - 1)
    stay = np.diag([steps[good == 0].sum(), steps[good == 1].sum()])
    keep = np.concatenate([np.full(x.shape[1], ridge), np.full(4, stiff)])
    value = share @ (y * emit) + (stay * trans).sum() - weight @ logz - (keep * theta * theta).sum() / 2
    return float(value), np.concatenate([x.T @ ((y - p) * share), (stay - pairs).ravel()]) - keep * theta


def fit(x: np.ndarray, n: np.ndarray, good: np.ndarray, steps: int = 200, ridge: float = 1e-4, stiff: float = 0.3) -> LineCrf:
    """Weights by gradient ascent (Adam) on the objective."""
    if not len(n):
        return LineCrf(np.zeros(N_FEATURES), np.zeros((2, 2)))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, g = objective(theta, x, n, good, ridge, stiff)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.25 * 0.02 ** (step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineCrf(theta[:-4], theta[-4:].reshape(2, 2))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, max_lines: int = MAX_LINES) -> LineCrf:
    """Fit on at most sample documents with a label and max_lines lines; labels: rows of id and label to learn from."""
    df = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    df = df.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    chosen = thinned(df, F.col("doc_id"), df.count(), sample).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    named = texts.join(F.broadcast(chosen), "doc_id")  # at most sample rows are sent
    lines = named.groupBy("doc_id", "rank", "y").agg(F.min(F.struct("t", F.size(F.split("text", "\n", -1)).alias("n"))).alias("of"))
    use, total = [], 0
    for r in sorted(lines.collect(), key=lambda r: (r["rank"], r["doc_id"])):  # at most sample rows
        if total + r["of"]["n"] <= max_lines:
            use.append((r["doc_id"], r["of"]["t"], r["y"]))
            total += r["of"]["n"]
    if not use:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0, int))
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.sparkSession.createDataFrame(use, f"doc_id {kind}, t long, y int")

    def features(batches):
        for batch in batches:
            for d, y, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                x, _, _ = line_features([t.as_py()])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d.as_py()], batch.schema.types[0]), "y": pa.array([y.as_py()], pa.int32()), "x": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

    rows = texts.join(F.broadcast(some), ["doc_id", "t"]).select("doc_id", "y", "text").mapInArrow(tidy(features), f"doc_id {kind}, y int, x binary")
    rows = {r["doc_id"]: r for r in rows.dropDuplicates(["doc_id"]).collect()}  # of max_lines lines
    rows = [rows[d] for d, _, _ in sorted(use)]
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(np.concatenate(xs).astype(np.float64), np.array([len(x) for x in xs]), np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with their score; keep: the columns to return beside it (the id alone by default)."""
    keep = keep or [id_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "_score"]

    def run(batches):
        for batch in batches:
            got = [model.quality(part) for part in chunks(batch.column(batch.num_columns - 1), CHUNK_BYTES)]
            q = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(q)], names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text")).mapInArrow(tidy(run), schema + ", _score double")


THRESHOLD = 0.3


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~is_held_out(F.col("doc_id")))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, learnable(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
