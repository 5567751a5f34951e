"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of many documents end to end, in ascending order of doc_id, and two Elias-Fano sequences: the
boundaries of the documents in the id array and the doc_ids themselves. n values below u take about 2 + log2(u / n)
bits each. The select directory keeps, in 32 bits, the byte of the upper part where every 256th value lies, which adds
an eighth of a bit to a value; it is stored in the file, and the reader holds the packed parts only, in which it looks
up one document or a bounded slice of them, and reads their ids from the file.

File layout, little endian: magic, version, id width (2 or 4 bytes), counts, the two sequences with their directories,
the ids. A range of documents becomes as many files as its ids need, of file_ids ids or one document each.

Encoding cuts a text into units, white space with the word after it, which the byte-level pattern never joins; each
different unit goes through the tokenizers library once per worker, as long as the worker's store, bounded in bytes, has
room.

Cases: a null text counts as empty and holds the end id only; null doc_ids come first and are marked; repeated rows are
separate documents in the order of their texts; an empty table writes no file and reads back as an empty result; only
the id and text columns are read, so others may have any name; a very long text is encoded whole and fills a file of its
own. A repeated task writes files of its own names, and the manifest holds those of the attempt that counts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import Recent, chunks, filesystem, put_bytes, rare_collections, scratch, table, tidy

MAGIC = b"QWTOKEN2"
END_ID = 2
#: Ids of a file, about: what a writing task holds.
FILE_IDS = 8 << 20
#: Special tokens and white space as the tokenizer's pattern knows it (unlike Python's \\s, without U+001C to U+001F).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Latin letters up to U+024F. Where all characters of a text lie below U+0250, units end at the last letter as well,
#: and an apostrophe between letters stays inside, as the pattern may tie it to what follows.
LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
FINE = re.compile(f"[{BLANK}]*[{LATIN}]+(?:'[{LATIN}]+)*|[{BLANK}]*[^{BLANK}{LATIN}]+|[{BLANK}]+")
LOOSE = re.compile(f"(?<![{LATIN}])'[{LATIN}]")
#: Bytes of units that a worker keeps with their ids, and of texts that it encodes at once.
STORE_BYTES = 320 << 20
BATCH_BYTES = 1 << 20


def units(text: str) -> list[str]:
    """Pieces that the tokenizer treats by themselves; an apostrophe that may start a piece calls for the coarser ones."""
    low = len(text.encode("latin-1", "ignore")) == len(text) or max(text) < "\u0250"
    if low and not ("'" in text and LOOSE.search(text)):
        return FINE.findall(text)
    return UNIT.findall(text)


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each value, one after the other."""
    out = []
    for lo in range(0, len(values), 1 << 16):  # a multiple of eight, so that parts end at whole bytes
        v = values[lo : lo + (1 << 16)]
        out.append(np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space, with select."""

    STEP = 256  # the byte of every so many values' upper part is kept

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = int(places[-1]) // 8 + 1 if n else 0
        if size >= 1 << 32:
            raise ValueError("too many values for one sequence")
        high = np.zeros(size, np.uint8)
        np.bitwise_or.at(high, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
        before = np.arange(0, n, cls.STEP)
        # the byte of a marked value, and how many ones of that byte come before it
        marks = np.stack([places[before] >> 3, before - np.searchsorted(places, places[before] >> 3 << 3)], axis=1) if n else np.zeros((0, 2))
        return cls(n, bits, packed_bits(v, bits), high, np.concatenate([marks[:, 0].astype("<u4").view(np.uint8), marks[:, 1].astype(np.uint8)]))

    def _mark(self, k: int) -> tuple[int, int]:
        m = len(self.marks) // 5
        return int(self.marks[4 * k : 4 * k + 4].view("<u4")[0]), int(self.marks[4 * m + k])

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The values from lo to before hi; work follows their number."""
        lo, hi = max(lo, 0), min(hi, self.n)
        if hi <= lo:
            return np.zeros(0, np.int64)
        first = lo // self.STEP
        begin, skip = self._mark(first)
        stop = -(-hi // self.STEP)
        end = self._mark(stop)[0] + 1 if stop * self.STEP < self.n else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little"))
        at = skip + lo - first * self.STEP
        i = np.arange(lo, hi)
        value = (begin * 8 + ones[at : at + hi - lo] - i) << self.low_bits
        if self.low_bits:
            from_, to = lo * self.low_bits, hi * self.low_bits
            bits = np.unpackbits(self.low[from_ >> 3 : (to + 7) >> 3], bitorder="little")[from_ & 7 :][: to - from_]
            value |= bits.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))
        return value

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: those of one step of the directory are found together."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        order = i.argsort(kind="stable")
        step = i[order] // self.STEP
        for part in np.split(order, np.flatnonzero(np.diff(step)) + 1):
            if len(part):
                lo = int(i[part[0]]) // self.STEP * self.STEP
                out[part] = self.slice(lo, lo + self.STEP)[i[part] - lo]
        return out

    @property
    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + len(self.marks)

    def to_bytes(self) -> bytes:
        sizes = struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.marks))
        return sizes + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def read(cls, source) -> EliasFano:
        """From a stream that stands at the sequence's start."""
        n, bits, *sizes = struct.unpack("<qqqqq", source.read(40))
        return cls(n, bits, *(np.frombuffer(source.read(k), np.uint8) for k in sizes))


class UnitEncoder:
    """Ids of texts through the tokenizers library, as bytes of 32-bit integers; one per worker and tokenizer."""

    _all: dict[str, UnitEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: Recent[bytes] = Recent(STORE_BYTES)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16

    @classmethod
    def at(cls, path: str) -> UnitEncoder:
        if path not in cls._all:
            cls._all[path] = cls(path)
            rare_collections()
        return cls._all[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; all units of these texts that are not kept go through the library at once."""
        cut = [units(t) for t in texts]
        kept = self.kept.room()
        new = []
        for u in set().union(*cut).difference(kept):
            if (got := self.kept.old.get(u)) is None:
                new.append(u)
            else:
                kept[u] = got
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = e.ids
                kept[u] = struct.pack(f"<{len(ids)}I", *ids)
        self.kept.used += sum(map(len, new)) * 3 + 180 * len(new)
        out = [b"".join([kept[u] for u in x]) for x in cut]
        for k, t in enumerate(texts):  # a special token's text may hide in a unit together with its neighbours
            if any(s in t for s in self.special):
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], wide: bool) -> Iterator[bytes]:
    """The parts of a file of documents in order of doc_id, nulls first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    base = int(known[0]) if len(known) else 0
    yield MAGIC + struct.pack("<qqqq", 4 if wide else 2, len(doc_ids) - len(known), base, int(lengths.sum()))
    yield EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    yield EliasFano.of(known.astype(np.uint64) - np.uint64(base & (2**64 - 1))).to_bytes()
    for x in ids:
        yield x if wide else np.frombuffer(x, "<u4").astype("<u2").tobytes()


class Shard:
    """An open file: its packed sequences, and the ids of any document or slice of documents."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a token file")
        self.width, self.nulls, self.base, self.total = struct.unpack("<qqqq", file.read(32))
        self.bounds, self.names = EliasFano.read(file), EliasFano.read(file)
        self.at = file.tell()

    @property
    def docs(self) -> int:
        return self.bounds.n - 1

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        lo, hi = max(lo, 0), min(hi, self.docs)
        names = self.names.slice(lo - self.nulls, hi - self.nulls).astype(np.uint64) + np.uint64(self.base & (2**64 - 1))
        return [None] * (max(0, min(hi, self.nulls) - lo)) + names.view(np.int64).tolist()

    def ids(self, begin: int, end: int) -> np.ndarray:
        self.file.seek(self.at + begin * self.width)
        return np.frombuffer(self.file.read((end - begin) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.ids(*self.bounds.slice(k, k + 2).tolist())

    def documents(self, step: int = 2048) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place of the first id in the file, and the ids of each document, by slices of step documents."""
        for lo in range(0, self.docs, step):
            cut = self.bounds.slice(lo, lo + step + 1)
            names = self.doc_ids(lo, lo + step)
            ids, begin = self.ids(int(cut[0]), int(cut[-1])), int(cut[0])
            for name, a, b in zip(names, cut[:-1].tolist(), cut[1:].tolist()):
                yield name, a, ids[a - begin : b - begin]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write token files below path, by ranges of doc_id; returns the manifest: file, documents, ids and first place.

    Ranges are as many as the tasks that read the input, or the shuffle partitions, so that they grow with it. Documents
    with one doc_id, or none, are dealt by the beginnings of their texts as well.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)]
    df = df.repartitionByRange(ranges, *order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = struct.pack("<I", end_id)

    def write(batches):
        coder, task, done = UnitEncoder.at(tokenizer), TaskContext.get(), 0
        names: list = []
        ids: list[bytes] = []
        held = 0

        def flush():
            nonlocal names, ids, held, done
            uri = f"{path}/ids-{task.partitionId():06d}-{done:06d}-{task.taskAttemptId()}.bin"
            n = put_bytes(uri, shard_bytes(names, ids, coder.wide))
            row = {"shard": [task.partitionId()], "part": [done], "uri": [uri], "bytes": [n], "docs": [len(names)], "ids": [held]}
            names, ids, held, done = [], [], 0, done + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            name = iter(batch.column(0).to_pylist())
            for texts in chunks(batch.column(1), BATCH_BYTES):
                for x in coder.encode(texts):
                    if held and held + len(x) // 4 >= file_ids:
                        yield flush()
                    names.append(next(name))
                    ids.append(x + end)
                    held += len(x) // 4 + 1
        if names:
            yield flush()

    schema = "shard long, part long, uri string, bytes long, docs long, ids long"
    rows = sorted(df.mapInArrow(tidy(write), schema).collect())  # one row per file
    out, start = [], 0
    for r in rows:
        out.append((*r, start))
        start += r["ids"]
    return spark.createDataFrame(out, schema + ", start long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start over all files, n_tokens and ids_crc32, file by file in parallel."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    rows = []
                    for d, at, x in Shard(f).documents():
                        rows.append((d, start + at, len(x), zlib.crc32(x.astype("<u4").tobytes())))
                        if len(rows) == 8192:
                            yield columns(rows)
                            rows = []
                    if rows:
                        yield columns(rows)

    def columns(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("uri", "start").repartition(files).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), scratch(spark, "token-files"), tokenizer))
