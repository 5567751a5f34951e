"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages with equal payloads of at least min_bytes share one response, that of the largest page_id; the others
are revisit records, which name it and hold no payload. Reading loads the dictionary from the skippable frame (plain or
itself a Zstandard frame), decodes one frame per record, and checks version, headers, content lengths, record ends and
payload digests.

A response is named by its page_id and digest, which revisits give as the record that they refer to; records that none
refers to, or that share both with another, are named by their place as well, so that all names differ.

Cases: a null payload counts as empty; a null page_id never answers for others unless no page_id is known for its
payload; repeated rows with the largest page_id are each a response, and revisits then give that page_id only; a null url
is written as an empty target; very long payloads are records like others; an empty table, or an empty task, writes no
archive, and an empty table reads back as an empty result; only the id, url and html columns are read, so others may have
any name. A repeated task writes an archive of its own name, and the table of archives holds that of the attempt that
counts, so that lost executors leave no half archive in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import filesystem, joined, put_bytes, saved, scratch, table, thinned

#: Fixed values of the format: magic of the skippable frame that holds a dictionary, and of a dictionary.
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DICT_SAMPLE = 400  # pages that the dictionary is trained on
DICT_BYTES = 32 << 10
#: Characters of a page, and of all, below which nothing is trained; the trainer may fail hard on less.
LEAST_PAGE, LEAST_SAMPLE = 64, 8 << 10
#: The date of all records; pages carry none.
DATE = "2024-01-01T00:00:00Z"


def name_of(page_id: int | None, sha1_hex: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1_hex}{place}')}>"


def record(page_id: int | None, url: str, payload: bytes, sha1_hex: str, n_bytes: int, refers_to: int | None, revisit: bool, place: str = "", named: bool = True) -> bytes:
    """One WARC record; ids of pages travel in headers of our own. named: whether its payload's response has a name
    without a place."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name_of(page_id, sha1_hex, place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(n_bytes)),
    ]
    block = HTTP_HEAD % n_bytes + (b"" if revisit else payload)
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        head += [("WARC-Refers-To", name_of(refers_to, sha1_hex))] * named
        head += [("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "\r\n".join(f"{k}: {v}" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises ValueError if anything is amiss."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    n = int(headers["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content length {n} does not fit a record of {len(rest)} bytes")
    return headers, rest[:n]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a response's HTTP block, checked against its length and digest."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP block")
    told = dict(x.split(b":", 1) for x in head.lower().split(b"\r\n")[1:])
    if int(told.get(b"content-length", len(body))) != len(body):
        raise ValueError("HTTP content length does not fit the payload")
    digest = headers.get("warc-payload-digest", "")
    if digest and digest != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
        raise ValueError("payload digest does not fit the payload")
    return body


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def records(stream) -> Iterator[bytes]:
    """The records of an archive stream, one frame each, in bounded memory: a piece of input and one record."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("archive is too short")
    magic, n = struct.unpack("<II", head)
    if magic == SKIPPABLE:
        packed = stream.read(n)
        if len(packed) != n:
            raise ValueError("dictionary is cut short")
        if struct.unpack_from("<I", packed)[0] != DICTIONARY:
            packed = zstandard.ZstdDecompressor().decompress(packed)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed))
        rest = b""
    else:
        reader, rest = zstandard.ZstdDecompressor(), head
    while True:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(1 << 18)):
                if parts or frame.unused_data:
                    raise ValueError("last frame is cut short")
                return
            parts.append(frame.decompress(rest))
            rest = b""
        rest = frame.unused_data
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, id_col: str, html_col: str, sample: int = DICT_SAMPLE) -> bytes:
    """A dictionary from at most sample pages (chosen by hash of id), each by its first 16 kB; empty if they are too few."""
    full = pages.where(F.length(html_col) >= LEAST_PAGE)
    rows = thinned(full, F.col(id_col), full.count(), sample).select(F.col(id_col).alias("id"), F.substring(html_col, 1, 16_384).alias("html"))
    rows = rows.orderBy(F.xxhash64("id"), "id", "html").limit(sample).collect()
    if sum(len(r["html"]) for r in rows) < LEAST_SAMPLE:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r["html"].encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # the trainer refuses samples that are few or small
        return b""


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives below path, one per task; returns their uris and record counts."""
    spark = pages.sparkSession
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    df = df.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "n_bytes": F.octet_length("html").cast("long")})
    dictionary = train_dictionary(df, "page_id", "html")
    # one row per digest meets the pages again, those with very many pages without a shuffle
    per_id = df.where(F.col("n_bytes") >= min_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    last = F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "n"))
    first = per_id.groupBy("sha").agg(last.alias("last"), F.sum("n").alias("copies")).where("copies > 1")
    first = saved(first.select("sha", F.col("last.page_id").alias("first"), (F.col("last.n") == 1).alias("named"), F.lit(True).alias("shared"), "copies"), "first-pages")
    df = joined(df, first, "sha", "copies", df.count())
    df = df.withColumn("revisit", F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")))
    # a response that is alone with its digest, or answers for others by itself
    plain = (F.col("n_bytes") >= min_bytes) & ~F.col("revisit") & F.coalesce("named", F.lit(True))
    df = df.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).otherwise("").alias("html"), "sha", "n_bytes", "first", "revisit", plain.alias("plain"), "named")
    sent = spark.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    def write(batches):
        whole = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=whole, write_content_size=True)
        task, n = TaskContext.get(), 0
        uri = f"{path}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        if (ahead := next(rows, None)) is None:
            return

        def frames():
            nonlocal n
            if sent.value:
                yield leading_frame(sent.value)
            for page_id, url, html, sha, n_bytes, first, revisit, plain, named in chain([ahead], rows):
                place = "" if plain else f":{task.partitionId()}:{n}"
                n += 1
                yield packer.compress(record(page_id, url, html.encode(), sha, n_bytes, first, revisit, place, bool(named)))

        size = put_bytes(uri, frames())
        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n], "bytes": [size]})

    rows = sorted(df.mapInArrow(write, "uri string, records long, bytes long").collect())  # one row per archive
    return spark.createDataFrame(rows, "uri string, records long, bytes long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits)."""
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches):
        number = lambda x: int(x) if x else None
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = filesystem(uri)
                out, size = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for data in records(f):
                        h, block = parse(data)
                        revisit = h["warc-type"] == "revisit"
                        body = None if revisit else payload_of(h, block)
                        n = int(h["x-payload-length"])
                        if body is not None and len(body) != n:
                            raise ValueError("payload length does not fit the payload")
                        out.append((number(h["x-page-id"]), n, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("x-refers-to-page")), h["warc-target-uri"], body))
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    files = max(1, archives.count())
    return archives.select("uri").repartition(files).mapInArrow(read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base 32: every five hexadecimal digits are four letters.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html) as payload_bytes, sha1(html) as sha, count(*) over (partition by html) as n, max(page_id) over (partition by html) as first from p),
d as (select q.*, n > 1 and page_id is distinct from first as again, list_transform(range(0, 8), lambda g: ('0x' || substr(sha, g * 5 + 1, 5))::bigint) as five from q)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to from d
"""
