"""Sequence files: FASTA and delimited text, by extension. Errors name the first bad sequence, counted from 1."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillweave.operators.sequences import SequenceError, at_least_two, raise_first_fault, strip_blanks, upper_ascii
from quillweave.plans.store import saved

# Extensions, delimiters, and names of a sequence column.
FASTA_EXTENSIONS = ("fasta", "fa", "fas", "fna", "ffn", "faa", "frn", "mpfa")
DELIMITERS = {"csv": ",", "tsv": "\t", "ssv": ";", "psv": "|"}
SEQUENCE_COLUMNS = ("sequence", "seq", "protein", "dna", "rna", "amino", "peptide", "chain")

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}


def register_reader(extensions, reader: Reader) -> None:
    for x in extensions:
        READERS[x.lower()] = reader


def extension(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    if not dot or not stem or not ext:
        raise SequenceError("File extension not found")
    return ext.lower()


def read_sequences(spark: SparkSession, path: str, alphabet: str, max_length: int | None = None, **options) -> DataFrame:
    """A checked sequence set from a file; options: seq_col and header for delimited text."""
    ext = extension(path)
    if ext not in READERS:
        raise SequenceError(f"Unsupported file format .{ext}")
    return READERS[ext](spark, path, alphabet, max_length, **options)


#: Rows of a small table (pieces of files, headers) that are sent to all tasks; beyond it they are joined by shuffle.
SENT = 10_000


def _sent(small: DataFrame, name: str) -> DataFrame:
    small = saved(small, name)
    return F.broadcast(small) if small.count() <= SENT else small


def _before(pieces: DataFrame, of: str, each_file: bool = False) -> DataFrame:
    """_f, _p and _before: the sum of a column over all earlier pieces, or those of the file, in order of files and places."""
    along = Window.partitionBy("_file").orderBy("_piece") if each_file else Window.orderBy("_file", "_piece")
    earlier = F.sum(of).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return _sent(pieces.select(F.col("_file").alias("_f"), F.col("_piece").alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_before")), "pieces")


def _with_before(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(before, (rows["_file"] == before["_f"]) & (rows["_piece"] == before["_p"])).drop("_f", "_p")


def _numbered(rows: DataFrame) -> DataFrame:
    """Fragments with the number of their record, from 1, over all files: those that begin in a piece have _k from 1 there,
    and _k 0 goes on with the last record of the pieces before."""
    pieces = rows.groupBy("_file", "_piece").agg(F.max("_k").alias("_n"))
    return _with_before(rows, _before(pieces, "_n")).withColumn("_row", F.col("_before") + F.col("_k")).drop("_before")


def _records(fragments: DataFrame, between: str) -> DataFrame:
    """_file, _row and data of whole records. Only records that pieces cut, fewer than the pieces, are shuffled to meet."""
    rows = _numbered(fragments)
    cut = _sent(rows.where("_k = 0").select("_row").distinct(), "cut")
    parts = F.sort_array(F.collect_list(F.struct("_piece", "data")))
    met = rows.join(cut, "_row", "left_semi").groupBy("_file", "_row").agg(F.array_join(F.transform(parts, lambda x: x["data"]), between).alias("data"))
    return rows.join(cut, "_row", "left_anti").select("_file", "_row", "data").union(met)


def _text(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of a folder's files, with their file and the piece that they were read in, in order within it."""
    value = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_piece"))


FRAGMENT = "_file string, _piece long, _k long, data string"


def _made(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["_file", "_piece", "_k", "data"])


def _fasta_fragments(batches):
    """Lines of a piece put together to records, whatever the batches: _k 0 goes on with a record from before the piece."""
    at, k, data = None, 0, None
    for b in batches:
        out = []
        for value, *where in zip(b["value"], b["_file"], b["_piece"].tolist()):
            before, mark, _ = value.partition(">")
            if where != at:
                if data is not None:
                    out.append((*at, k, "".join(data)))
                at, k, data = where, 0, [] if before or not mark else None
            if data is not None:
                data.append(before)
            if mark:
                if data is not None:
                    out.append((*at, k, "".join(data)))
                k, data = k + 1, []
        if out:
            yield _made(out)
    if data is not None:
        yield _made([(*at, k, "".join(data))])


def read_fasta(spark: SparkSession, path: str, alphabet: str, max_length: int | None = None) -> DataFrame:
    """Records of a > header line and data up to the next >; a > inside a header is part of it.

    A file, or the files of a folder in order of their names, are read in pieces at line ends, whatever their size; a
    record's lines are put together where they are read, and what pieces cut meets again by its number: only one sequence has
    to fit a task. Numbers go on from file to file, and
    each file must begin with a header.
    """
    lines = saved(_text(spark, path).mapInPandas(_fasta_fragments, FRAGMENT), "fasta-fragments")
    if lines.isEmpty():
        raise SequenceError("the file is empty")
    firsts = lines.groupBy("_file").agg(F.min(F.struct("_piece", "_k")).alias("first"))
    if not firsts.where("first._k = 0").isEmpty():
        raise SequenceError("Data before first header")
    seqs = _records(lines, "").select((F.col("_row") - 1).cast("int").alias("ord"), F.col("data").alias("raw"))
    last = seqs.agg(F.max(F.struct("ord", (F.col("raw") == "").alias("bare"))).alias("m")).first()["m"]
    seqs = seqs.select("ord", strip_blanks(upper_ascii(F.col("raw"))).alias("seq"))
    raise_first_fault(seqs.where(F.col("ord") < last["ord"]) if last["bare"] else seqs, alphabet, max_length)
    if last["bare"]:
        raise SequenceError("Last header has no data")
    return at_least_two(seqs)


def split_fields(text: str, delimiter: str):
    """Lines of raw fields. Any quote opens or closes quoting, a doubled one inside quotes is passed over as a pair,
    and delimiters and line ends inside quotes are data. A line's second part tells whether a delimiter ended it."""
    fields, start, quoted, skip, n = [], 0, False, -1, len(text)
    for m in re.compile(f'"|{re.escape(delimiter)}|[\r\n]+').finditer(text):
        at, c = m.start(), m.group()
        if c == '"':
            if at == skip:
                continue
            if quoted and text.startswith('"', at + 1):
                skip = at + 1
            else:
                quoted = not quoted
        elif quoted:
            continue
        elif c == delimiter:
            fields.append(text[start:at])
            start = at + 1
        else:
            yield fields, text[start:at]
            fields, start = [], m.end()
    if start < n or fields:
        yield fields, text[start:]


def bare(field: str) -> str:
    return field[1:-1] if len(field) >= 2 and field[0] == field[-1] == '"' else field


def column_of(header: list[str], seq_col: str | int | None) -> int:
    """The sequence column: as asked for, or the first with a usual name."""
    if isinstance(seq_col, int):
        if not 0 <= seq_col < len(header):
            raise SequenceError(f"there is no column {seq_col}")
        return seq_col
    names = [bare(h).lower() for h in header]
    wanted = [seq_col.lower()] if seq_col else SEQUENCE_COLUMNS
    for i, name in enumerate(names):
        if name in wanted:
            return i
    raise SequenceError("the sequence column is not known; give seq_col")


def parse_dsv(text: str, delimiter: str, seq_col: str | int | None = None, header: bool = True) -> tuple[list[str], str | None]:
    """The raw sequence fields of a delimited text up to its first row of wrong shape, and what is wrong with that.

    The first row sets the number of columns. An empty field at a row's end is not seen, as the row ends before it.
    """
    lines = split_fields(text, delimiter)
    done, last = next(lines)
    first = [*done, last]
    if any(not bare(x) for x in first):
        raise SequenceError("First row has empty column")
    at, n = column_of(first, seq_col), len(first)
    out = []
    for done, last in lines if header else chain([(done, last)], lines):
        if not done and not last:
            continue
        row, fields = len(out) + 1, [*done, last] if last or not done else done
        if len(fields) <= at:
            return out, f"DSV row #{row} has no sequence column"
        out.append(bare(fields[at]))
        if len(fields) != n:
            return out, f"DSV row #{row} has too {'few' if len(fields) < n else 'many'} columns"
    return out, None


def _fields(text: str, delimiter: str) -> tuple[list[str], int]:
    """A row's fields, and how many it has as its end is seen; one empty field for a blank row."""
    done, last = next(split_fields(text, delimiter), ([], ""))
    return [*done, last], len(done) + (last != "" or not done)


def _dsv_fragments(batches):
    """Lines of a piece put together to rows; odd: whether the piece starts inside quotes. Blank rows are left out, but for
    a file's first."""
    at, k, data, quoted = None, 0, None, False
    for b in batches:
        out = []
        for value, odd, *where in zip(b["value"], b["odd"].tolist(), b["_file"], b["_piece"].tolist()):
            new = where != at
            if new or not quoted:
                if data is not None:
                    out.append((*at, k, "\n".join(data)))
                if new:
                    at, k, quoted = where, 0, odd
                data = None
            if quoted:
                data = [] if data is None else data
                data.append(value)
            elif value or (new and where[1] == 0):
                k, data = k + 1, [value]
            quoted ^= value.count('"') % 2 == 1
        if out:
            yield _made(out)
    if data is not None:
        yield _made([(*at, k, "\n".join(data))])


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The lines of delimited files put together to rows as far as a piece goes, saved: _file, _piece, _k and data.

    A line end is data where a quote is open. Any quote opens or closes quoting, and a doubled one inside quotes does both,
    so a quote is open after an odd number of them: pieces are counted side by side, and whether a piece starts inside
    quotes follows from the sums of those before.
    """
    lines = _text(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = _before(lines.groupBy("_file", "_piece").agg(F.sum(quotes).alias("_n")), "_n", each_file=True)
    lines = _with_before(lines, odd).select("value", (F.col("_before") % 2 == 1).alias("odd"), "_file", "_piece")
    return saved(lines.mapInPandas(_dsv_fragments, FRAGMENT), name)


def read_dsv(spark: SparkSession, path: str, alphabet: str, max_length: int | None = None, seq_col: str | int | None = None, header: bool = True) -> DataFrame:
    """Delimited text by the rules of parse_dsv, in pieces at line ends, whatever the size of a file: only a row has to fit
    a task. The files of a folder have headers of their own, and numbers go on from file to file in order of names. An
    error names the first row in this order that is wrong."""
    delimiter = DELIMITERS[extension(path)]
    lines = _lines(spark, path, "dsv-rows")
    rows = _records(lines, "\n").withColumnRenamed("data", "text")
    first = rows.groupBy("_file").agg(F.min_by("text", "_row").alias("text"), F.min("_row").alias("_head"))

    @F.pandas_udf("struct<n:int,at:int,error:string>")
    def shape(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            names, _ = _fields(t, delimiter)
            try:
                if any(not bare(x) for x in names):
                    raise SequenceError("First row has empty column")
                out.append((len(names), column_of(names, seq_col), None))
            except SequenceError as e:
                out.append((len(names), -1, str(e)))
        return pd.DataFrame(out, columns=["n", "at", "error"])

    headers = F.row_number().over(Window.orderBy("_file")) - 1 if header else F.lit(0)  # of the files before
    heads = _sent(first.select("_file", "_head", headers.alias("_headers"), shape("text").alias("shape")).select("_file", "_head", "_headers", "shape.*"), "dsv-headers")

    @F.pandas_udf("struct<raw:string,count:int>")
    def field(text: pd.Series, at: pd.Series) -> pd.DataFrame:
        split = [_fields(t, delimiter) for t in text]
        return pd.DataFrame({"raw": [bare(f[k]) if 0 <= k < n and f != [""] else None for (f, n), k in zip(split, at)], "count": [0 if f == [""] else n for f, n in split]})

    rows = rows.join(heads, "_file").withColumn("f", field("text", "at")).select("_file", "_row", "_head", "_headers", "n", "at", "error", "f.*")
    below = (F.col("_row") > F.col("_head")) if header else F.lit(True)
    data = (F.col("count") > 0) & below
    few = F.when(F.col("count") <= F.col("at"), "has no sequence column").when(F.col("count") < F.col("n"), "has too few columns").when(F.col("count") > F.col("n"), "has too many columns")
    wrong = F.when(F.col("error").isNotNull(), F.when(F.col("_row") == F.col("_head"), F.col("error"))).when(data, few)
    raw = F.when(data & F.col("error").isNull(), F.col("raw"))
    # up to the first wrong row, every row below a header has a sequence
    ord_ = F.col("_row") - 1 - F.col("_headers") - (below.cast("int") if header else 0)
    seq = strip_blanks(upper_ascii(raw), quotes=True)
    rows = saved(rows.select("_file", "_row", "_head", ord_.cast("int").alias("ord"), seq.alias("seq"), wrong.alias("wrong"), data.alias("data")), "dsv-fields", lines)
    if rows.where("seq is not null or wrong is not null").isEmpty():
        raise SequenceError("the file is empty")
    seqs = rows.where("seq is not null").select("ord", "seq")
    bad = rows.where("wrong is not null").agg(F.min(F.struct("_file", "_row", "_head", "ord", "wrong", F.col("seq").isNotNull().cast("int").alias("has"))).alias("m")).first()["m"]
    if bad is None:
        raise_first_fault(seqs, alphabet, max_length)
        return at_least_two(seqs)
    raise_first_fault(seqs.where(F.col("ord") < bad["ord"] + bad["has"]), alphabet, max_length)
    if bad["_row"] == bad["_head"] and not bad["wrong"].startswith("has "):
        raise SequenceError(bad["wrong"])
    place = rows.where((F.col("_file") == bad["_file"]) & (F.col("_row") <= bad["_row"]) & F.col("data")).count()
    raise SequenceError(f"DSV row #{place} {bad['wrong']}")


def read_dsv_relaxed(spark: SparkSession, path: str, seq_col: str, order_col: str, delimiter: str = ",") -> DataFrame:
    """Large well-formed delimited text by Spark's own reader, in parallel: order_col and seq."""
    df = spark.read.csv(path, sep=delimiter, header=True, quote='"', escape='"')
    return df.select(F.col(order_col).cast("long").alias(order_col), strip_blanks(upper_ascii(F.col(seq_col))).alias("seq"))


register_reader(FASTA_EXTENSIONS, read_fasta)
register_reader(DELIMITERS, read_dsv)


