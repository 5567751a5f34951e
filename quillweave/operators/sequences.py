"""Sequence sets: normalise, check, number, encode, and their statistics.

A sequence set is a DataFrame of ord (dense from 0) and seq (upper-case letters of one alphabet).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillweave.plans.store import saved

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_SEQUENCES = 2


class SequenceError(ValueError):
    """A sequence set that cannot be used; sequences are counted from 1."""


def upper_ascii(seq: Column) -> Column:
    """A-Z only, so that no other letter changes; where there are no others, the faster function."""
    return F.when(F.octet_length(seq) == F.length(seq), F.upper(seq)).otherwise(F.translate(seq, LOWER, UPPER))


def strip_blanks(seq: Column, quotes: bool = False) -> Column:
    """Without carriage returns, line feeds and spaces, and without quotes if asked."""
    for blank in '\r\n "' if quotes else "\r\n ":
        seq = F.replace(seq, F.lit(blank), F.lit(""))
    return seq


def letters(alphabet: str) -> str:
    """The inside of a character class that matches the alphabet in either case."""
    return "".join(alphabet + alphabet.lower()).replace("**", "*")


def derive(text: Column, alphabet: str, length: int | None = None) -> Column:
    """The letters of the alphabet in a text, in upper case, cut to a length."""
    seq = F.upper(F.regexp_replace(text, f"[^{letters(alphabet)}]+", ""))  # letters of the alphabet alone are left
    return F.substring(seq, 1, length) if length else seq


def fault(seq: Column, alphabet: str, max_length: int | None = None) -> Column:
    """What is wrong with a normalised sequence: corrupted, invalid, empty or exceeds length limits; else null."""
    out = F.when(seq.isNull() | (F.length(seq) == 0), "empty")
    out = out.when(seq.rlike(f"[^{alphabet}]"), F.when(seq.rlike("[^\\x01-\\x7f]"), "corrupted").otherwise("invalid"))
    return out.when(F.length(seq) > max_length, "exceeds length limits") if max_length else out


def report(seqs: DataFrame, alphabet: str, max_length: int | None = None, seq_col: str = "seq") -> DataFrame:
    """Each row with its fault."""
    return seqs.withColumn("fault", fault(F.col(seq_col), alphabet, max_length))


def raise_first_fault(seqs: DataFrame, alphabet: str, max_length: int | None = None) -> None:
    """A SequenceError for the first faulty sequence, if there is one."""
    good = F.col("seq").rlike(f"\\A[{alphabet}]+\\z")  # one look at most rows
    good = good & (F.length("seq") <= max_length) if max_length else good
    first = report(seqs.where(~F.coalesce(good, F.lit(False))), alphabet, max_length).where("fault is not null").agg(F.min(F.struct("ord", "fault")).alias("f")).first()["f"]
    if first is not None:
        raise SequenceError(f"Sequence #{first['ord'] + 1} {'' if first['fault'].startswith('exceeds') else 'is '}{first['fault']}")


def check(seqs: DataFrame, alphabet: str, max_length: int | None = None) -> DataFrame:
    """The set itself, or a SequenceError that names its first faulty sequence or its want of sequences."""
    raise_first_fault(seqs, alphabet, max_length)
    return at_least_two(seqs)


def at_least_two(seqs: DataFrame) -> DataFrame:
    if seqs.limit(MIN_SEQUENCES).count() < MIN_SEQUENCES:
        raise SequenceError(f"not enough sequences, at least {MIN_SEQUENCES} are needed")
    return seqs


def renumber(seqs: DataFrame, order: str = "ord", seq: Column | None = None) -> DataFrame:
    """ord dense from 0 in the given order, without one task for all rows: range partitions are sorted and stored, and a
    row's place in its partition is added to the rows of those before. Nothing is shuffled a second time.

    Rows that tie in the order come in order of their sequences. More rows than ord can number are an error. seq: what the
    sequence is made of, which then happens once and not for the sample of the order, too; of the columns only seq is kept.
    """
    rows = seqs.repartitionByRange(order)
    rows = rows if seq is None else rows.select(order, seq.alias("seq"))
    kept = [c for c in rows.columns if c not in ("ord", order)]
    ties = [c for c in ("seq",) if c in rows.columns and c != order]
    # this number is the partition's in the upper bits, and in the lower 33 the row's within it
    parts = saved(rows.sortWithinPartitions(order, *ties).select(*kept, F.monotonically_increasing_id().alias("_at")), "parts")
    if parts.count() >= 2**31:
        raise SequenceError("too many sequences to number")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = parts.withColumn("_part", part).join(F.broadcast(before.drop("_n")), "_part")  # one row per partition
    return joined.select((F.col("_before") + within).cast("int").alias("ord"), *kept)


def from_dataframe(df: DataFrame, seq_col: str, order_col: str, alphabet: str, max_length: int | None = None) -> DataFrame:
    """A checked sequence set from any DataFrame, numbered by order_col."""
    named = df.select(F.col(order_col).alias("_order"), strip_blanks(upper_ascii(F.col(seq_col))).alias("seq"))
    return check(renumber(named, "_order"), alphabet, max_length)


def encoded(seqs: DataFrame, alphabet: str) -> DataFrame:
    """Long form: ord, pos (from 1) and code."""
    letters_ = F.slice(F.split("seq", ""), 1, F.length("seq"))  # without the empty string at the end
    code = F.expr(f"cast(instr('{alphabet}', letter) - 1 as int)")
    return seqs.select("ord", F.posexplode(letters_).alias("pos", "letter")).select("ord", (F.col("pos") + 1).alias("pos"), code.alias("code"))


def stats(seqs: DataFrame) -> DataFrame:
    """num, max_len, total (lengths with one more each) and mean_len as a single-precision number."""
    size = F.length("seq")
    return seqs.agg(
        F.count(F.lit(1)).alias("num"),
        F.max(size).cast("int").alias("max_len"),
        F.sum(size + 1).cast("long").alias("total"),
        F.avg(size).cast("float").alias("mean_len"),
    )
