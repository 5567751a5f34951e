"""Conversation structure repair by signatures.

Each row of a conversation gets a letter for its role and fault, and the letters in order are the conversation's
signature. Each distinct signature is solved once, by memoised recursion over its suffixes, into the cheapest edits; they
are joined back to the conversations, and replayed on their rows.

Letters: s, u, a for rows that open their role with that letter, x for others; in upper case if the row is truncated; d if
it must go (blank or duplicate). Edits: D deletes, I inserts an empty user or assistant row, K keeps, R turns a row into
user or assistant. What is left has the roles (s?(ua)+)?, so an edit string determines every role: with an odd number of
rows the first is the system's, and user and assistant take turns. Ties go to the least edit string.

A conversation may hold a third of all rows. Equal rows of a turn are put together before any shuffle; earlier equal rows
are found by aggregates per role and text; rows are ordered by range partitions of slim rows without texts, which split a
long conversation, and each part's letters are joined to the others'. Signatures that many conversations share are sent to
all tasks. Edits are rows of their own when they are replayed, joined by conversation and place, so that texts are
shuffled evenly. What remains whole in one row is a conversation's signature and edit string, a byte per row, as the
edit string is the result. conversation_hashes() feeds a conversation's rows one by one to a hash, in one task, as such a
hash is sequential; it holds no more than a batch.

Cases: null roles and texts are one space, hence blank; a null conversation id is a conversation of its own; null turns
come first; rows of one turn come by role, then by a hash of the text; an unknown or empty role is x; repeated rows are
duplicates, and texts of one role and conversation are told apart by 64-bit hashes; very long texts are taken whole; an empty table gives empty results; only the four columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillweave.llm.common import HOT, SPACE, joined, saved, table

ROLES = {"u": "user", "a": "assistant"}
#: From start, after s, after u, after a: the state that a role leads to. Start and after a may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MAY_END = (0, 3)
#: The role that can be inserted, or given to a row, in each state.
GIVEN = ("u", "u", "a", "u")
NEVER = 1 << 60
#: Recursion goes so deep before its results are kept.
DEPTH = 400
#: Longest signature that is sent to all tasks.
SENT = 4096
#: Edits of a batch that leaves a worker.
BATCH = 100_000


@dataclass(frozen=True)
class Costs:
    delete: int = 4
    insert: int = 3
    rerole: int = 3
    truncated: int = 3  # of a truncated row that stays

    def __post_init__(self) -> None:
        if min(self.delete, self.rerole, self.truncated) < 0 or self.insert <= 0:
            raise ValueError("costs are 0 or more, that of an insertion more")


@lru_cache(maxsize=100_000)
def _column(letter: str, after: tuple[int, ...], costs: Costs) -> tuple[tuple[int, ...], str]:
    """Least cost from each state, less the least of them, and the first edit there; after: the same of the next row.

    From one state, edits with the same letter have the same outcome, so the first letter settles every tie.
    """
    best = []
    for state in range(4):
        if not letter:
            best.append((0, "") if state in MAY_END else (NEVER, "~"))
            continue
        options = [(after[state] + costs.delete, "D")]
        if letter != "d":
            role, extra = letter.lower(), costs.truncated * letter.isupper()
            if role in STEPS[state]:
                options.append((after[STEPS[state][role]] + extra, "K"))
            if role != GIVEN[state]:
                options.append((after[STEPS[state][GIVEN[state]]] + costs.rerole + extra, "R"))
        best.append(min(options))
    for _ in range(3):  # as many insertions in a row as can be of use
        best = [min(b, (best[STEPS[state][GIVEN[state]]][0] + costs.insert, "I")) for state, b in enumerate(best)]
    return tuple(cost for cost, _ in best), "".join(op or "." for _, op in best)


def solve(signature: str, costs: Costs = Costs()) -> tuple[int, str]:
    """The least cost and the least string of edits that reaches it."""
    n = len(signature)
    memo: dict[int, tuple[int, tuple[int, ...], str]] = {}  # cost of the column's least state, the others above it, first edits

    def column(i: int) -> tuple[int, tuple[int, ...], str]:
        if i not in memo:
            least, above = column(i + 1)[:2] if i < n else (0, (0,) * 4)
            found, ops = _column(signature[i] if i < n else "", above, costs)
            low = min(found)
            memo[i] = least + low, tuple(x - low for x in found), ops
        return memo[i]

    for i in range(n, 0, -DEPTH):
        column(i)
    least, above, _ = column(0)
    state, i, out = 0, 0, []
    while (op := column(i)[2][state]) != ".":
        out.append(op)
        if op in "IR":
            state = STEPS[state][GIVEN[state]]
        elif op == "K":
            state = STEPS[state][signature[i].lower()]
        i += op != "I"
    return least + above[0], "".join(out)


def _key(of: Column) -> Column:
    """A value as text, null as the empty one."""
    return F.coalesce(F.concat(F.lit("="), of.cast("string")), F.lit(""))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct rows with their texts; slim rows with their place; and a row per conversation with counts and signature.

    rows: conv, turn, role, text without nulls in the last two. A slim row has c, t, role, h (the key of its text), place
    (from 0, that of its first copy).
    """
    keyed = rows.select(_key(F.col("conv")).alias("c"), "conv", _key(F.col("turn")).alias("t"), "turn", "role", F.xxhash64("text").alias("h"), "text")
    once = saved(keyed.groupBy("c", "t", "role", "h").agg(F.first("conv").alias("conv"), F.first("turn").alias("turn"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "conversation-rows")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1).isin(*".!?")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    slim = saved(once.select("c", "t", "role", "h", order.alias("turn"), "n", blank.alias("blank"), cut.alias("cut"), F.struct("c", "role", "h").alias("same")), "conversation-slim")
    # of rows that share role and text within a conversation, those after the first
    firsts = slim.groupBy("same").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    firsts = saved(firsts, "conversation-firsts")
    flagged = joined(slim, firsts, "same", "m", slim.count()).withColumn("late", F.coalesce(F.col("turn") > F.col("first"), F.lit(False)))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    gone = F.col("blank") | F.col("late")
    letter = F.when(gone, F.lit("d")).when(F.col("cut"), F.upper(kind)).otherwise(kind)
    copies = F.col("n").cast("int")
    flagged = flagged.select(
        "c", "t", "role", "h", "turn", "n", initial.alias("initial"), F.concat(letter, F.repeat(F.lit("d"), copies - 1)).alias("letters"),
        F.when(F.col("blank"), F.col("n")).otherwise(F.lit(0)).alias("n_blank"),
        F.when(F.col("blank"), F.lit(0)).otherwise(F.col("n") - F.when(F.col("late"), 0).otherwise(1)).alias("n_duplicate"),
        F.when(~gone & F.col("cut"), 1).otherwise(0).alias("n_truncated"),
    )
    ranged = saved(flagged.repartitionByRange("c", "turn", "role", "h").withColumn("part", F.spark_partition_id()), "conversation-parts", slim, firsts)
    inside = Window.partitionBy("part", "c").orderBy("turn", "role", "h")
    apart = lambda before, then: F.when(before.isNotNull() & ~F.concat(before, then).isin("su", "ua", "au"), 1).otherwise(0)
    ranged = ranged.withColumns({
        "within": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
        "n_illegal": apart(F.lag("initial").over(inside), F.col("initial")) + F.col("n") - 1,
    })
    ranged = saved(ranged, "conversation-within", ranged)
    sums = ("n_blank", "n_duplicate", "n_truncated", "n_illegal")
    pieces = F.sort_array(F.collect_list(F.struct("within", "letters")))
    parts = ranged.groupBy("c", "part").agg(
        F.sum("n").alias("n"), F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("letters"),
        F.min_by("initial", "within").alias("opens"), F.max_by("initial", "within").alias("closes"), *[F.sum(s).alias(s) for s in sums],
    )
    along = Window.partitionBy("c").orderBy("part")  # a row for each range partition that a conversation lies in
    parts = parts.withColumns({"base": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "n_illegal": F.col("n_illegal") + apart(F.lag("closes").over(along), F.col("opens"))})
    parts = saved(parts, "conversation-segments")
    places = ranged.join(parts.select("c", "part", "base"), ["c", "part"]).select("c", "t", "role", "h", (F.col("base") + F.col("within")).alias("place"))
    pieces = F.sort_array(F.collect_list(F.struct("part", "letters")))
    whole = parts.groupBy("c").agg(F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("signature"), *[F.sum(s).cast("long").alias(s[2:]) for s in sums])
    turns = once.groupBy("c", "t").agg(F.first("conv").alias("conv"), F.first("turn").alias("turn"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    whole = whole.join(turns.groupBy("c").agg(F.first("conv").alias("conv"), gaps.alias("gaps")), "c")
    return once, places, whole


def _solved(batches, costs: Costs):
    for pdf in batches:
        found = [solve(s, costs) for s in pdf["signature"]]
        yield pdf.assign(cost=[c for c, _ in found], audit=[a for _, a in found])


def audits_of(whole: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """whole with the cost and audit of each signature, which is solved once."""
    whole = saved(whole, "conversations")
    each = whole.groupBy("signature").agg(F.count(F.lit(1)).alias("m"))
    solved = saved(each.mapInPandas(lambda b: _solved(b, costs), "signature string, m long, cost long, audit string"), "signatures")
    # a signature of length L that a share of the conversations has also has that share of L rows: few long ones are common
    common = (F.col("m") > whole.count() // HOT) & (F.length("signature") <= SENT)  # fewer than HOT rows
    many, facts = F.broadcast(solved.where(common).drop("m")), solved.where(~common).drop("m")
    rest = whole.join(many.select("signature"), "signature", "left_anti").join(facts, "signature")
    return saved(rest.unionByName(whole.join(many, "signature")), "audits", whole, solved)


def edits(audits: DataFrame) -> DataFrame:
    """c, place (of a row that stays, else null), position in the repaired conversation, edit (K, R or I) and new role."""

    def unfold(batches):
        for pdf in batches:
            for c, audit in zip(pdf["c"], pdf["audit"]):
                stays = len(audit) - audit.count("D")
                place = position = 0
                for lo in range(0, len(audit), BATCH):
                    ops = np.frombuffer(audit[lo : lo + BATCH].encode(), "S1")
                    takes, leaves = ops != b"I", ops != b"D"
                    places, positions = place + np.cumsum(takes) - takes, position + np.cumsum(leaves) - leaves
                    place, position = place + int(takes.sum()), position + int(leaves.sum())
                    new = np.where((positions - stays % 2) % 2 == 0, ROLES["u"], ROLES["a"]).astype(object)
                    new[ops == b"K"] = None
                    out = pd.DataFrame({"c": c, "place": pd.array(places, "Int64"), "position": positions, "edit": ops.astype(str), "new_role": new})
                    out.loc[~takes, "place"] = pd.NA
                    yield out[leaves]

    return audits.select("c", "audit").mapInPandas(_gathered(unfold), "c string, place long, position long, edit string, new_role string")


def _gathered(make):
    """Small frames put together before they leave."""

    def run(batches):
        held, n = [], 0
        for pdf in make(batches):
            held.append(pdf)
            n += len(pdf)
            if n >= BATCH:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """Audits (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, signature) and repaired rows (conv, position
    from 0, turn, role, text, edit), both with c, the conversation's key; inserted rows have no turn and an empty text."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    once, places, whole = placed(rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text")))
    audits = audits_of(whole, costs)
    todo = saved(edits(audits), "edits")
    stay = todo.where("place is not null").join(places, ["c", "place"])
    stay = stay.join(once, ["c", "t", "role", "h"]).select("c", "conv", "position", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    new = todo.where("place is null").join(audits.select("c", "conv"), "c").select("c", "conv", "position", F.lit(None).cast(once.schema["turn"].dataType).alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return audits, stay.unionByName(new)


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """c and sha256 (lowercase hex) of role:text of all rows, joined by line ends, row by row."""

    def hashes(batches):
        now, state = None, None
        for pdf in batches:
            out = []
            for c, role, text in zip(pdf["c"], pdf["role"], pdf["text"]):
                if c != now or state is None:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["c", "sha256"])
        if state is not None:
            yield pd.DataFrame({"c": [now], "sha256": [state.hexdigest()]})

    return repaired.select("c", "position", "role", "text").repartition("c").sortWithinPartitions("c", "position").mapInPandas(hashes, "c string, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """conv, turn, role and text of conversations, damaged by the contract's rule; nulls as one space but in conv and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    audits, repaired = repair(damage(rows), "conv")
    every = rows.select(_key(F.col("conv_id")).alias("c"), "conv_id").groupBy("c").agg(F.first("conv_id").alias("conv_id"))
    out = every.join(audits.drop("conv"), "c", "left").join(conversation_hashes(repaired), "c", "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
