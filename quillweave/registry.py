"""Queries of the sequence operators, and SQL for those that SQL can express.

The queries of pairs take the distinct part names, which are 62 to 64 short strings at any size. Each has a twin, named
with _whole, over a whole table with its copies: all rows of part where pairs are made, all documents where one pass is
enough. SQL of a twin scores the distinct names and joins their copies to it. Whole benchmark texts show the speed of the
batched kernel.
"""

from __future__ import annotations

import functools
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.functions.matrices import AMINO, BLOSUM_NAMES, NUCLEOTIDE, NUCLEOTIDE_NAMES, PAM_NAMES, STRIDE, get_matrix, list_matrices, matrix_rows
from quillweave.operators.blosum import pair_weights, scores
from quillweave.operators.copies import by_distinct
from quillweave.operators.pairs import all_pairs, identified_pairs, numbered_pairs
from quillweave.operators.score import dense_texts, long_scores, register_functions, register_table_function, score_all, score_all_sql, score_pairs, tiles_view, write_scores
from quillweave.operators.sequences import SequenceError, check, derive, encoded, from_dataframe, letters, report, renumber, stats, strip_blanks, upper_ascii
from quillweave.operators.similarity_filter import edges, greedy_filter, identity_shares, similar_pairs
from quillweave.plans.config import ScoringConfig
from quillweave.plans.run import align
from quillweave.plans.store import Scope, saved, shared_folder
from quillweave.sources.fasta_source import read_records
from quillweave.sources.readers import read_sequences
from quillweave.sources.tiles import row_totals
from quillweave.streaming.incremental import score_stream

ALPHABETS = {"protein": AMINO, "dna": NUCLEOTIDE}
CONFIGS = {
    ("nw", "protein"): ScoringConfig("nw", "blosum62", gap=4),
    ("nw", "dna"): ScoringConfig("nw", "dnafull", gap=5),
    ("ga", "protein"): ScoringConfig("ga", "pam250", gap_open=12, gap_extend=2),
    ("ga", "dna"): ScoringConfig("ga", "nuc44", gap_open=10, gap_extend=1),
    ("sw", "protein"): ScoringConfig("sw", "blosum62", gap_open=10, gap_extend=1),
    ("sw", "dna"): ScoringConfig("sw", "dnafull", gap_open=10, gap_extend=1),
}
EQUAL_GAPS = ScoringConfig("ga", "blosum62", gap_open=4, gap_extend=4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_seqs(spark: SparkSession, sf_dir: str, kind: str = "protein") -> DataFrame:
    """The distinct part names as sequences, in order of their letters."""
    seqs = _table(spark, sf_dir, "part").select(derive(F.col("p_name"), ALPHABETS[kind]).alias("seq")).where("seq <> ''").distinct()
    return saved(renumber(seqs.withColumn("of", F.col("seq")), "of"), "part-seqs")


def benchmark_seqs(spark: SparkSession, sf_dir: str, kind: str = "protein") -> DataFrame:
    texts = _table(spark, sf_dir, "benchmark").select("item_id", derive(F.col("text"), ALPHABETS[kind]).alias("seq")).where("seq <> ''")
    return from_dataframe(texts, "seq", "item_id", ALPHABETS[kind])


def part_rows(spark: SparkSession, sf_dir: str, kind: str = "protein") -> DataFrame:
    """The names of all parts as sequences, copies included, in order of p_partkey."""
    names = _table(spark, sf_dir, "part").select("p_partkey", derive(F.col("p_name"), ALPHABETS[kind]).alias("seq")).where("seq <> ''")
    return from_dataframe(names, "seq", "p_partkey", ALPHABETS[kind])


def document_seqs(spark: SparkSession, sf_dir: str, kind: str = "protein") -> DataFrame:
    """The texts of all documents as sequences, copies included, in order of doc_id."""
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").rlike(f"[{letters(ALPHABETS[kind])}]"))
    return check(renumber(texts, "doc_id", derive(F.col("text"), ALPHABETS[kind])), ALPHABETS[kind])


def _derive(kind: str):
    return lambda spark, d: _table(spark, d, "documents").select("doc_id", derive(F.col("text"), ALPHABETS[kind]).alias("seq"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return stats(_derive("protein")(spark, d).where("seq <> ''"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    seqs = _table(spark, d, "documents").select("doc_id", strip_blanks(upper_ascii(F.col("text"))).alias("seq"))
    return report(seqs, AMINO).select("doc_id", "fault")


def _scored(method: str, kind: str, table=part_seqs):
    return lambda spark, d: score_all(table(spark, d, kind), CONFIGS[method, kind])


def _sql_backend(method: str, table=part_seqs):
    return lambda spark, d: score_all_sql(table(spark, d), CONFIGS[method, "protein"])


def _identity(seqs: DataFrame) -> DataFrame:
    return by_distinct(seqs, lambda once: identified_pairs(once, identity_shares), lambda same: same.select("i", "j", F.lit(1).cast("float").alias("identity")))


def _long(spark: SparkSession, d: str, table=part_seqs) -> DataFrame:
    return long_scores(table(spark, d), CONFIGS["nw", "protein"])


def _dense(spark: SparkSession, d: str, table=part_seqs) -> DataFrame:
    return dense_texts(table(spark, d), CONFIGS["nw", "protein"])


def _filtered(spark: SparkSession, d: str, table=part_seqs) -> DataFrame:
    return score_all(saved(greedy_filter(table(spark, d), 0.5), "filtered"), CONFIGS["nw", "protein"])


def _fasta(spark: SparkSession, d: str, table=part_seqs) -> DataFrame:
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}.fasta"
    seqs = table(spark, d)
    lines = F.concat(F.lit(">part "), F.col("ord"), F.lit("\n"), F.regexp_replace("seq", "(.{5})", "$1\n"))
    _in_order(seqs).select(lines).write.text(path)
    return read_sequences(spark, path, AMINO)


def _in_order(seqs: DataFrame) -> DataFrame:
    """In parts that follow one another, for files in order of their names."""
    return seqs.repartitionByRange(seqs.sparkSession.sparkContext.defaultParallelism, "ord").sortWithinPartitions("ord")


def _dsv(spark: SparkSession, d: str, table=part_seqs) -> DataFrame:
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}.psv"
    seqs = table(spark, d)
    note = F.when(F.col("ord") % 3 == 0, F.lit('said "two"\nlines, | twice')).otherwise("x")
    rows = _in_order(seqs).select(F.concat(F.lit("part|"), F.col("ord")).alias("name"), F.lower("seq").alias("Protein"), note.alias("note"))
    rows.write.csv(path, sep="|", header=True, quoteAll=True, escape='"')
    return read_sequences(spark, path, AMINO)


def _fasta_folder(spark: SparkSession, d: str) -> DataFrame:
    """The sequences of a folder of FASTA files, numbered on from file to file."""
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}.fasta"
    lines = F.concat(F.lit(">document "), F.col("ord"), F.lit("\n"), F.lower("seq"))
    _in_order(document_seqs(spark, d)).select(lines).write.text(path)
    return read_sequences(spark, path, AMINO)


def _fasta_source(spark: SparkSession, d: str) -> DataFrame:
    """The same files through the data source, in ranges of bytes, checked and numbered."""
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}.fasta"
    lines = F.concat(F.lit(">part "), F.col("ord"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    _in_order(document_seqs(spark, d)).select(lines).write.text(path)
    return from_dataframe(read_records(spark, path, 1 << 20), "data", "of", AMINO)


def _sink(spark: SparkSession, d: str) -> DataFrame:
    """What a whole run writes, read again: each sequence with its row of the matrix."""
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}"
    align(spark, part_seqs(spark, d), CONFIGS["nw", "protein"], path, compression=3)
    seqs, rows = (spark.read.parquet(f"{path}/{x}") for x in ("sequences", "similarity"))
    return seqs.join(rows, "ord").select("ord", "seq", F.array_join("scores", " ").alias("scores"))


def _removed(spark: SparkSession, d: str) -> DataFrame:
    seqs = part_rows(spark, d)
    stay = seqs.select(F.lit(False).alias("stays")).union(greedy_filter(seqs, 0.5).select(F.lit(True)))
    return stay.agg(F.count_if(~F.col("stays")).alias("before"), F.count_if("stays").alias("after")).withColumn("removed", F.col("before") - F.col("after"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Scores and shares by the functions that SQL can call."""
    register_functions(spark, CONFIGS["nw", "protein"])
    name = f"pairs_{uuid.uuid4().hex}"
    all_pairs(part_seqs(spark, d)).createTempView(name)
    return spark.sql(f"select i, j, align_score(seq_j, seq_i) as score, positional_identity(seq_i, seq_j) as identity from {name}")


def _table_function(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the names of all parts by the table function, from SQL; copies are told what it finds of their names."""
    config = CONFIGS["nw", "protein"]
    register_table_function(spark, config)

    def scored(seqs: DataFrame) -> DataFrame:
        name = f"tiles_{uuid.uuid4().hex}"
        tiles_view(seqs, name)
        return spark.sql(f"select i, j, score from align_tiles(table({name}) partition by (lo, hi))")

    return by_distinct(part_rows(spark, d), scored, lambda same: score_pairs(same, config).select("i", "j", "score"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Names of all nations as they arrive, against the part names."""
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}"
    kind = _table(spark, d, "nation").schema
    arriving = spark.readStream.schema(kind).parquet(f"{d}/natio[n].parquet").select(F.col("n_nationkey").cast("long").alias("name"), derive(F.col("n_name"), AMINO).alias("seq"))
    scores = score_stream(arriving.where("seq <> ''"), part_seqs(spark, d), CONFIGS["nw", "protein"])
    scores.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/scores").awaitTermination()
    return spark.read.schema(scores.schema).parquet(f"{path}/scores")


def _blosum(spark: SparkSession, d: str) -> DataFrame:
    """Weights and scores estimated from blocks of the names of all parts, those of a length being a block."""
    blocks = part_rows(spark, d).select(F.length("seq").alias("block"), "seq")
    with Scope(spark) as scope:
        weights = {(r["a"], r["b"]): r["weight"] for r in pair_weights(blocks, 62, scope).where("weight > 1e-9").collect()}  # 210 rows at most
    table, _ = scores(weights)
    rows = [(a, b, round(w, 6), int(table[AMINO.index(a), AMINO.index(b)])) for (a, b), w in weights.items()]
    return spark.createDataFrame(rows, "a string, b string, weight double, score int")


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog, with the number of part names that a matrix can score as they are."""
    name = strip_blanks(upper_ascii(F.col("p_name")))
    fits = [F.struct(F.lit(kind).alias("kind"), F.count_if(name.rlike(f"^[{letters}]+$")).alias("fits")) for kind, letters in (("amino", AMINO), ("nucleotide", NUCLEOTIDE))]
    counted = _table(spark, d, "part").agg(F.array(*fits).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return list_matrices(spark).join(F.broadcast(counted), "kind").select("name", "kind", "fits")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """A matrix in long form, with the number of places where its two letters follow each other in the names of all parts."""
    names = part_rows(spark, d).where(F.length("seq") > 1)
    two = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - 1), lambda k: F.substring("seq", k, F.lit(2)))).alias("two"))
    counted = two.groupBy("two").agg(F.count(F.lit(1)).alias("n"))  # 576 rows at most
    cells = matrix_rows(spark, "blosum62").withColumn("two", F.concat("a", "b"))
    return cells.join(F.broadcast(counted), "two", "left").select("a", "b", "score", F.coalesce("n", F.lit(0)).alias("n"))


def _triangle(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the matrix of all part names, summed up, from the packed triangle that the scores were written to."""
    path = f"{shared_folder(spark)}/quillweave/{uuid.uuid4().hex}"
    write_scores(saved(part_rows(spark, d), "part-rows"), CONFIGS["nw", "protein"], path)
    return row_totals(spark, path)


#: Spellings of methods, and gaps that a configuration may be given.
SPELLINGS = {"nw": ["NW", "Needleman-Wunsch"], "ga": ["ga", "GOTOH"], "sw": ["Sw", "smith-waterman"]}
GAPS = [None, -1, 0, 4]


@functools.cache
def _scored_by(given: str, *gaps: str) -> str:
    try:
        return ScoringConfig(given, "BLOSUM62", *(int(g) if g else None for g in gaps)).resolved().method
    except ValueError:
        return "none"


def _gap_rules(spark: SparkSession, d: str) -> DataFrame:
    """A configuration from the numbers of each part: whether it is accepted, and the method that it is then scored by."""

    def judge(batches):
        for b in batches:
            b["scored_by"] = [_scored_by(*x) for x in zip(b["given"], b["gap"], b["gap_open"], b["gap_extend"])]
            yield b

    names = [*itertools.chain(*SPELLINGS.values())]
    one_of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    gap = lambda k: one_of(["" if g is None else str(g) for g in GAPS], k)
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = _table(spark, d, "part").select(
        *("p_partkey", one_of(names, key).alias("given"), gap(F.floor(key / len(names))).alias("gap")),
        *(gap(size).alias("gap_open"), gap(F.floor(size / len(GAPS))).alias("gap_extend")),
    )
    return rows.mapInPandas(judge, "p_partkey long, given string, gap string, gap_open string, gap_extend string, scored_by string")


def _set_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with whole sets: texts as they are, sequences of all parts, and one sequence alone."""
    texts = _table(spark, d, "documents").select("doc_id", strip_blanks(upper_ascii(F.col("text"))).alias("seq"))
    alone = _table(spark, d, "supplier").select(derive(F.col("s_name"), AMINO).alias("seq")).distinct()
    rows = []
    for name, make in (("documents", lambda: check(renumber(texts, "doc_id"), AMINO)), ("part", lambda: part_rows(spark, d)), ("supplier", lambda: check(alone.withColumn("ord", F.lit(0)), AMINO))):
        try:
            make()
            rows.append((name, None))
        except SequenceError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "name string, fault string")


def _operators(linear, pairs, end: str = "") -> dict:
    """The queries of the operators: those of one pass over one table, those of pairs over the other."""
    of = {
        "q_encode": lambda spark, d: encoded(linear(spark, d), AMINO),
        "q_pairs": lambda spark, d: numbered_pairs(pairs(spark, d)).select("i", "j"),
        "q_pair_index": lambda spark, d: numbered_pairs(pairs(spark, d)),
        "q_identity": lambda spark, d: _identity(pairs(spark, d)),
        "q_filter_edges_05": lambda spark, d: edges(pairs(spark, d), 0.5),
        "q_filter_greedy_09": lambda spark, d: greedy_filter(pairs(spark, d), 0.9),
        "q_filter_greedy_05": lambda spark, d: greedy_filter(pairs(spark, d), 0.5),
        **{f"q_{m}_{k}": _scored(m, k, pairs) for m, k in CONFIGS},
        "q_ga_equal_gap_rewrite": lambda spark, d: score_all(pairs(spark, d), EQUAL_GAPS),
        **{f"q_{m}_sql_backend": _sql_backend(m, pairs) for m in ("nw", "ga", "sw")},
        "q_matrix_long": lambda spark, d: _long(spark, d, pairs),
        "q_matrix_dense": lambda spark, d: _dense(spark, d, pairs),
        "q_filtered_nw": lambda spark, d: _filtered(spark, d, pairs),
        "q_fasta_roundtrip": lambda spark, d: _fasta(spark, d, linear),
        "q_dsv_roundtrip": lambda spark, d: _dsv(spark, d, linear),
    }
    return {name + end: query for name, query in of.items()}


QUERIES = {
    "q_list_matrices": _catalog,
    "q_matrix_scores": _matrix,
    "q_matrix_triangle": _triangle,
    "q_derive_protein": _derive("protein"),
    "q_derive_dna": _derive("dna"),
    "q_length_stats": _stats,
    "q_validate_report": _report,
    "q_filter_benchmark": lambda spark, d: greedy_filter(benchmark_seqs(spark, d), 0.1),
    **{f"q_{m}_benchmark": _scored(m, "protein", benchmark_seqs) for m in ("nw", "ga", "sw")},
    "q_fasta_folder": _fasta_folder,
    "q_fasta_source": _fasta_source,
    "q_sink_parquet": _sink,
    "q_filter_removed": _removed,
    "q_blosum_estimate": _blosum,
    "q_similar_documents_09": lambda spark, d: similar_pairs(document_seqs(spark, d), 0.9),
    "q_filter_documents_09": lambda spark, d: greedy_filter(document_seqs(spark, d), 0.9),
    "q_sql_functions": _functions,
    "q_table_function": _table_function,
    "q_stream_scores": _stream,
    "q_gap_rules": _gap_rules,
    "q_set_checks": _set_checks,
    **_operators(part_seqs, part_seqs),
    **_operators(document_seqs, part_rows, "_whole"),
}


# SQL for DuckDB


def _derived(column: str, kind: str) -> str:
    return f"upper(regexp_replace({column}, '[^{letters(ALPHABETS[kind])}]', '', 'g'))"


def _seqs(kind: str = "protein") -> str:
    return f"""d as (select distinct {_derived("p_name", kind)} as seq from part),
s as (select cast(row_number() over (order by seq) - 1 as integer) as ord, seq from d where seq <> '')"""


_IDENTITY = "cast(len(list_filter(range(1, least(length(a.seq), length(b.seq)) + 1), lambda k: a.seq[k] = b.seq[k])) / cast(least(length(a.seq), length(b.seq)) as double) as float)"
_SHORTER = "least(length(a.seq), length(b.seq))"
_HAMMING = f"cast(({_SHORTER} - hamming(left(a.seq, {_SHORTER}), left(b.seq, {_SHORTER}))) / cast({_SHORTER} as double) as float)"
_PAIRS = "from s a join s b on a.ord < b.ord"


def _codes(kind: str) -> str:
    return f"c as (select ord, list_transform(string_split(seq, ''), lambda x: strpos('{ALPHABETS[kind]}', x) - 1) as v from s)"


def _flat(matrix: str) -> str:
    return f"f as (select [{', '.join(str(int(x)) for x in get_matrix(matrix).scores.ravel())}] as f)"


def _linear(matrix: str, gap: int, kind: str, seqs: str | None = None) -> str:
    """Common tables up to w (i, j, score)."""
    cell = f"greatest(up[x[1]] + f[r[y[1]] * {STRIDE} + k[x[1]] + 1], up[x[1] + 1] - {gap}, w[x[1]] - {gap})"
    row = f"list_reduce(list_transform(range(1, len(k) + 1), lambda x: [x]), lambda w, x: list_append(w, {cell}), [-{gap} * y[1]])"
    table = f"list_reduce(list_transform(range(1, len(r) + 1), lambda y: [y]), lambda up, y: {row}, list_transform(range(0, len(k) + 1), lambda x: -{gap} * x))"
    return f"""{seqs or _seqs(kind)}, {_codes(kind)}, {_flat(matrix)},
p as (select a.ord as i, b.ord as j, a.v as r, b.v as k from c a join c b on a.ord < b.ord),
w as (select i, j, cast(({table})[-1] as integer) as score from p, f)"""


def _affine(matrix: str, o: int, e: int, kind: str, local: bool) -> str:
    e = min(o, e)  # as penalties: opening again may be cheaper than extending
    low = -(2**30)
    diagonal = f"q.h[x.x] + f[q.r[q.y] * {STRIDE} + q.k[x.x] + 1]"
    gx, g = f"greatest(w.h[-1] - {o}, w.gx - {e})", f"greatest(q.h[x.x + 1] - {o}, q.g[x.x + 1] - {e})"
    h = f"greatest({'0, ' if local else ''}{diagonal}, {gx}, {g})"
    edge = "0" if local else f"-{o} - (q.y - 1) * {e}"
    top = "0" if local else f"case when x = 0 then 0 else -{o} - (x - 1) * {e} end"
    kind_ = "struct(x bigint, h bigint[], g bigint[], gx bigint)"
    step = f"""list_reduce(list_transform(range(1, len(q.k) + 1), lambda x: cast({{'x': x, 'h': [0], 'g': [0], 'gx': 0}} as {kind_})),
    lambda w, x: cast({{'x': x.x, 'h': list_append(w.h, {h}), 'g': list_append(w.g, {g}), 'gx': {gx}}} as {kind_}),
    cast({{'x': 0, 'h': [{edge}], 'g': [{low}], 'gx': {low}}} as {kind_}))"""
    done = "max(best)" if local else "max(h[-1]) filter (y > len(r))"
    return f"""{_seqs(kind)}, {_codes(kind)}, {_flat(matrix)},
t(i, j, r, k, y, h, g, best) as (
  select a.ord, b.ord, a.v, b.v, 1, list_transform(range(0, len(b.v) + 1), lambda x: cast({top} as bigint)),
    list_transform(range(0, len(b.v) + 1), lambda x: cast({low} as bigint)), cast(0 as bigint) from c a join c b on a.ord < b.ord
  union all
  select i, j, r, k, y + 1, n.h, n.g, greatest(best, list_max(n.h)) from (select q.*, {step} as n from t q, f where q.y <= len(q.r))),
w as (select i, j, cast({done} as integer) as score from t group by i, j)"""


def _scores_sql(method: str, kind: str) -> str:
    cfg = CONFIGS[method, kind]
    if method == "nw":
        return f"with {_linear(cfg.matrix, cfg.gap, kind)} select i, j, score from w"
    return f"with recursive {_affine(cfg.matrix, cfg.gap_open, cfg.gap_extend, kind, method == 'sw')} select i, j, score from w"


def _greedy(threshold: float, seqs: str | None = None, identity: str = _IDENTITY) -> str:
    """Common tables up to z (ord, seq): the sequences that stay, numbered anew."""
    return f"""{seqs or _seqs()},
e as (select a.ord as i, b.ord as j {_PAIRS} where {identity} >= cast({threshold} as float)),
n as (select s.ord as j, list(e.i) filter (e.i is not null) as n from s left join e on e.j = s.ord group by s.ord),
l as (select list({{'j': [j], 'n': coalesce(n, cast([] as integer[]))}} order by j) as l from n),
k as (select unnest(list_reduce(l, lambda acc, x: case when list_has_any(acc.j, x.n) then acc else {{'j': list_append(acc.j, x.j[1]), 'n': x.n}} end, {{'j': cast([] as integer[]), 'n': cast([] as integer[])}}).j) as j from l),
z as (select cast(row_number() over (order by s.ord) - 1 as integer) as ord, s.seq from s join k on k.j = s.ord)"""


def _rows(of: str) -> str:
    """Common table s of whole tables: all rows of part, or all documents, copies included."""
    table, key, column = {"part": ("part", "p_partkey", "p_name"), "documents": ("documents", "doc_id", "text"), "benchmark": ("benchmark", "item_id", "text")}[of]
    return f"""d as (select {key} as k, {_derived(column, "protein")} as seq from {table}),
s as (select cast(row_number() over (order by k) - 1 as integer) as ord, seq from d where seq <> '')"""


_NORMAL = "regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\\r\\n ]', '', 'g')"
_W = _linear("blosum62", 4, "protein")
_LONG = "select i, j, score from w union all select j, i, score from w union all select ord, ord, 0 from s"

_ARRIVING = (
    _linear("blosum62", 4, "protein", f"{_seqs()}, a as (select n_nationkey as name, {_derived('n_name', 'protein')} as seq from nation)")
    .replace("p as (select a.ord as i, b.ord as j, a.v as r, b.v as k from c a join c b on a.ord < b.ord)", "p as (select c.ord as i, cast(n.name as bigint) as j, c.v as r, n.v as k from c, (select name, list_transform(string_split(seq, ''), lambda x: strpos('" + AMINO + "', x) - 1) as v from a where seq <> '') n)")
    .replace("select i, j, cast((", "select i as ord, j as name, cast((")
)
_GAP_LIST = f"[{', '.join('null' if g is None else str(g) for g in GAPS)}]"
_GAP_RULES = f"""with m(k, given, method) as (values {", ".join(f"({k}, '{x}', '{m}')" for k, (x, m) in enumerate((x, m) for m, names in SPELLINGS.items() for x in names))}),
c as (select p_partkey, given, method, {_GAP_LIST}[p_partkey // 6 % 4 + 1] as gap, {_GAP_LIST}[p_size % 4 + 1] as gap_open, {_GAP_LIST}[p_size // 4 % 4 + 1] as gap_extend from part join m on m.k = p_partkey % 6)
select p_partkey, given, coalesce(gap::varchar, '') as gap, coalesce(gap_open::varchar, '') as gap_open, coalesce(gap_extend::varchar, '') as gap_extend, coalesce(case
  when least(coalesce(gap, 0), coalesce(gap_open, 0), coalesce(gap_extend, 0)) < 0 then null
  when method = 'nw' then case when gap is not null and gap_open is null and gap_extend is null then 'nw' end
  when gap is not null or gap_open is null or gap_extend is null then null
  when method = 'ga' and gap_open = gap_extend then 'nw' else method end, 'none') as scored_by from c"""
_FAULT = f"case when seq is null or seq = '' then 'empty' when regexp_matches(seq, '[^\\x01-\\x7f]') then 'corrupted' when regexp_matches(seq, '[^{AMINO}]') then 'invalid' end"
_FIRST = f"select 'Sequence #' || k || ' is ' || fault from (select row_number() over (order by doc_id) as k, {_FAULT} as fault from (select doc_id, {_NORMAL} as seq from documents)) where fault is not null order by k limit 1"
_SET_CHECKS = f"""select 'documents' as name, ({_FIRST}) as fault union all select 'part', null union all
select 'supplier', case when count(distinct {_derived("s_name", "protein")}) < 2 then 'not enough sequences, at least 2 are needed' end from supplier"""

_BLOSUM = f"""with recursive {_rows("part")}, d2 as (select length(seq) as block, seq, count(*) as n from s group by all),
e as (select a.block, a.seq as x, b.seq as y from d2 a join d2 b on a.block = b.block where {_HAMMING} >= cast(0.62 as float)),
r(block, seq, root) as (select block, seq, seq from d2 union select e.block, e.y, r.root from r join e on e.block = r.block and e.x = r.seq),
k as (select block, seq, min(root) as cluster from r group by all),
z as (select block, cluster, sum(n) as size from d2 join k using (block, seq) group by all),
l as (select block, cluster, n / size as w, seq, unnest(range(1, block + 1)) as place from d2 join k using (block, seq) join z using (block, cluster)),
v as (select block, place, cluster, strpos('{AMINO[:20]}', seq[place]) as x, sum(w) as v from l where strpos('{AMINO[:20]}', seq[place]) > 0 group by all),
u as (select block, place, x, sum(v) as v from v group by all),
whole as (select a.x, b.x as y, sum(a.v * b.v) as s from u a join u b using (block, place) where a.x <= b.x group by all),
same as (select a.x, b.x as y, sum(a.v * b.v) as t from v a join v b using (block, place, cluster) where a.x <= b.x group by all),
f as (select x, y, (s - coalesce(t, 0)) * case when x = y then 0.5 else 1 end as weight from whole left join same using (x, y)),
g as (select x, y, weight, weight / sum(weight) over () as q from f where weight > 1e-9),
p as (select x, sum(q) as p from (select x, q / 2 as q from g union all select y, q / 2 from g) group by x),
b as (select g.x, g.y, weight, q, log2(q * case when g.x = g.y then 1 else 0.5 end / (i.p * j.p)) as bits from g join p i on i.x = g.x join p j on j.x = g.y),
h as (select greatest(2, round(2 / sqrt(sum(q * bits)))) as unit from b)
select '{AMINO}'[x] as a, '{AMINO}'[y] as b, round(weight, 6) as weight, cast(round(bits * unit) as integer) as score from b, h"""

def _copies(w: str, kind: str = "protein") -> str:
    """Common tables up to v (i, j, score) of all rows of part: w's tables score the distinct names, equal ones as well."""
    return f"""{w.replace("c a join c b on a.ord < b.ord", "c a join c b on a.ord <= b.ord")},
raw as (select p_partkey as key, {_derived("p_name", kind)} as seq from part where {_derived("p_name", kind)} <> ''),
x as (select raw.seq, s.ord as u, cast(row_number() over (order by key) - 1 as integer) as ord from raw join s using (seq)),
v as (select a.ord as i, b.ord as j, w.score from x a join x b on a.ord < b.ord join w on w.i = least(a.u, b.u) and w.j = greatest(a.u, b.u))"""


def _whole_scores(method: str, kind: str) -> str:
    cfg = CONFIGS[method, kind]
    w = _linear(cfg.matrix, cfg.gap, kind) if method == "nw" else _affine(cfg.matrix, cfg.gap_open, cfg.gap_extend, kind, method == "sw")
    return f"with recursive {_copies(w, kind)} select i, j, score from v"


_V = _copies(_W)
_WHOLE_LONG = "select i, j, score from v union all select j, i, score from v union all select ord, ord, 0 from x"
_PART = _rows("part")
_NAME = "upper(replace(p_name, ' ', ''))"

ORACLE_SQL: dict[str, str] = {
    "q_blosum_estimate": _BLOSUM,
    "q_list_matrices": f"with f as (select count(*) filter (regexp_full_match({_NAME}, '[{AMINO}]+')) as amino, count(*) filter (regexp_full_match({_NAME}, '[{NUCLEOTIDE}]+')) as nucleotide from part) select name, kind, case kind when 'amino' then amino else nucleotide end as fits from f, (values "
    + ", ".join([f"('{n}', 'amino')" for n in [*BLOSUM_NAMES, *PAM_NAMES]] + [f"('{n}', 'nucleotide')" for n in NUCLEOTIDE_NAMES])
    + ") t(name, kind)",
    "q_matrix_scores": f"with {_flat('blosum62')}, u as (select unnest(range(1, {len(AMINO)} + 1)) as x), p as (select i.x as i, j.x as j, '{AMINO}'[i.x] as a, '{AMINO}'[j.x] as b from u i, u j), {_PART}, l as (select seq, unnest(range(1, length(seq))) as k from s), g as (select seq[k:k + 1] as two, count(*) as n from l group by all) select a, b, cast(f[(i - 1) * {STRIDE} + j] as integer) as score, coalesce(n, 0) as n from f, p left join g on two = a || b",
    "q_matrix_triangle": f"with {_V}, m as (select i, score from v union all select j, score from v) select i as ord, count(*) as n, cast(sum(score) as bigint) as total, min(score) as least, max(score) as most from m group by i",
    "q_encode_whole": f"with {_rows('documents')}, u as (select ord, seq, unnest(range(1, length(seq) + 1)) as k from s) select ord, cast(k as integer) as pos, cast(strpos('{AMINO}', seq[k]) - 1 as integer) as code from u",
    "q_pairs_whole": f"with {_PART} select a.ord as i, b.ord as j {_PAIRS}",
    "q_pair_index_whole": f"with {_PART} select cast(b.ord as bigint) * (b.ord - 1) // 2 + a.ord as pair_id, a.ord as i, b.ord as j {_PAIRS}",
    "q_identity_whole": f"with {_PART} select a.ord as i, b.ord as j, {_HAMMING} as identity {_PAIRS}",
    "q_filter_edges_05_whole": f"with {_PART} select a.ord as i, b.ord as j {_PAIRS} where {_HAMMING} >= cast(0.5 as float)",
    **{f"q_{m}_{k}_whole": _whole_scores(m, k) for m, k in CONFIGS},
    **{f"q_{m}_sql_backend_whole": _whole_scores(m, "protein") for m in ("nw", "ga", "sw")},
    "q_table_function": _whole_scores("nw", "protein"),
    "q_ga_equal_gap_rewrite_whole": f"with {_V} select i, j, score from v",
    "q_matrix_long_whole": f"with {_V} {_WHOLE_LONG}",
    "q_matrix_dense_whole": f"with {_V}, m as ({_WHOLE_LONG}) select i as ord, array_to_string(list(score order by j), ' ') as scores from m group by i",
    "q_filtered_nw_whole": f"with {_linear('blosum62', 4, 'protein', _greedy(0.5, _PART).replace('z as (', 'kept as (')).replace('from s)', 'from kept)')} select i, j, score from w",
    "q_fasta_folder": f"with {_rows('documents')} select ord, seq from s",
    "q_fasta_source": f"with {_rows('documents')} select ord, seq from s",
    "q_sink_parquet": f"with {_W}, m as ({_LONG}), r as (select i as ord, array_to_string(list(score order by j), ' ') as scores from m group by i) select ord, seq, scores from s join r using (ord)",
    "q_filter_removed": f"with {_greedy(0.5, _rows('part'))}, b as (select count(*) as before from s), a as (select count(*) as after from z) select before, after, before - after as removed from b, a",
    "q_similar_documents_09": f"with {_rows('documents').replace('s as (', 'r as (')}, s as (select min(ord) as ord, seq from r group by seq) select a.ord as i, b.ord as j {_PAIRS} where {_HAMMING} >= cast(0.9 as float)",
    "q_filter_documents_09": f"with {_greedy(0.9, _rows('documents'), _HAMMING)} select ord, seq from z",
    "q_sql_functions": f"with {_W} select w.i, w.j, score, {_IDENTITY} as identity from w join s a on a.ord = w.i join s b on b.ord = w.j",
    "q_stream_scores": f"with {_ARRIVING} select name, ord, score from w",
    "q_gap_rules": _GAP_RULES,
    "q_set_checks": _SET_CHECKS,
    "q_filter_benchmark": f"with {_greedy(0.1, _rows('benchmark'))} select ord, seq from z",
    "q_filter_greedy_09_whole": f"with {_greedy(0.9, _rows('part'))} select ord, seq from z",
    "q_filter_greedy_05_whole": f"with {_greedy(0.5, _rows('part'))} select ord, seq from z",
    "q_fasta_roundtrip_whole": f"with {_rows('documents')} select ord, seq from s",
    "q_dsv_roundtrip_whole": f"with {_rows('documents')} select ord, seq from s",
    "q_derive_protein": f"select doc_id, {_derived('text', 'protein')} as seq from documents",
    "q_derive_dna": f"select doc_id, {_derived('text', 'dna')} as seq from documents",
    "q_encode": f"with {_seqs()}, u as (select ord, seq, unnest(range(1, length(seq) + 1)) as k from s) select ord, cast(k as integer) as pos, cast(strpos('{AMINO}', seq[k]) - 1 as integer) as code from u",
    "q_length_stats": f"with q as (select length({_derived('text', 'protein')}) as n from documents) select count(*) as num, cast(max(n) as integer) as max_len, cast(sum(n + 1) as bigint) as total, cast(avg(n) as float) as mean_len from q where n > 0",
    "q_validate_report": f"with q as (select doc_id, {_NORMAL} as seq from documents) select doc_id, case when seq is null or seq = '' then 'empty' when regexp_matches(seq, '[^\\x01-\\x7f]') then 'corrupted' when regexp_matches(seq, '[^{AMINO}]') then 'invalid' end as fault from q",
    "q_pairs": f"with {_seqs()} select a.ord as i, b.ord as j {_PAIRS}",
    "q_pair_index": f"with {_seqs()} select cast(b.ord as bigint) * (b.ord - 1) // 2 + a.ord as pair_id, a.ord as i, b.ord as j {_PAIRS}",
    "q_identity": f"with {_seqs()} select a.ord as i, b.ord as j, {_IDENTITY} as identity {_PAIRS}",
    "q_filter_edges_05": f"with {_seqs()} select a.ord as i, b.ord as j {_PAIRS} where {_IDENTITY} >= cast(0.5 as float)",
    "q_filter_greedy_09": f"with {_greedy(0.9)} select ord, seq from z",
    "q_filter_greedy_05": f"with {_greedy(0.5)} select ord, seq from z",
    **{f"q_{m}_{k}": _scores_sql(m, k) for m, k in CONFIGS},
    "q_ga_equal_gap_rewrite": f"with {_W} select i, j, score from w",
    **{f"q_{m}_sql_backend": _scores_sql(m, "protein") for m in ("nw", "ga", "sw")},
    "q_matrix_long": f"with {_W} {_LONG}",
    "q_matrix_dense": f"with {_W}, m as ({_LONG}) select i as ord, array_to_string(list(score order by j), ' ') as scores from m group by i",
    "q_filtered_nw": f"with {_linear('blosum62', 4, 'protein', _greedy(0.5).replace('z as (', 'kept as (')).replace('from s)', 'from kept)')} select i, j, score from w",
    "q_fasta_roundtrip": f"with {_seqs()} select ord, seq from s",
    "q_dsv_roundtrip": f"with {_seqs()} select ord, seq from s",
}
