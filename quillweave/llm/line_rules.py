"""Line-first cleaning: rules per line, then a verdict on what is left. DataFrame functions only.

Every line of a text is judged by itself; lines that fail are removed, and a document that loses too much of its
text is rejected. Words are runs of characters other than ASCII white space.

Boilerplate is found in the data, in any language: a short line that stands after ten or more different lines. Copies of
a document repeat their lines after the same ones, so that they do not make boilerplate of each other, and documents
without a line say nothing about it, however many there are. Lines with their contexts are a table. It meets the lines of
the texts by a join: lines that make up more than one in MANY rows, fewer than that, are sent to all tasks, the others
are shuffled. The marks of a text go back to its rows by the text's hash; rows of texts that many rows share stay where
they are. Of the texts, only the numbers per line are shuffled, unless the cleaned text is asked for.

Cases: a null text has no words and fails the base rules; an empty text likewise. Apart from the boilerplate, to which
each row adds its lines, rows are judged one by one, so repeated rows, ties and null ids change nothing; a share exactly
at its limit passes; a very long text or line is judged whole; an empty table gives an empty result. Only the id and text
columns are read, so further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import HOT, SPACE, WORD, saved, table

#: How a line of prose closes: marks of several scripts, with quotes or brackets after them.
CLOSING = r"[.!?:;,\u2026\u3002\uff01\uff1f][\"')\]\u201d\u2019\u00bb]*[\x20\x09-\x0D]*$"


#: Lines that make up more than one in so many rows of the lines that are counted: fewer than that, whatever the corpus.
MANY = 10_000


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; a share is a fraction of the line's word characters or words."""

    symbol_share: float = 0.1  # punctuation: more symbols than this
    shout_share: float = 0.6  # punctuation: words that end in !! beyond this
    bars: int = 2  # navigation: separate bars in a line
    bar_share: float = 0.15  # navigation: bars among the words
    stutter_share: float = 0.5  # boilerplate: words equal to the word before, beyond this
    open_words: int = 4  # punctuation: a line of so many words or fewer must close with a mark
    boiler_letters: int = 160  # boilerplate: lines of so many characters at most
    boiler_contexts: int = 10  # boilerplate: different lines before it, at least
    lost_share: float = 0.5  # document: word characters in removed lines beyond this


def _let(value: Column, f) -> Column:
    """f of value, which is evaluated once."""
    return F.transform(F.array(value), f)[0]


def _symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Windows are sorted by hash with their place, equal neighbours give the places of repeated windows, and the places,
    sorted again, give the covered words: n log n in the words of a text, within its row.
    """

    def covered(w: Column) -> Column:
        h = lambda k: F.get(w, k)["h"]
        same = lambda a, b: F.coalesce(a == b, F.lit(False))
        return _spread(F.sort_array(F.transform(F.filter(w, lambda x, k: same(h(k - 1), x["h"]) | same(h(k + 1), x["h"])), lambda x: x["i"])))

    def repeated(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(places, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(hashes, repeated)).cast("long")


def _spread(starts: Column) -> Column:
    """Words covered by windows of three that start at these sorted places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _line_rows(texts: DataFrame, rules: LineRules) -> DataFrame:
    """key, i, h and before of each line of texts (key, text) that may be boilerplate; before: hash of the line before."""
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.when((F.length(x) <= rules.boiler_letters) & x.rlike(WORD), F.xxhash64(x)).alias("h"), F.xxhash64(x).alias("own")))
    line = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x["h"].alias("h"), F.when(i > 0, F.get("lines", i - 1)["own"]).alias("before")))
    return texts.select("key", hashed.alias("lines")).select("key", F.explode(line).alias("x")).select("key", "x.*").where("h is not null")


def boilerplate(texts: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """key and places, in order, of the boilerplate lines of texts (key, text): a stored table, a row per key with any."""
    lines = _line_rows(texts, rules)
    seen = lines.groupBy("h", "before").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("m"))
    facts = saved(seen.where(F.col("m") >= rules.boiler_contexts), "line-contexts")
    limit, common = (facts.agg(F.sum("m")).first()[0] or 0) // MANY, F.col("n") >= rules.boiler_contexts
    many, few = facts.where(F.col("m") > limit), facts.where((F.col("m") <= limit) & common)
    lines = lines.select("key", "i", "h")
    marked = lines.join(F.broadcast(many.where(common).select("h")), "h")
    marked = marked.unionByName(lines.join(F.broadcast(many.select("h")), "h", "left_anti").join(few.select("h"), "h"))
    return saved(marked.groupBy("key").agg(F.sort_array(F.collect_set("i")).alias("places")), "line-marks", facts)


def _with_places(rows: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (with key) and the places that marks give for their key; keys of over one in HOT rows are sent to all tasks."""
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > texts.count() // HOT)
    hot = copies.join(marks, "key", "left").select("key", F.coalesce("places", F.array().cast("array<int>")).alias("hot_places"))
    rows = rows.join(F.broadcast(hot), "key", "left")
    aside = F.when(F.col("hot_places").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    out = rows.withColumn("aside", aside.cast("int")).join(marks.withColumn("aside", F.lit(0)), ["key", "aside"], "left")
    return out.withColumn("places", F.coalesce("hot_places", "places", F.array().cast("array<int>"))).drop("hot_places", "aside", "key")


def _others(lines: Column, places: Column) -> Column:
    """The elements that do not stand at these sorted places."""

    def between(k: Column) -> Column:
        lo = F.when(k > 0, F.get(places, k - 1) + 1).otherwise(0)
        return F.slice(lines, lo + 1, F.coalesce(F.get(places, k), F.size(lines)) - lo)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), between))


def line_fails(line: Column, words: Column, chars: Column, symbols: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line by itself fails a rule of punctuation, navigation or boilerplate; symbols: of the whole text."""
    n = F.size(words)
    marked = (symbols > 0) & (_symbols(line) > rules.symbol_share * chars)
    shouts = line.contains("!!") & (n >= 2) & (F.size(F.filter(words, lambda w: w.endswith("!!"))) > rules.shout_share * n)
    bars = lambda k: (k >= rules.bars) & (k > rules.bar_share * n) | (k >= 1) & (n <= 5)
    navigation = (symbols > 0) & line.contains("|") & _let(F.size(F.filter(words, lambda w: w == "|")), bars)
    # so many repeats leave few distinct words, which is quicker to see
    again = lambda: F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w))
    stutter = (n >= 4) & (F.size(F.array_distinct(words)) <= (1 - rules.stutter_share) * n) & (again() > rules.stutter_share * n)
    open_ = (n <= rules.open_words) & ~line.rlike(CLOSING)
    return marked | shouts | navigation | stutter | open_


def line_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Per row: counts, base verdict, kept, the cleaned text and the word characters that removed lines held."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = df.select("key", "text")
    marks = boilerplate(texts, rules)
    line = lambda x: _let(split_words(x), lambda w: F.struct(x.alias("line"), w.alias("words"), F.length(F.array_join(w, "")).alias("chars")))
    df = df.select("doc_id", "key", "text", F.transform(F.split("text", "\n", -1), line).alias("lines"), _symbols(F.col("text")).cast("long").alias("n_symbols"))
    # word characters of a line, -1 if it fails by itself
    own = lambda x: F.when(x["chars"] == 0, 0).when(line_fails(x["line"], x["words"], x["chars"], F.col("n_symbols"), rules), -1).otherwise(x["chars"])
    df = df.select(
        "doc_id",
        "key",
        "text",
        F.flatten(F.col("lines.words")).alias("words"),
        "n_symbols",
        F.transform(F.filter("lines", lambda x: x["chars"] > 0), lambda x: x["line"]).alias("worded"),
        F.aggregate(F.col("lines.chars"), F.lit(0).cast("long"), lambda a, x: a + x).alias("word_chars"),
        F.transform("lines", own).alias("own"),
    )
    df = df.select(
        "doc_id",
        "key",
        "text",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        "own",
    )
    df = _with_places(df, texts, marks)
    zipped = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), F.get("own", i).alias("own")))
    good = _let(zipped, lambda z: F.filter(_others(z, F.col("places")), lambda x: x["own"] >= 0))
    total = lambda values, at: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0), at(x)))
    left = total(F.col("own"), lambda x: x) - total(F.col("places"), lambda p: F.get("own", p))
    df = df.select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
        (F.col("word_chars") - left).alias("lost_chars"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= rules.lost_share * F.col("word_chars")))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_R = LineRules()
#: The same rules over lines and words as rows.
ORACLE = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols from d),
l as (select k, n_symbols, x.line as line, x.i as i, regexp_extract_all(x.line, '[^\x20\x09-\x0D]+') as lw
  from (select k, n_symbols, unnest(list_transform(string_split(text, chr(10)), lambda line, i: {{'line': line, 'i': i}})) as x from w)),
p as (select distinct line, lag(line) over (partition by k order by i) as before from l qualify length(line) <= {_R.boiler_letters} and len(lw) > 0),
c as (select line, count(*) as n from p group by line),
common as (select line from c where n >= {_R.boiler_contexts}),
f as (select k, line, len(lw) as n, list_sum(list_transform(lw, lambda x: length(x))) as chars,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as marks, len(list_filter(lw, lambda x: ends_with(x, '!!'))) as shouts,
  len(list_filter(lw, lambda x: x = '|')) as bars, len(list_distinct(lw)) as kinds, len(list_filter(lw, lambda x, i: i > 1 and lw[i - 1] = x)) as again
  from l where len(lw) > 0),
g as (select k, line, chars, marks > {_R.symbol_share}::double * chars
  or n >= 2 and shouts > {_R.shout_share}::double * n
  or bars >= {_R.bars} and bars > {_R.bar_share}::double * n or bars >= 1 and n <= 5
  or n >= 4 and kinds <= (1 - {_R.stutter_share}::double) * n and again > {_R.stutter_share}::double * n
  or n <= {_R.open_words} and not regexp_matches(line, '[.!?:;,…。！？]["'')\]”’»]*[\x20\x09-\x0D]*$')
  or line in (select line from common) as bad from f),
lines as (select k, sum(chars) as word_chars, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(chars) filter (bad), 0) as lost from g group by k),
t as (select k, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as three from (select k, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 3)),
r as (select k, i from t qualify count(*) over (partition by k, three) > 1),
covered as (select k, count(distinct i) as n from (select k, i + unnest([0, 1, 2]) as i from r) group by k),
o as (select doc_id, len(words)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from w left join lines using (k) left join covered using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= {_R.lost_share}::double * word_chars as kept from o
"""
