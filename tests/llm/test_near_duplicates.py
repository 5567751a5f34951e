"""Chosen-path join, inverted multi-index, sentence spans and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillweave.llm import chosen_path, multi_index, sentence_spans
from quillweave.llm.components import connected_components
from quillweave.llm.registry import ORACLE_SQL, QUERIES

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt uu vv ww xx yy zz".split()


def least_of(n, links):
    root = list(range(n))
    while True:
        new = list(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("name", ["op1_multi_index", "op9_chosen_path"])
def test_equals_sql(spark, small, same_rows, name):
    same_rows(QUERIES[name](spark, small), ORACLE_SQL[name])


def test_components(spark):
    rng = np.random.default_rng(1)
    for n, m in ((60, 40), (200, 150), (300, 299)):
        links = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] if m != n - 1 else [(i, i + 1) for i in range(m)]
        want = least_of(n, links)
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
        assert got == {x: want[x] for p in links if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def documents(rng):
    out = []
    base = [" ".join(rng.choice(WORDS, 80)) for _ in range(6)]
    for b in base:
        for k in range(9):
            w = b.split()
            for _ in range(k % 4):
                w[rng.integers(0, len(w))] = "new" + str(rng.integers(0, 999))
            out.append(" ".join(w))
    out += [" ".join(["the common line of all of them here"] + list(rng.choice(WORDS, 9))) for _ in range(40)]
    return out + ["", "   ", None, "one", "one", "two words", "a b c d", "a b c d", " ".join(rng.choice(WORDS, 30_000))]


@pytest.mark.parametrize("plan", [chosen_path.JoinPlan(), chosen_path.JoinPlan(bucket=4, block=8)])
def test_chosen_path_equals_brute_force(spark, plan):
    texts = documents(np.random.default_rng(2))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, sig int").repartition(5)

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    root = least_of(len(s), links)
    n = [sum(i in p for p in links) for i in range(len(s))]
    got = {r["doc_id"]: r for r in chosen_path.jaccard_join(df, plan).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in got} == {i: (n[i], root[i], root[i] == i) for i in range(len(s))}


def test_chosen_path_runs_follow_from_the_branching():
    """Pairs at the least similarity, whose buckets are split to ten levels: the share that meets in one of the runs."""
    rng, plan, n = np.random.default_rng(6), chosen_path.JoinPlan(), 6000
    a = rng.integers(0, 2**32, (n, plan.positions), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < plan.similarity, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    met = np.zeros(n, bool)
    for run in range(plan.runs):
        of, key = np.arange(n), np.full(n, 1000 + run, np.uint64)
        for _ in range(10):
            x, y = chosen_path.split_keys(key, a[of], plan), chosen_path.split_keys(key, b[of], plan)
            row, branch = np.nonzero(x == y)
            of, key = of[row], x[row, branch]
        met[of] = True
    met &= (a == b).mean(axis=1) >= plan.agree
    assert met.mean() >= plan.recall - 0.001
    assert chosen_path.meeting(np.array([0.8]), 2) == pytest.approx(0.9375)
    with pytest.raises(ValueError):
        chosen_path.JoinPlan(positions=8, recall=0.9999999).runs


def test_chosen_path_samples_different_positions():
    plan = chosen_path.JoinPlan(positions=3, branches=3)
    sig = np.tile(np.array([[1, 2, 3]], np.uint32), (500, 1))
    keys = chosen_path.split_keys(np.arange(500, dtype=np.uint64), sig, plan)
    other = chosen_path.split_keys(np.arange(500, dtype=np.uint64), sig * np.array([[1, 9, 1]], np.uint32), plan)
    assert ((keys != other).sum(axis=1) == 1).all()


def test_chosen_path_hot_group(spark):
    """Texts at Jaccard 0.80 to 0.82 of one base, among so many near copies of it that buckets are split at all levels."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(304)]  # 300 shingles
    copies = []
    for k in range(1500):
        w = list(base)
        for x in rng.choice(304, 3, replace=False):
            w[x] = f"c{k}x{x}"
        copies.append(w)
    edge = [base + [f"e{k}x{x}" for x in range(75 - k % 10)] for k in range(1000)]
    texts = [base, *copies, *edge]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(8)
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    count = {}
    for x in s:
        for sh in x:
            count[sh] = count.get(sh, 0) + 1
    at = {sh: k for k, sh in enumerate(sh for sh in count if count[sh] > 1)}
    m = np.zeros((len(s), len(at)), np.float32)
    for i, x in enumerate(s):
        m[i, [at[sh] for sh in x if sh in at]] = 1
    n, shared = np.array([len(x) for x in s]), m @ m.T
    links = 5 * shared >= 4 * (n[:, None] + n - shared)
    np.fill_diagonal(links, False)
    assert links[1501:].sum() == 1000 and links[1501:, 0].all() and links[0].all(where=np.arange(len(s)) > 0)
    got = {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in chosen_path.jaccard_join(df).collect()}
    assert len(got) == len(s)
    lost = [i for i in range(1501, len(s)) if got[i] != (1, 0, False)]
    assert len(lost) <= 1000 * (1 - chosen_path.JoinPlan().recall) + 1e-6
    assert all(got[i] == (links[i].sum() - (len(lost) if i == 0 else 0), 0, i == 0) for i in range(1501))


def test_chosen_path_odd_rows(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, None), (7, "other words of a text of its own")], "doc_id long, text string")
    got = sorted(map(tuple, chosen_path.jaccard_join(df).collect()), key=repr)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True), (7, 0, 7, True)], key=repr)
    assert chosen_path.jaccard_join(df.limit(0)).count() == 0


def test_pipeline_judges_rows_that_share_a_doc_id(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(rng.choice(WORDS, 60)) for _ in range(4))
    rows = [(2, a), (5, b), (5, a + " end"), (5, b), (None, a), (None, c), (None, c), (None, None), (None, None), (7, d), (7, c + " end")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=repr)
    assert got == sorted([(2, a), (5, b), (None, None), (None, None), (7, d), (7, c + " end")], key=repr)


def vectors(rng, n=400, d=16):
    x = rng.normal(size=(n, d))
    for k in range(0, n, 4):
        x[k + 1] = x[k] + rng.normal(size=d) * 0.1 * (k % 16) / 8
        x[k + 2] = x[k] * 3
    x[50:90] = x[50] + rng.normal(size=(40, d)) * 0.05
    return x.astype(np.float32)


@pytest.mark.parametrize("plan", [multi_index.IndexPlan(), multi_index.IndexPlan(block=16, sample=200)])
def test_multi_index_recall(spark, plan):
    x = vectors(np.random.default_rng(4))
    df = spark.createDataFrame([(i, v.tolist(), 0, "c") for i, v in enumerate(x)], "vec_id long, embedding array<float>, id int, cells string")
    u = multi_index.unit(x)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(df, plan).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= s.sum(axis=1)).all() and found.sum() >= 0.9 * s.sum()
    if found.sum() == s.sum():
        assert [got[i]["component_id"] for i in range(len(x))] == least_of(len(x), list(zip(*np.nonzero(s))))


def test_multi_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [1.0, None, 1.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0, 0.5]), (5, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, multi_index.near_duplicates(df).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 5, 6, 7, 8, 9)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), *alone], key=repr)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_multi_index_links_each_length_by_itself(spark):
    """Few and many vectors of several lengths, very long ones too, ties and hot copies, against all cosines."""
    rng = np.random.default_rng(7)
    rows = []
    for d, n in ((1, 6), (2, 30), (3, 500), (16, 300), (5000, 40)):
        x = rng.normal(size=(n, d))
        for k in range(0, n - 1, 3):
            x[k + 1] = x[k] + rng.normal(size=d) * 0.1 * rng.random()
        x[: n // 3] = x[0]
        rows += [(v / 3).tolist() if k % 2 else v.tolist() for k, v in enumerate(x)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(6)
    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            if len(a) == len(rows[j]):
                u, v = np.array(a), np.array(rows[j])
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.9:
                    links.append((i, j))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    for plan in (multi_index.IndexPlan(), multi_index.IndexPlan(cell=8, block=32, doubles=1000)):
        got = {r["vec_id"]: r for r in multi_index.near_duplicates(df, plan).collect()}
        found = np.array([got[i]["n_links"] for i in range(len(rows))])
        assert (found <= n).all() and found.sum() >= 0.98 * n.sum()
        if found.sum() == n.sum():
            assert [got[i]["component_id"] for i in range(len(rows))] == least_of(len(rows), links)


def test_codes_follow_the_vectors():
    plan = multi_index.IndexPlan()
    for n in (10**4, 10**6, 10**8, 10**9):
        assert 0.8 < multi_index.codes_for(n, plan) ** 2 * plan.cell / n < 1.25


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    books = multi_index.Codebooks(rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), 1)
    x = rng.normal(size=(20, 8))
    a, b = books.split(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for visits in (1, 5, 49):
        assert (np.sort(total, axis=1)[:, :visits] == np.take_along_axis(total, books.order(x, visits), axis=1)).all()


def plain_sentences(text, rules):
    """Sentences as (start, end), letter by letter and word by word."""
    marks, quotes, out, lo, k = ".!?\u3002\uff01\uff1f", "\"')]\u201d\u2019", [], 0, 0
    ends = []
    while k < len(text):
        if text[k] == "\n":
            ends.append(k + 1)
        elif text[k] in marks:
            e = k + 1
            while e < len(text) and text[e] in marks:
                e += 1
            while e < len(text) and text[e] in quotes:
                e += 1
            if e == len(text) or text[e].isspace():
                ends.append(e)
            k = e - 1
        k += 1
    for hi in [*ends, len(text)]:
        words, k = [], lo
        while k < hi:
            if text[k].isspace():
                k += 1
                continue
            e = k
            while e < hi and not text[e].isspace():
                e += 1
            words.append((k, e))
            k = e
        if len(words) <= rules.long_words:
            groups = [words]
        else:
            groups = [[]]
            for a, b in words:
                groups[-1].append((a, b))
                if len(groups[-1]) == rules.piece_words or (b - a + 7 * ord(text[a]) + 31 * ord(text[b - 1])) % 6 == 0:
                    groups.append([])
        out += [(g[0][0], g[-1][1], len(g)) for g in groups if g]
        lo = hi
    return out


def cleaned(rows, rules=sentence_spans.SpanRules()):
    """Row by row in order of doc_id, with a plain set of seen runs, by a splitter and a remover of its own."""
    seen, out = {}, {}
    for i, t in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        p, gone = plain_sentences(t, rules), set()
        for k in range(len(p)):
            e = k + rules.span
            while e < len(p) and sum(x[2] for x in p[k:e]) < rules.min_words:
                e += 1
            if e > len(p) or sum(x[2] for x in p[k:e]) < rules.min_words:
                continue
            key = tuple(t[a:b] for a, b, _ in p[k:e])
            if seen.setdefault(key, (i, k)) != (i, k):
                gone |= set(range(k, e))
        starts = [a for a, _, _ in p] + [len(t)]
        keep = [True] * len(t)
        for k in gone:
            keep[starts[k] : starts[k + 1]] = [False] * (starts[k + 1] - starts[k])
        out[i] = "".join(c for c, yes in zip(t, keep) if yes).rstrip(" \n") if gone else t
    return out


def test_sentence_spans_equal_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in QUERIES["op2_sentence_spans"](spark, small).collect()}
    assert got == cleaned(rows)
    windows = {}
    for i, t in got.items():
        w = t.split()
        for k in range(len(w) - 49):
            windows.setdefault(tuple(w[k : k + 50]), set()).add(i)
    assert not [v for v in windows.values() if len(v) > 1]


def test_sentence_spans_tell_texts_of_one_doc_id_apart(spark):
    passage = " ".join(f"Sentence {k} of the passage has some words of its own." for k in range(5))
    own = " ".join(f"Line {k} of this text is said nowhere else at all." for k in range(30))
    for other in ("short one", " ".join(f"A much longer text goes on with clause {k} here." for k in range(60))):
        rows = [(3, passage), (7, own + " " + passage), (7, other), (7, own + " " + passage)]
        got = sorted(map(tuple, sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()))
        assert got == sorted([(3, passage), (7, own), (7, other), (7, own)])


def test_sentence_spans_inside_other_sentences(spark):
    """Passages of over 50 words, put into other texts at any word, are found; the texts around them stay."""
    rng = np.random.default_rng(3)

    def prose(n):
        out = []
        while sum(len(x.split()) for x in out) < n:
            w = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(2, 34))]
            out.append(" ".join(w).capitalize() + ".")
        return " ".join(out)

    passages, rows = [prose(55) for _ in range(60)], []
    for k in range(300):
        w = prose(200).split()
        at = int(rng.integers(0, len(w)))
        rows.append((k, " ".join([*w[:at], passages[k % 60], *w[at:]]), " ".join(w)))
    rows += [(1000 + k, t, t) for k, t in enumerate(prose(200) for _ in range(100))]
    got = {r["doc_id"]: r["text"] for r in sentence_spans.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    left = {k: len(t.split()) for k, t in got.items()}
    size = {k: len(t.split()) for k, _, t in rows}
    assert all(got[k] == t for k, t, _ in rows if k < 60 or k >= 1000)
    assert sum(left[k] < len(rows[k][1].split()) - 15 for k in range(60, 300)) >= 0.99 * 240
    assert all(left[k] >= size[k] - 1 for k in range(60, 300))


def test_sentence_spans_odd_rows(spark):
    passage = "This passage is here. It has some sentences in it! Does it have enough words? Yes, it has more than twelve words."
    own = "Nothing else says this at all."
    rows = [(5, f"{own} {passage}"), (9, f"Other words first. {passage} And after."), (9, f"Other words first. {passage} And after."), (None, passage), (1, None), (2, ""), (3, passage + " " + passage)]
    df = spark.createDataFrame([(*r, "k", 4) for r in rows], "doc_id long, text string, at string, starts int")
    out = sentence_spans.dedup(df)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    want = [(5, own), (9, "Other words first. And after."), (9, "Other words first. And after."), (None, passage), (1, None), (2, ""), (3, passage)]
    assert got == sorted(want, key=repr) and out.columns[:4] == df.columns
    assert sentence_spans.dedup(df.limit(0)).count() == 0
    long = " ".join(f"word{i}" for i in range(50_000))
    got = {r["doc_id"]: r["text"] for r in sentence_spans.dedup(spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")).collect()}
    assert got[1] == long and len(got[2]) < 200


def test_further_columns_of_any_name(spark, small):
    """A dot in a name, and names that the operators use themselves."""
    import corpus_pipeline

    passage = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty one."
    rows = [(1, passage + " First tail of this text here.", "x"), (2, "Quite another start it has. " + passage, "y"), (3, passage + " First tail of this text here.", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("a.b", F.lit(7)).withColumn("_row", F.lit(8)).withColumn("c0", F.lit(9))
    out = sentence_spans.dedup(docs)
    assert out.columns == [*docs.columns, "_n_sentences", "_n_removed"]
    assert {r["doc_id"]: (r["a.b"], r["c0"], passage in r["text"]) for r in out.collect()} == {1: (7, 9, True), 2: (7, 9, False), 3: (7, 9, False)}
    kept = corpus_pipeline.near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["a.b"], r["_row"], r["c0"]) for r in kept.collect()) == [(1, 7, 8, 9), (2, 7, 8, 9)]


def test_rows_without_a_key_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from quillweave.llm.common import joined

    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("false", "-1", "8")):
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 2 == 0, F.col("id") % 5000).when(F.col("id") % 10 == 1, F.lit(1))
        rows = spark.range(0, 40_000, 1, 16).withColumn("k", key)
        facts = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("twice", 2 * F.col("k"))
        out = joined(rows, facts, "k", "n", 40_000)
        got = out.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = lambda i: i % 5000 if i % 2 == 0 else 1 if i % 10 == 1 else None
    assert sorted(r["id"] for r in got) == list(range(40_000))
    assert all(r["k"] == want(r["id"]) and r["twice"] == (None if r["k"] is None else 2 * r["k"]) for r in got)
    parts = [r["part"] for r in got]
    assert max(parts.count(p) for p in set(parts)) < 4000
