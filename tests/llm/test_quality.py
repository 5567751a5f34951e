"""Line CRF, line rules, mixing and the pipeline."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillweave.llm import line_crf, line_rules, mixing
from quillweave.llm.registry import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    n = np.array([3, 1, 4, 2])
    emit, trans = rng.normal(size=n.sum()), rng.normal(size=(2, 2))
    p, logz, pairs = line_crf.forward_backward(emit, trans, n)
    want, at = np.zeros((2, 2)), 0
    for k, m in enumerate(n):
        total, marginal, both = 0.0, np.zeros(m), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(m)):
            w = np.exp(sum(emit[at + i] * y[i] for i in range(m)) + sum(trans[y[i], y[i + 1]] for i in range(m - 1)))
            total, marginal = total + w, marginal + w * np.array(y)
            for i in range(m - 1):
                both[y[i], y[i + 1]] += w
        assert np.allclose(p[at : at + m], marginal / total) and np.isclose(logz[k], np.log(total))
        want, at = want + both / total, at + m
    assert np.allclose(pairs, want)


def test_features_do_not_depend_on_neighbouring_texts():
    texts = ["a first text. ", "x x | y x x\nb b b", "one two.\nThree | four\n\nx x x x", "", "É!! b!!", "a" * 3000, "\n", " tail \n"]
    whole = line_crf.line_features(texts)[0]
    assert np.allclose(whole, np.concatenate([line_crf.line_features([t])[0] for t in texts]))


def test_long_texts_are_measured_in_pieces(monkeypatch):
    """Small pieces give the features of one piece, but for repeats across cuts within a line."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcÄ!|.#"), rng.integers(1, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.integers(0, 40))) for _ in range(30)) for _ in range(5)] + ["", "x" * 900, "\n\n"]
    want = line_crf.line_features(texts)
    monkeypatch.setattr(line_crf, "CHUNK_BYTES", 64)
    got = line_crf.line_features(texts)
    again = 7 + line_crf.N_BASE * np.arange(3)
    keep = np.setdiff1d(np.arange(line_crf.N_FEATURES), again)
    assert (got[2] == want[2]).all() and (got[1] == want[1]).all() and np.abs(got[0][:, again] - want[0][:, again]).max() < 2
    solid = np.array([len(x) for t in texts for x in t.split("\n")]) != 900
    near = solid & np.roll(solid, 1) & np.roll(solid, -1)
    assert np.allclose(got[0][np.ix_(near, keep)], want[0][np.ix_(near, keep)])


def test_training_has_one_objective():
    """Its gradient against finite differences, and training raises it to where the gradient is small."""
    rng = np.random.default_rng(2)
    n, good = np.array([1, 5, 3, 8, 2, 4]), np.array([1, 0, 1, 1, 0, 1])
    x = rng.normal(size=(n.sum(), line_crf.N_FEATURES))
    theta = rng.normal(size=line_crf.N_FEATURES + 4)
    _, g = line_crf.objective(theta, x, n, good, 0.01, 0.1)
    for k in (0, 7, 20, *range(line_crf.N_FEATURES, line_crf.N_FEATURES + 4)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (line_crf.objective(theta + s * step, x, n, good, 0.01, 0.1)[0] for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)
    model = line_crf.fit(x, n, good, ridge=0.01, stiff=0.1)
    value, g = line_crf.objective(np.concatenate([model.weights, model.trans.ravel()]), x, n, good, 0.01, 0.1)
    assert value > line_crf.objective(np.zeros_like(theta), x, n, good, 0.01, 0.1)[0] and np.abs(g).max() < 0.01


def test_scores_equal_plain_loops(spark):
    """The whole query on a small table: training rows, features, chains and weights by a plain version."""
    rng = np.random.default_rng(4)
    lines = lambda k, f: "\n".join(f() for _ in range(k))
    good = lambda: " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(12)) + "."
    bad = lambda: " ".join(rng.choice(["###", "|", "BUY!!", "x"], 6))
    rows = [(k, lines(int(rng.integers(1, 6)), good if k % 3 else bad)) for k in range(60)] + [(None, "x"), (70, None), (5, "another text")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), [(k, int(k % 3 > 0)) for k in range(0, 60, 2)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    trained = line_crf.train(docs, line_crf.learnable(table))
    got = {(r["doc_id"], r["text"]): r["_score"] for r in line_crf.score(docs, trained, keep=["doc_id", "text"]).collect()}
    learn = sorted((d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 5)
    texts = dict(reversed(rows))
    assert all(d != 5 for d, _ in learn)
    parts = [line_crf.line_features([texts[d]])[0].astype(np.float32).astype(float) for d, _ in learn]
    model = line_crf.fit(np.concatenate(parts), np.array([len(x) for x in parts]), np.array([y for _, y in learn]))
    assert np.allclose(trained.weights, model.weights) and np.allclose(trained.trans, model.trans)
    for d, t in rows:
        x = (line_crf.line_features([t or ""])[0] @ model.weights).tolist()
        a, b = [np.array([0.0, x[0]])], [np.zeros(2)]
        for e in x[1:]:
            a.append(np.array([np.logaddexp(*(a[-1] + model.trans[:, y])) + (e if y else 0) for y in (0, 1)]))
        for e in x[:0:-1]:
            b.insert(0, np.array([np.logaddexp(*(model.trans[y] + np.array([0, e]) + b[0])) for y in (0, 1)]))
        p = [1 / (1 + np.exp((u + v)[0] - (u + v)[1])) for u, v in zip(a, b)]
        w = [len(re.sub(r"\s", "", line).encode()) + 1e-6 for line in (t or "").split("\n")]
        assert got[d, t] == pytest.approx(sum(x * y for x, y in zip(p, w)) / sum(w), abs=1e-6)


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op3_line_crf"](spark, "/root/testdata/sf0.01").collect()


def test_classifier_on_held_out_labels(spark, scored):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in scored if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    y, q = np.array([labels[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    assert (q[y == 1][:, None] > q[y == 0]).mean() > 0.97
    assert np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 1]) > 0.98
    assert np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 0]) < 0.1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Fine words here.", 0.5), (1, "Fine words here.", 0.5), (None, None, 0.5), (2, "", 0.5), (3, "### $$$ ***", 0.5), (4, "word " * 40_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1), (2, None, 0), (9, 1, 1)], "doc_id long, quality int, text int")
    model = line_crf.train(docs, labels)
    got = line_crf.score(docs, model).collect()
    assert len(got) == 6 and got[0]["_score"] == got[1]["_score"] and all(0 <= r["_score"] <= 1 for r in got)
    assert got[2]["_score"] == got[3]["_score"]
    none = line_crf.train(docs, labels.limit(0))
    assert {r["_score"] for r in line_crf.score(docs, none).collect()} == {0.5}
    assert line_crf.score(docs.limit(0), model).count() == 0


def base_counts(text):
    w = WORD.findall(text or "")
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_line_rules_counts_and_verdicts(spark, small):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for r in QUERIES["op8_line_rules"](spark, small).collect():
        assert tuple(r)[1:7] == base_counts(rows[r["doc_id"]])
        if r["doc_id"] in quality and not r["base_failed"]:
            assert r["kept"] == (quality[r["doc_id"]] == 1)


def test_line_rules_equal_sql(spark, small, same_rows):
    same_rows(QUERIES["op8_line_rules"](spark, small), ORACLE_SQL["op8_line_rules"])


def test_boilerplate_is_found_in_the_data(spark):
    """A line after many different ones, in any language, is boilerplate; the lines of many copies are not."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)) + "."
    footer, copy = "Alle Rechte vorbehalten, auch die der Übersetzung ins Englische.", "\n".join(prose(9) for _ in range(8))
    texts = [f"{prose(60)}\n{footer}\n{prose(9)}" for _ in range(30)] + [copy] * 300 + [f"{footer}\n" * 12 + prose(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r for r in line_rules.line_clean(df).orderBy("doc_id").collect()]
    assert all(footer not in r["clean_text"] for r in got) and all(r["kept"] for r in got[:330])
    assert all(r["clean_text"] == copy for r in got[30:330]) and not got[330]["kept"]
    assert all(r["lost_chars"] == len(footer.replace(" ", "")) for r in got[:30])


def test_boilerplate_does_not_depend_on_other_documents(spark):
    """Sixty documents with one footer lose it alone and beside a thousand others; copies that many rows share, too."""
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)) + "."
    footer = "All of these pages are printed on the paper of the mill."
    texts = [f"{prose(60)}\n{footer}\n\n{prose(9)}\n{footer}" for _ in range(60)]
    others = ["\n".join(prose(9) for _ in range(20)) for _ in range(1000)] + [texts[0]] * 500 + [prose(70)] * 500
    clean = []
    for rows in (texts, texts + others):
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
        got = [r["clean_text"] for r in line_rules.line_clean(df).orderBy("doc_id").collect()]
        clean.append(got[:60])
        assert got[60:] == others[: len(got) - 60][:1000] + ["\n".join(x for x in t.split("\n") if x != footer) for t in others[1000:]][: max(0, len(got) - 1060)]
    assert clean[0] == clean[1] == ["\n".join(x for x in t.split("\n") if x != footer) for t in texts]


def test_line_rules_ties(spark):
    """Shares exactly at a limit pass: half of the text lost, half of the words in repeated windows."""
    half = "|" + "a" * 99
    keep = " ".join("b" * 4 for _ in range(25))
    rows = [(1, " ".join(f"w{k:03d}" for k in range(50)) + ".\n" + " ".join(["#" * 4] * 50)), (2, "\n".join([half, keep]))]
    rows += [(3, " ".join([*(f"x{k}" for k in range(50)), *["p q r s t"] * 10]))]
    got = {r["doc_id"]: r for r in line_rules.line_clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["lost_chars"] == 200 and got[1]["word_chars"] == 401 and got[1]["kept"] != got[1]["base_failed"]
    assert got[3]["n_words"] == 100 and got[3]["n_repeat_words"] == 50 and not got[3]["base_failed"]


def test_line_rules_odd_rows(spark):
    good = "A line of plain words that nobody would take away from this text. " * 5
    texts = [None, "", " \n\t", "a a a", "x y z x y z", "a\n\na\n b", "ä\x0bö\x1cü", good + "\n" + "Home | News | Sport | About | Help", good.replace(" ", " *** "), "w " * 30_000, good]
    df = spark.createDataFrame([(i % 3 or None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = [tuple(r) for r in line_rules.line_clean(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert got == [base_counts(t) for t in texts]
    cleaned = [r["clean_text"] for r in line_rules.line_clean(df).collect()]
    assert cleaned[7].startswith("A line") and "Sport" not in cleaned[7] and "***" not in cleaned[8]
    assert line_rules.line_clean(df.limit(0)).count() == 0


def test_line_rules_are_native(spark, small):
    for name in ("op8_line_rules", "op10_mixing"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def shares(sizes, weights, most):
    """Targets by going round until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: most * sizes[s] for s in over}


def check_mix(got, texts):
    sizes = collections.Counter()
    for _, t, s in texts:
        sizes[s] += len(WORD.findall(t or ""))
    want = shares(sizes, (5, 2, 1), 3)
    taken = collections.Counter()
    for (_, t, s), r in zip(texts, got):
        assert r["size"] == len(WORD.findall(t or "")) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 192 + 0.02 * want[s]


def by_key(df):
    return df.orderBy("doc_id", "size").collect()


def test_mixing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = by_key(QUERIES["op10_mixing"](spark, small))
    check_mix(got, [(r["doc_id"], r["text"], r["source"]) for r in docs])
    assert got == by_key(QUERIES["op10_mixing"](spark, small))


def seats_of(claims, seats):
    """Seats one by one to the highest quotient, the first of equal ones."""
    won = [0] * len(claims)
    for _ in range(seats):
        if not any(claims):
            break
        i = max(range(len(claims)), key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@pytest.mark.parametrize("plan", [mixing.MixPlan(shard_words=700, section_shards=3, block_words=16), mixing.MixPlan(shard_words=5000)])
def test_mixing_takes_equal_brute_force(spark, plan):
    """taken of every row, block by block; the hashes that order the rows are Spark's."""
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 400)), s) for i, s in enumerate(list("aaaaaaaabbbc") * 6)]
    rows += [(None, f"n{i} " * 30, "a") for i in range(20)] + [(None, "x y", None), (3, None, "c"), (7, "twice " * 9, "b"), (7, "twice " * 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    t = F.xxhash64("text")
    hashed = df.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"), t.alias("t"), F.xxhash64(F.lit(plan.seed), "doc_id", t).alias("of"), F.xxhash64(F.lit(plan.seed + 1), "doc_id", t).alias("rank")).collect()
    sources = sorted({r["source"] for r in hashed}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in hashed if r["source"] == s) for s in sources}
    target, up = shares(sizes, plan.weights, plan.max_repeats), lambda x, y: -(-x // y)
    blocks = seats_of([target[s] for s in sources], sum(up(sizes[s], plan.block_words) for s in sources))
    want = collections.Counter()
    for s, n_blocks in zip(sources, blocks):
        n_shards = max(1, up(sizes[s], plan.shard_words))
        shards = {}
        for r in (r for r in hashed if r["source"] == s):
            shards.setdefault(r["of"] % n_shards, []).append(r)
        sections = sorted({k // plan.section_shards for k in shards})
        words = {k: sum(r["size"] for r in v) for k, v in shards.items()}
        per_section = seats_of([float(sum(w for k, w in words.items() if k // plan.section_shards == c)) for c in sections], n_blocks)
        for c, most in zip(sections, per_section):
            inside = sorted(k for k in shards if k // plan.section_shards == c)
            for k, quota in zip(inside, seats_of([float(words[k]) for k in inside], most)):
                n = max(1, up(words[k], plan.block_words))
                passes = min(plan.max_repeats, quota // n)
                times = [passes] * words[k]
                first = spark.range(1).select(F.pmod(F.xxhash64(F.lit(plan.seed + 2), F.lit(s).cast("string"), F.lit(k).cast("long")), F.lit(n))).first()[0]
                for b in range(quota - passes * n if passes < plan.max_repeats else 0):
                    lo = (first + b) % n * plan.block_words
                    for w in range(lo, min(lo + plan.block_words, words[k])):
                        times[w] += 1
                at = 0
                for r in sorted(shards[k], key=lambda r: (r["rank"], (r["doc_id"] is not None, r["doc_id"] or 0), r["t"], r["size"])):
                    want[r["doc_id"], r["size"], sum(times[at : at + r["size"]])] += 1
                    at += r["size"]
    got = collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(df, plan=plan).collect())
    assert got == want


def test_mixing_odd_rows(spark):
    rng = np.random.default_rng(0)
    texts = [(i, "w " * int(rng.integers(0, 900)), s) for i, s in enumerate(list("aaaaaaaaaabbbbc") * 20)]
    texts += [(1000 + i, t, s) for i, (t, s) in enumerate([(None, "z"), ("", "z"), ("x " * 50, None), ("y " * 3000, "é"), ("one", "d")])]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, source string, size int")
    check_mix(by_key(mixing.mix(df)), texts)
    plan = mixing.MixPlan(shard_words=3000)
    got = by_key(mixing.mix(df.repartition(7), plan=plan))
    check_mix(got, texts)
    assert got == by_key(mixing.mix(df.repartition(2), plan=plan))
    twins = spark.createDataFrame([(None, "a b c", "s"), (None, "a b c", "s"), (1, "d e", "t")], "doc_id long, text string, source string")
    assert mixing.mix(twins).count() == 3
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.take(df)
    assert out.columns == df.columns
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("n")).collect()}
    target = {t[2]: r["target"] for t, r in zip(texts, by_key(mixing.mix(df)))}
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] + 1000 for s in "ab")


def test_sainte_lague(spark):
    """Seats one by one to the highest quotient."""
    claims = [100.0, 53.0, 53.0, 7.0, 1.0, 0.0]
    df = spark.createDataFrame(list(enumerate(claims)), "k int, claim double")
    for seats in (0, 1, 2, 3, 10, 57, 1000):
        want = [0] * len(claims)
        for _ in range(seats):
            i = max(range(len(claims)), key=lambda i: (claims[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        got = mixing.apportion(df, [], "claim", F.lit(seats), "won", [F.col("k")]).orderBy("k").collect()
        assert [r["won"] for r in got] == want


def test_pipeline(spark, small):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "source_weights", "tokens"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, steps = docs.columns, [docs]
    from quillweave.llm.common import saved

    for _, f in corpus_pipeline.STAGES:
        steps.append(saved(f(spark, steps[-1], small), "step"))
    assert all(d.columns == columns for d in steps[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in steps]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert np.mean([quality[i] in (0,) or i in ids[1] for i in quality]) > 0.97
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    left = [shingles(texts[i]) for i in sorted(ids[2])]
    assert not [1 for a, b in itertools.combinations(left, 2) if a and b and 5 * len(a & b) >= 4 * len(a | b)]
    assert steps[2].count() == len(ids[2]) and ids[2] <= ids[1]
    assert ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    assert steps[5].count() == steps[4].count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).drop("ids").collect())) == sorted(map(tuple, steps[5].drop("ids").collect()))


def test_pipeline_stages_on_odd_rows(spark, small):
    """Nulls in any column, empty and long texts, repeated rows, no rows, and columns of clashing names."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(9)).capitalize() + "." for _ in range(n))
    a, b, long = prose(12), prose(12), prose(4000)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, b, None, None), (3, b, "en", "t"), (None, prose(12), "en", "s"), (None, None, None, None), (4, None, "en", "s"), (5, "", "en", "t"), (None, "", "en", "t"), (6, long, "en", "s"), (7, prose(3) + " " + a, "en", "s"), (7, prose(9), "en", "t")]
    clash = ["_score", "_text", "_row", "_of", "c0", "h", "t", "size", "_n_removed", "_starts", "copies", "text_hash", "_taken"]
    df = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(clash))) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *(f"{c} int" for c in clash)])).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns, name
        got = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
        assert all(r["_taken"] == len(clash) - 1 and r["_score"] == 0 for r in out.collect())
        if name == "near_duplicates":
            assert set(got) == {(i, t, s) for i, t, _, s in rows if (i, t) != (3, b)} and set(got.values()) == {1}
        elif name == "repeated_passages":
            assert got[1, a, "s"] == 2 and got[2, b, None] == 1 and not any(i == 3 for i, _, _ in got)
            assert got[None, None, None] == got[4, None, "s"] == got[5, "", "t"] == got[6, long, "s"] == 1
            assert sum(n for (i, t, _), n in got.items() if i == 7 and a not in t) == 2
        elif name == "source_weights":
            assert got and all(t for _, t, _ in got)
        else:
            assert got[1, a, "s"] == 2 and got[6, long, "s"] == 1
        assert stage(spark, df.limit(0), small).count() == 0
    out = {(r["doc_id"], r["n_tokens"] > 0) for r in corpus_pipeline.tokens(spark, df, small).collect()}
    assert out == {(r[0], bool(r[1])) for r in rows} and corpus_pipeline.tokens(spark, df.limit(0), small).count() == 0
