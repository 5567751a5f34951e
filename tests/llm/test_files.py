"""Token files, the BPE automaton, WARC archives and the URL cascade."""

import base64
import hashlib
import io
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from quillweave.llm import bpe_automaton, token_files, url_cascade, warc
from quillweave.llm.common import scratch
from quillweave.llm.registry import ORACLE_SQL, QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(5)
    letters = [" \n\t\r\x1c\x85\xa0 ab'sé<|endoftext|>12!?  日本\u0301ΣςİÅﬁ", "ab's1 \nét*.,'dl", "aaabbc"]
    out = ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in letters for _ in range(400)]
    return out + ["", " ", "a<|endoftext|>b  c", "<|startoftext|>", "don't 1's 's ,'s dogs' x", "x" * 5000, "ΑΣ"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.int64))
    e = token_files.EliasFano.read(io.BytesIO(token_files.EliasFano.of(v).to_bytes()))
    assert e.select(np.arange(len(v))).tolist() == v.tolist()
    assert e.slice(3, 7).tolist() == v[3:7].tolist() and e.slice(0, 10**6).tolist() == v.tolist()
    at = np.random.default_rng(len(v)).integers(0, max(1, len(v)), 20 * bool(len(v)))
    assert e.select(at).tolist() == v[at].tolist()


def test_elias_fano_is_small():
    """Sequence and directory, in the file and in memory, against log2(u / n) + 2 bits and an eighth."""
    for n, top in ((50_000, 10**9), (300_000, 300_000), (100_000, 2**42)):
        v = np.sort(np.random.default_rng(0).integers(0, top, n))
        e = token_files.EliasFano.of(v)
        bound = max(0, np.log2(top / n)) + 2.5
        assert len(e.to_bytes()) * 8 / n < bound
        back = token_files.EliasFano.read(io.BytesIO(e.to_bytes()))
        held = sum(x.nbytes for x in vars(back).values() if isinstance(x, np.ndarray))
        assert held * 8 / n < bound and back.select([0, n - 1]).tolist() == [v[0], v[-1]]


def test_elias_fano_of_far_values():
    v = np.array([0] * 300 + [2**45] * 300 + [2**45 + 1, 2**46])
    e = token_files.EliasFano.of(v)
    assert e.select(np.arange(len(v))).tolist() == v.tolist() and e.slice(299, 301).tolist() == [0, 2**45]


def test_units_encode_as_whole_texts():
    t = Tokenizer.from_file(BYTE)
    texts = odd_texts()
    for x, got in zip(texts, token_files.UnitEncoder(BYTE).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def token_rows(rows):
    t, start, out = Tokenizer.from_file(BYTE), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op4_token_files"](spark, small).collect())) == token_rows(rows)


def test_token_files_odd_rows(spark):
    rows = [(5, "a b"), (5, "a b"), (None, "x"), (None, None), (2, ""), (9, "word " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(3)
    got = sorted(map(tuple, token_files.read_ids(token_files.write_ids(df, scratch(spark, "t"), BYTE)).collect()), key=lambda r: r[1])
    assert got == token_rows(rows)
    assert token_files.read_ids(token_files.write_ids(df.limit(0), scratch(spark, "t"), BYTE)).count() == 0


def test_token_files_are_cut_by_ids(spark):
    """Ranges of many documents become many files; single documents are found through the packed sequences."""
    rows = [(None, "a b")] * 3 + [(k - 50, "word " * (k % 40)) for k in range(3000)] + [(10**12, "x " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write_ids(df, scratch(spark, "t"), BYTE, file_ids=5000)
    files = sorted(manifest.collect(), key=lambda r: r["start"])
    assert len(files) > 10 and sum(r["docs"] == 1 for r in files) >= 1
    assert all(r["ids"] <= 5000 or r["docs"] == 1 for r in files)
    want = token_rows(rows)
    assert sorted(map(tuple, token_files.read_ids(manifest).collect()), key=lambda r: r[1]) == want
    at = 0
    for r in files:
        with open(r["uri"].removeprefix("file://"), "rb") as f:
            shard = token_files.Shard(f)
            for k in (0, shard.docs // 2, shard.docs - 1):
                name, start, n, crc = want[at + k]
                ids = shard.document(k)
                assert shard.doc_ids(k, k + 1) == [name] and len(ids) == n and zlib.crc32(ids.astype("<u4").tobytes()) == crc
                assert r["start"] + shard.bounds.select(k)[0] == start
        at += r["docs"]


def test_worker_stores_are_bounded(monkeypatch):
    """Texts of ever new units and runs, Chinese ones too, through small stores: results hold and little is kept."""
    monkeypatch.setattr(token_files, "STORE_BYTES", 1 << 18)
    monkeypatch.setattr(bpe_automaton, "STORE_BYTES", 1 << 18)
    monkeypatch.setattr(bpe_automaton, "WORD_BYTES", 1 << 17)
    rng = random.Random(4)
    coder, codec = token_files.UnitEncoder(BYTE), bpe_automaton.Codec(WORD)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    word.no_truncation()
    for k in range(60):
        text = " ".join("".join(rng.choice("abcdefgé.") for _ in range(rng.randint(1, 12))) for _ in range(200))
        text += " " + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400))
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids
        ids, decoded = codec.encode(text)
        want = word.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == word.decode(want, skip_special_tokens=False)
    size = lambda d: sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items())
    for kept, limit in ((coder.kept, 1 << 18), (codec.store, 1 << 18), (codec.known, 1 << 17)):
        assert size(kept.new) + size(kept.old) < 2 * limit
    assert all(len(r) <= bpe_automaton.LONGEST for r in [*codec.store.new, *codec.store.old])


def test_automaton_equals_the_library():
    t, codec = Tokenizer.from_file(WORD), bpe_automaton.Codec(WORD)
    t.no_truncation()
    t.no_padding()
    for x in odd_texts():
        ids, text = codec.encode(x)
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert text.decode() == t.decode(want, skip_special_tokens=False)


def test_automaton_reads_long_runs():
    t, codec = Tokenizer.from_file(WORD), bpe_automaton.Codec(WORD)
    t.no_truncation()
    rng = random.Random(3)
    for x in ("".join(rng.choice("abcdefghinorst") for _ in range(1 << 20)), "é" * 100_000, "日本" * 30_000, "a" * 100_000):
        ids, text = codec.encode(x)
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and text.decode() == t.decode(want, skip_special_tokens=False)


def test_automaton_accepts_what_it_encodes():
    codec = bpe_automaton.Codec(WORD)
    m = codec.automaton
    ids = m.encode("transformation")
    assert m.accepts(ids) and m.accepts(m.encode("constitutionally"))
    pieces = [m.last_symbol[b] if k == 13 else m.symbol[b] for k, b in enumerate(b"transformation")]
    assert not m.accepts(pieces)
    assert codec.decode(ids) == b" ".join(codec.emits[i] for i in ids)


def test_gadgets_cut_arcs():
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab"])}
    m = bpe_automaton.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b")])
    assert not m.accepts([vocab["a"], vocab["a"]]) and m.accepts([vocab["aa"], vocab["a"]])
    spell = lambda w: [list(vocab)[i] for i in m.encode(w)]
    assert spell("aaa") == ["aa", "a"] and spell("aab") == ["aab"] and spell("aaab") == ["aa", "ab"] and spell("") == []
    assert m.arc(m.state[vocab["a"]], vocab["a"]) == -1


def test_bpe_query(spark, small):
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in QUERIES["op5_bpe_automaton"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "the cat", 3), (None, "the cat", 3)], "doc_id long, text string, n_tokens int")
    got = [(r["doc_id"], r["n_tokens"], r["ids"]) for r in bpe_automaton.encode(df, WORD).collect()]
    ids = Tokenizer.from_file(WORD).encode("the cat", add_special_tokens=False).ids[:2]
    assert sorted(got, key=repr) == sorted([(1, 0, []), (1, 0, []), (None, 2, ids), (None, 2, ids)], key=repr)
    assert bpe_automaton.encode(df.limit(0), WORD).count() == 0


def warc_rows(rows, least=0):
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        n = sum((x[2] or "") == (h or "") for x in rows)
        first = best[h or ""]
        revisit = n > 1 and p != first and len(raw) >= least
        out.append((p, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_warc(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op7_warc"](spark, small).collect()), key=repr) == warc_rows(rows)


@pytest.mark.parametrize("least", [0, 3])
def test_warc_odd_rows(spark, least):
    page = "<p>" + "long é " * 20_000
    rows = [(1, "http://a\r\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "alone"), (None, "u", page), (9, "u", page), (8, "u", page), (8, "u", page)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, sha string").repartition(4)
    got = warc.read_archives(warc.write_archives(df, scratch(spark, "w"), least)).drop("url", "payload")
    assert sorted(map(tuple, got.collect()), key=repr) == warc_rows(rows, least)
    assert warc.read_archives(warc.write_archives(df.limit(0), scratch(spark, "w"))).count() == 0


def test_warc_equals_sql(spark, small, same_rows):
    same_rows(QUERIES["op7_warc"](spark, small), ORACLE_SQL["op7_warc"])


def test_warc_names_are_unique_and_found(spark):
    """Repeated pages too; every revisit's WARC-Refers-To is a response's name, and no archive is empty."""
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (3, "v", "y"), (3, "w", "y"), (2, "v", "y"), (5, "z", "alone"), (5, "z", "other"), (None, "u", "x"), (7, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    for least in (0, 2):
        archives = warc.write_archives(df, scratch(spark, "w"), least).collect()
        assert sum(r["records"] for r in archives) == len(rows) and all(r["records"] and r["bytes"] for r in archives)
        heads = []
        for r in archives:
            with open(r["uri"].removeprefix("file://"), "rb") as f:
                heads += [warc.parse(x)[0] for x in warc.records(f)]
        names = {h["warc-record-id"]: h for h in heads}
        assert len(names) == len(rows)
        for h in heads:
            if (of := h.get("warc-refers-to")) is not None:
                assert names[of]["warc-type"] == "response" and names[of]["x-page-id"] == h["x-refers-to-page"]
        assert sum("warc-refers-to" in h for h in heads) == (3 if least == 0 else 0)


def test_warc_reader_validates(tmp_path):
    import io

    good = warc.record(1, "http://a", b"body", hashlib.sha1(b"body").hexdigest(), 4, None, False)
    headers, block = warc.parse(good)
    assert warc.payload_of(headers, block) == b"body" and headers["x-page-id"] == "1"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Dote"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc.payload_of(*warc.parse(good.replace(b"\r\n\r\nbody", b"\r\n\r\nbodi")))
    dictionary = zstandard.train_dictionary(2048, [b"some sample text %d " % i * 20 for i in range(200)])
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    frames = [packer.compress(good), packer.compress(b"second")]
    for head in (warc.leading_frame(dictionary.as_bytes()), warc.struct.pack("<II", warc.SKIPPABLE, len(dictionary.as_bytes())) + dictionary.as_bytes()):
        assert list(warc.records(io.BytesIO(head + b"".join(frames)))) == [good, b"second"]
    plain = zstandard.ZstdCompressor().compress(good)
    assert list(warc.records(io.BytesIO(plain))) == [good]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(plain[:-3])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"abc")))


def test_url_query_equals_sql(spark, small, same_rows):
    same_rows(QUERIES["op6_url_cascade"](spark, small), ORACLE_SQL["op6_url_cascade"])


@pytest.mark.parametrize("part_bytes", [url_cascade.PART_BYTES, 8])
def test_url_odd_rows(spark, part_bytes):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://b.net/de", "b.net", "/de", "net/", "block"),
        (3, "https://b.net", "b.net", "", None, "allow"),
        (4, None, "", "", None, "allow"),
        (5, "no scheme.net/", "", "", None, "allow"),
        (6, "http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        (7, "http://www.bad.io#top", "www.bad.io", "", None, "block"),
        (8, "http://notbad.io/", "notbad.io", "/", None, "allow"),
        (None, "http://net/", "net", "/", "net/", "block"),
        (9, "a\nb://www.bad.io?x://y", "www.bad.io", "", None, "block"),
    ]
    df = spark.createDataFrame([(*r[:2], "z") for r in rows] * 2, "page_id long, url string, host string")
    blocked = spark.createDataFrame([("bad.io",), (None,)], "key string")
    listed = blocked.union(spark.createDataFrame([(f"h{i}.io",) for i in range(40)], "key string"))
    for hosts in (blocked, listed.union(listed)):
        got = url_cascade.url_filter(df, url_cascade.RULES, hosts, part_bytes=part_bytes)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows_of(rows) * 2, key=repr)
    assert url_cascade.url_filter(df.limit(0), url_cascade.RULES, blocked, part_bytes=part_bytes).count() == 0
    none = url_cascade.url_filter(df, {}, blocked.limit(0), part_bytes=part_bytes).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def test_url_long_lists_and_urls(spark):
    """Thousands of rules and hosts in many parts, and hosts and paths of very many labels and letters."""
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = {".".join(name() for _ in range(rng.randint(1, 3))) + "/" + "".join(rng.choice(["x/", "y/"]) for _ in range(rng.randint(0, 3))): rng.choice(["block", "allow"]) for _ in range(3000)}
    hosts = {".".join(name() for _ in range(rng.randint(1, 3))) for _ in range(2000)}
    urls = ["http://" + ".".join(name() for _ in range(rng.randint(1, 5))) + "/" + "".join(rng.choice(["x/", "y/", "z"]) for _ in range(rng.randint(0, 4))) for _ in range(1500)]
    urls += ["http://" + "a." * 100_000 + "abc/x/", "http://" + "b" * 300_000 + ".abc/" + "x/" * 100_000, "http://abc" + "?" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    table = spark.createDataFrame(list(rules.items()), "key string, verdict string")
    got = {r["page_id"]: r for r in url_cascade.url_filter(df, table, spark.createDataFrame([(h,) for h in hosts], "key string"), part_bytes=256).collect()}
    for k, url in enumerate(urls):
        host, _, path = url[7:].split("?")[0].partition("/")
        path = "/" + path if "/" in url[7:].split("?")[0] else ""
        labels = host.split(".")
        tails = [".".join(labels[i:]) for i in range(max(0, len(labels) - 4), len(labels))]
        fits = [t + path[:n] for t in tails for n in (1, 3, 5, 7) if path[: n][-1:] == "/" and len(path) >= n and t + path[:n] in rules]
        rule = max(fits, key=lambda x: (len(x), x), default=None)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == (rules[rule] if rule else "block" if hosts & set(tails) else "allow")


def rows_of(rows):
    return [(r[0], *r[2:]) for r in rows]


def test_cascade_is_exact(spark):
    listed = [f"key{i}" for i in range(300)]
    universe = [f"key{i}" for i in range(5000)]
    c = url_cascade.build(spark.createDataFrame([(k,) for k in listed], "key string"), spark.createDataFrame([(k,) for k in universe], "key string"))
    want = [k in set(listed) for k in universe]
    assert c.listed(np.array(universe, object), np.zeros(len(universe), int)).tolist() == want
    assert c.parts == 1 and len(c.levels[0]) > 1 and sum(x.n_bits for x, _ in c.levels[0]) < 8 * 1500
    many = url_cascade.build(spark.createDataFrame([(k,) for k in listed], "key string"), spark.createDataFrame([(k,) for k in universe], "key string"), 32)
    part = spark.createDataFrame([(k,) for k in universe], "key string").select(url_cascade.part_of(F.col("key"), many.parts).alias("p"), "key").collect()
    assert many.parts > 5 and max(x[0].n_bits for x in many.levels.values() for x in x) < 8 * 150
    assert many.listed(np.array([r["key"] for r in part], object), np.array([r["p"] for r in part])).tolist() == [r["key"] in set(listed) for r in part]


def test_files_lie_in_the_shared_folder(spark):
    assert scratch(spark, "x").startswith(("file:", "/")) and Path(WORD).exists()
