"""BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that merging yields. It starts as one state with an
arc back to itself for every base symbol; the merge (u, v), in order of rank, puts a gadget on the arcs labelled u:
they now lead to a copy of their target that lacks the arc v, and where u and then v could be read, an arc uv leads to
the target of v. A state is therefore known by the token read last, as the gadgets of that token and, from before it
came to be, of its right part; equal ones share a state. Rows of the transition table are filled from the gadgets when
first asked for.

A word is encoded by reading it through the table. One path leads to each position at most, so arcs are tried longest
first, and a position from which the end cannot be reached is never tried again. The arcs of the path are the ids;
each arc emits its label, and decoding reads ids as arcs and emits their labels.

Texts are cut into runs without white space, as no token spans white space; each different run is normalised, split and
read once per task while the task's store, bounded in bytes, has room. A full store keeps what was used last.

Cases: null and empty texts have no ids and decode to an empty text; repeated rows and null ids are handled alike; an
empty table gives an empty result; very long texts and very long runs are read as they are and not kept; only the id and
text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm.common import Recent, rare_collections, table, tidy
from quillweave.llm.token_files import BLANK

#: Bytes of runs, and of words, that a task keeps with their ids.
STORE_BYTES = 80 << 20
WORD_BYTES = 24 << 20
#: Longer runs and words are not kept, as they hardly come again.
LONGEST = 200
#: Cells of the transition table that are kept before it is filled anew.
STORE_ARCS = 300_000
END = float("inf")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        letters = byte_letters()
        self.symbol = [vocab.get(x) for x in letters]
        self.last_symbol = [vocab.get(x + suffix) for x in letters]
        born, left, right = {}, {}, {}
        gadget: dict[tuple[int, int], int] = {}  # (u, v): rank of the gadget that cuts v after u
        first_cut: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            gadget[u, v] = rank
            first_cut.setdefault(u, rank)
            born[w], left[w], right[w] = rank, u, v
        self.gadget = gadget
        # behind: the tokens whose gadgets shape the state after a token, each with the rank up to which they do
        # before: the tokens that a token starts with, each with the rank at which it grew
        states: dict[tuple, int] = {}
        self.state, self.behind, self.before = {}, [()], {}  # state 0: nothing read, all arcs
        inner = [*born, *(i for i in vocab.values() if i not in born)]
        for x in inner:
            chain, y, end = [], x, END
            while y is not None:
                if first_cut.get(y, END) < end:
                    chain.append((y, end))
                y, end = right.get(y), born.get(y)
            key = tuple(chain)
            if key not in states:
                states[key] = len(states) + 1
                self.behind.append(key)
            self.state[x] = states[key]
            starts, y, end = [], x, END
            while y is not None:
                starts.append((y, end))
                y, end = left.get(y), born.get(y)
            self.before[x] = starts
        self.rows: list[dict[int, int]] = [{} for _ in self.behind]
        self.filled = 0
        # a trie of the tokens over base symbols: arcs to nodes, and the token that ends at each node
        spelled: dict[int, tuple[int, ...]] = {}

        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for x in sorted(inner, key=lambda i: born.get(i, -1)):
            spelled[x] = spelled[left[x]] + spelled[right[x]] if x in left else (x,)
            node = 0
            for s in spelled[x]:
                if (to := self.next[node].get(s)) is None:
                    self.next[node][s] = to = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = x
        self.size = {x: len(s) for x, s in spelled.items()}

    def arc(self, state: int, y: int) -> int:
        """The state after reading token y in a state, or -1 if a gadget has cut that arc; kept in the table."""
        to, gadget = self.state[y], self.gadget
        for a, until in self.behind[state]:
            for b, grew in self.before[y]:
                rank = gadget.get((a, b))
                if rank is not None and rank < until and rank <= grew:
                    to = -1
        if self.filled >= STORE_ARCS:
            for row in self.rows:
                row.clear()
            self.filled = 0
        self.rows[state][y] = to
        self.filled += 1
        return to

    def symbols(self, word: str) -> list[int]:
        """Base symbols of a word's bytes; the last one carries the word's end. Unknown ones are left out."""
        raw, one = word.encode(), self.symbol
        if not raw:
            return []
        out = [one[b] for b in raw]
        out[-1] = self.last_symbol[raw[-1]]
        return [x for x in out if x is not None] if None in out else out

    def encode(self, word: str) -> list[int]:
        """The arcs of the one path that spells the word."""
        s = self.symbols(word)
        n, follow, token, rows, size = len(s), self.next, self.token, self.rows, self.size
        path, left, at, state = [], [], 0, 0  # left: per arc of the path, the arcs that can still be tried in its place
        dead: set[int] = set()
        while at < n:
            node, tries = 0, []
            for k in range(at, n):
                node = follow[node].get(s[k])
                if node is None:
                    break
                if (y := token[node]) >= 0:
                    tries.append(y)
            before = state
            while True:
                while tries:
                    y = tries.pop()
                    to = rows[before].get(y)
                    if to is None:
                        to = self.arc(before, y)
                    if to >= 0 and at + size[y] not in dead:
                        break
                else:  # no arc leads on from here: back to the arc before
                    dead.add(at)
                    at -= size[path.pop()]
                    tries, before = left.pop()
                    continue
                break
            path.append(y)
            left.append((tries, before))
            at += size[y]
            state = to
        return path

    def accepts(self, ids: list[int]) -> bool:
        """Whether these arcs can be read one after the other."""
        state = 0
        for y in ids:
            to = self.rows[state].get(y)
            state = self.arc(state, y) if to is None else to
            if state < 0:
                return False
        return True


class Codec:
    """Encoder and decoder of one tokenizer file; one per task and path."""

    _all: dict[str, Codec] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: What each arc emits; the arcs of special tokens lead from every state back to the start.
        self.emits = {i: t.encode() for t, i in (model["vocab"] | self.special).items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        # beyond Latin letters, the library's own tables say what a letter is
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.other_words = pre_tokenizers.Split(Regex(split), "removed", invert=True).pre_tokenize_str
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.run = re.compile(f"[^{BLANK}]+").findall
        self.store: Recent[bytes] = Recent(STORE_BYTES)
        self.known: Recent[list[int]] = Recent(WORD_BYTES)

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._all:
            cls._all[path] = cls(path)
            rare_collections()
        return cls._all[path]

    def runs(self, text: str) -> list[str]:
        """Runs without white space; str.split knows four more characters as white space than the tokenizer does."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.run(text)
        return text.split()

    def _part(self, part: str) -> list[int]:
        if part.isascii():
            low = part.lower()
        elif max(part) < "ɐ":
            low = unicodedata.normalize("NFC", part).lower()
        else:
            low = None
        if low is None:
            words = [w for w, _ in self.other_words(self.normal(part))]
        else:
            words = (low,) if low.isalpha() else self.words(low)
        out, known = [], self.known
        for w in words:
            if (ids := known.new.get(w)) is None:
                if (ids := known.old.get(w)) is None:
                    ids = self.automaton.encode(w)
                if len(w) <= LONGEST:
                    known.room()[w] = ids
                    known.used += 200 + len(w) + 8 * len(ids)
            out += ids
        return out

    def _run(self, run: str) -> bytes:
        if self.cut and self.cut.search(run):
            ids = [i for p in self.cut.split(run) if p for i in ([self.special[p]] if p in self.special else self._part(p))]
        else:
            ids = self._part(run)
        return array("I", ids).tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        """What the arcs emit, one after the other, in UTF-8."""
        return b" ".join(map(self.emits.__getitem__, ids))

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids of a text as little-endian 32-bit integers, and their decoded text in UTF-8."""
        ids = self.ids(text)
        return ids, self.decode(array("I", ids))

    def ids(self, text: str | None) -> bytes:
        runs, store = self.runs(text or ""), self.store
        have = store.room()
        try:
            parts = [have[r] for r in runs]
        except KeyError:
            long = {}
            for r in set(runs).difference(have):
                if (got := store.old.get(r)) is None:
                    got = self._run(r)
                if len(r) <= LONGEST:
                    have[r] = got
                    store.used += 190 + len(r) + len(got)
                else:
                    long[r] = got
            parts = [long[r] if r in long else have[r] for r in runs] if long else [have[r] for r in runs]
        return b"".join(parts)

    @classmethod
    def rest(cls) -> None:
        """Keep nothing between tasks, as other work may need the worker's memory; an automaton takes a third of a second."""
        cls._all.clear()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches):
        codec = Codec.at(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found, n, one, two = [], [], [], []
                for t in part.column(1):
                    a, b = codec.encode(t.as_py())
                    n.append(len(a) // 4)
                    one.append(hashlib.sha256(a).hexdigest())
                    two.append(hashlib.sha256(b).hexdigest())
                    if ids:
                        found.append(a)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
                if ids:
                    flat = np.frombuffer(b"".join(found), "<i4")
                    ends = np.cumsum([0, *n]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, fields)
        del codec
        Codec.rest()

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), word_tokenizer(), ids=False)
