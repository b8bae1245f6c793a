"""BPE encoding and decoding with a tokenization automaton.

``Automaton.compile`` turns an ordered merge list into a deterministic finite
automaton whose arcs are labelled with tokens.  It starts with one state on
which every symbol loops and applies one gadget per merge ``u + v``, in rank
order: the target of the ``u`` arcs is copied without its ``v`` arc, all ``u``
arcs are led to the copy, and every state with a ``u`` arc gets a ``uv`` arc to
where ``v`` led.  The automaton then accepts exactly the token sequences that
merging by rank produces, one for each string; a merge adds one state at most.
A state shares the arcs of the state it was copied from, so what is stored grows
with the merges, not with states times tokens; arcs that were looked up are
kept in a transition table.

``encode`` runs a pre-split word through the automaton: from the one state that
each prefix ends in, a trie walk over the symbols proposes tokens and the table
decides which arc exists.  The work is linear in the word (times the longest
token).  ``decode`` emits the labels of the arcs.

Defined results: a null text is empty; an empty text has no tokens; the strings
of special tokens in a text become those tokens; repeated rows and null ids give
one result row each; other columns are ignored."""
from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from spreadforge.llm import bytetext as B

RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: arcs and words that a task keeps at most; beyond that it starts its table anew
KEPT_ARCS, KEPT_WORDS = 2_000_000, 400_000
#: words up to this length are encoded together and kept; texts are split into lists of words by pieces
SHORT, PIECE = 64, 1 << 20


class Automaton:
    """``labels``: token number to its symbols, a tuple of symbol numbers.
    Symbols are tokens of one symbol."""

    def __init__(self, n_tokens: int):
        self.left, self.right, self.made = [-1] * n_tokens, [-1] * n_tokens, [0] * n_tokens
        self.gadget: dict[tuple[int, int], int] = {}     # (u, v): when the v arc left the target of u
        self.owner, self.born = [-1], [0]                # of a state: the token whose arcs were led to it, and when
        self.target = [-1] * n_tokens                    # state after a token; -1: no arc has it
        self.table: dict[int, int] = {}                  # state and token to state (-1: no arc)
        self.trie: dict[int, int] = {}
        self.token_at = [-1]

    @classmethod
    def compile(cls, symbols: list[int], merges: list[tuple[int, int, int]], n_tokens: int) -> "Automaton":
        """``merges``: (left, right, merged) tokens by rank, each merged token
        made once and after its parts."""
        a = cls(n_tokens)
        for s in symbols:
            a.target[s] = 0
        for when, (u, v, uv) in enumerate(merges, 1):
            if a.target[uv] != -1:
                raise ValueError(f"token {uv} is made by two merges or is a symbol")
            a.left[uv], a.right[uv], a.made[uv] = u, v, when
            if a.target[u] == -1 or a.target[v] == -1 or not a._arc(a.target[u], v):
                continue                                 # the pair never stands side by side
            a.target[uv] = a.target[v]
            a.gadget[u, v] = when
            a.owner.append(u)
            a.born.append(when)
            a.target[u] = len(a.owner) - 1
        spelling = {s: (s,) for s in symbols}
        for u, v, uv in merges:
            if u in spelling and v in spelling:
                spelling[uv] = spelling[u] + spelling[v]
        for token, chars in spelling.items():
            if a.target[token] != -1:
                a._enter(chars, token)
        return a

    def _enter(self, chars: tuple[int, ...], token: int) -> None:
        node = 0
        for c in chars:
            key = node << 20 | c
            if key not in self.trie:
                self.trie[key] = len(self.token_at)
                self.token_at.append(-1)
            node = self.trie[key]
        self.token_at[node] = token

    def _arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc of ``token``, by the copies it comes
        from: an arc is there if no copy on the way dropped it, and a merged
        token's arc came with the arc of its left part."""
        u, until = self.owner[state], self.born[state]
        made, gadget = self.made, self.gadget
        while u != -1:
            if gadget.get((u, token), until + 1) <= until:
                return False
            if made[token] and made[token] >= made[u]:
                until = min(until, made[token])
                token = self.left[token]
            elif made[u]:
                until = min(until, made[u] - 1)
                u = self.right[u]
            else:
                return True
        return True

    def step(self, state: int, token: int) -> int:
        """The state after ``token``, -1 without an arc."""
        key = state << 20 | token
        to = self.table.get(key)
        if to is None:
            if len(self.table) >= KEPT_ARCS:
                self.table.clear()
            to = self.table[key] = self.target[token] if self._arc(state, token) else -1
        return to

    def encode(self, symbols: list[int]) -> list[int]:
        """The one token sequence that spells ``symbols`` and that the
        automaton accepts."""
        n = len(symbols)
        state, token, start = [-1] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        state[0] = 0
        trie, token_at, step = self.trie, self.token_at, self.step
        for i in range(n):
            s = state[i]
            if s == -1:
                continue                                 # no accepted sequence ends here
            node, j = 0, i
            while j < n:
                node = trie.get(node << 20 | symbols[j], -1)
                if node == -1:
                    break
                j += 1
                t = token_at[node]
                if t != -1:
                    to = step(s, t)
                    if to != -1:
                        state[j], token[j], start[j] = to, t, i
        if state[n] == -1:
            raise ValueError("the symbols have no token sequence")
        out, j = [], n
        while j:
            out.append(token[j])
            j = start[j]
        return out[::-1]


class Table:
    """Integer keys to integers in flat arrays, many keys at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which keys are there."""
        slot = self._slot(keys)
        there = self.key[slot] == keys
        todo = np.flatnonzero(~there & (self.key[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.key[slot[todo]]
            there[todo] = have == keys[todo]
            todo = todo[(have != keys[todo]) & (have != -1)]
        return self.value[slot], there

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = self.key != -1
            keys, values = np.concatenate([self.key[old], keys]), np.concatenate([self.value[old], values])
            self.__init__(int(4 * len(keys)).bit_length())
        self.n += len(keys)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] == -1]
            self.key[slot[free]] = keys[free]            # of several for one slot the last stays
            mine = free[self.key[slot[free]] == keys[free]]
            self.value[slot[mine]] = values[mine]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


class Arcs:
    """The transition table of an automaton; arcs asked for the first time are
    looked up in the automaton and added."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.table = automaton, Table()

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        want = state.astype(np.int64) << 20 | token
        to, there = self.table.get(want)
        if not there.all():
            if self.table.n > KEPT_ARCS:
                self.table, there = Table(), np.zeros(len(want), bool)
            new = np.unique(want[~there])
            a = self.automaton
            self.table.put(new, np.array([a.target[k & 0xFFFFF] if a._arc(k >> 20, k & 0xFFFFF) else -1 for k in new.tolist()], np.int32))
            to, _ = self.table.get(want)
        return to


def trie_table(a: Automaton) -> tuple[Table, np.ndarray]:
    """The trie's arcs, and the token that ends at each node."""
    arcs = Table()
    arcs.put(np.fromiter(a.trie.keys(), np.int64, len(a.trie)), np.fromiter(a.trie.values(), np.int32, len(a.trie)))
    return arcs, np.array(a.token_at, np.int32)


def encode_all(arcs: Arcs, trie: Table, token_at: np.ndarray, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Automaton.encode`` of many short words at once, ``symbols`` one after
    the other: position by position, all words take a step together.  Returns
    the tokens one after the other, and how many each word has."""
    order = np.argsort(-length, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    length, width = length[order], int(length.max())
    at = np.arange(width)[None, :]
    symbol = symbols[np.minimum(begin[:, None] + at, len(symbols) - 1)]
    state = np.full((len(length), width + 1), -1, np.int32)
    token, start = state.copy(), np.zeros_like(state)
    state[:, 0] = 0
    longer = np.searchsorted(-length, -np.arange(width + 1), side="left")      # words longer than i are the first ones
    for i in range(width):
        row = np.flatnonzero(state[:longer[i], i] != -1)
        node, j, found = np.zeros(len(row), np.int64), i, []
        while len(row):
            node, ok = trie.get(node << 20 | symbol[row, j])
            row, node, j = row[ok], node[ok].astype(np.int64), j + 1
            t = token_at[node]
            has = t != -1
            found.append((row[has], np.full(int(has.sum()), j), t[has]))
            if j >= width:
                break
            ok = j < length[row]
            row, node = row[ok], node[ok]
        if found:
            row, j, t = (np.concatenate(x) for x in zip(*found))
            to = arcs.step(state[row, i], t)
            ok = to != -1
            row, j = row[ok], j[ok]
            state[row, j], token[row, j], start[row, j] = to[ok], t[ok], i
    rows = np.arange(len(length))
    if (state[rows, length] == -1).any():
        raise ValueError("the symbols have no token sequence")
    end, out, n = length.copy(), np.zeros((len(length), width), "<u4"), np.zeros(len(length), np.int64)
    while len(rows):
        n[rows] += 1
        out[rows, width - n[rows]] = token[rows, end[rows]]
        end[rows] = start[rows, end[rows]]
        rows = rows[end[rows] > 0]
    back = np.argsort(order)
    out, n = out[back], n[back]
    return out[at >= width - n[:, None]], n


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level
    vocabularies: bytes that print stand for themselves, the rest for the
    letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: Capitals that the tokenizer's library lowers and Python's Unicode tables do not know yet (fixed values)
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def unicode_classes() -> tuple[list[str], str]:
    """Letters and numbers as the tokenizer's library has them (ranges of a
    character class), and the code points at which the Unicode tables here
    differ from its own."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, odd, classes = "".join(points), set(NEW_CAPITALS), []
    for kind in ("\\p{L}", "\\p{N}"):
        theirs = Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(every)
        classes.append(_ranges([(every[a], every[b - 1]) for _, (a, b) in theirs]))
        here = regex.compile(f"{kind}+").finditer(every)
        differ = {c for _, (a, b) in theirs for c in every[a:b]} ^ {c for m in here for c in m.group()}
        odd |= {ord(c) for c in differ}
    at = np.array(sorted(odd))
    cut = np.flatnonzero(np.diff(at) != 1)
    return classes, _ranges([(chr(a), chr(b)) for a, b in zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist())])


def _ranges(spans: list[tuple[str, str]]) -> str:
    return "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in spans)


def read_vocabulary(path: str) -> dict:
    """Compile a tokenizer file (JSON) of byte-level BPE with word ends, NFC
    and lower case; read on the driver.  Anything else raises."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, kinds = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("this file's normalisation or decoding is not supported")
    vocabulary, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    inner, last = [vocabulary[letters[b]] for b in range(256)], [vocabulary[letters[b] + end] for b in range(256)]
    merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
    n = max([*vocabulary.values(), *special.values()]) + 1
    label = [""] * n
    for text, i in [*vocabulary.items(), *special.items()]:
        label[i] = text
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    classes, odd = unicode_classes()
    return {"automaton": Automaton.compile(sorted({*inner, *last}), merges, n), "inner": inner, "last": last,
            "label": label, "special": special, "split": split, "classes": classes, "odd": odd}


class Codec:
    """Encodes whole texts; words that were seen are kept."""

    def __init__(self, vocabulary: dict):
        self.v = vocabulary
        split, (letter, number) = vocabulary["split"], vocabulary["classes"]

        def over(letter: str, number: str) -> str:
            return split.replace("[\\p{L}]", f"[{letter}]").replace("[\\p{N}]", f"[{number}]").replace("\\p{L}", letter).replace("\\p{N}", number)

        # one pattern three times: for texts in ASCII, for texts whose letters all Unicode tables agree on, and for the rest
        self.ascii, self.words, self.exact = re.compile(over("a-z", "0-9"), re.ASCII), regex.compile(split), regex.compile(over(letter, number))
        self.odd = re.compile(f"[{vocabulary['odd']}]")
        self.label = [t.encode() for t in vocabulary["label"]]
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary["special"], key=len, reverse=True)) + ")")
        self.seen: dict[str, tuple[bytes, bytes]] = {}
        self.arcs, self.trie = Arcs(vocabulary["automaton"]), trie_table(vocabulary["automaton"])
        self.inner, self.last = np.array(vocabulary["inner"]), np.array(vocabulary["last"])

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols one after the other, and the words' lengths."""
        data, length = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        out, end = self.inner[data], np.cumsum(length) - 1
        out[end] = self.last[data[end]]
        return out, length

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, a space between two."""
        label = self.v["label"]
        return " ".join([label[i] for i in ids])

    def parts(self, text: str) -> Iterator[str | list[str]]:
        """Special tokens as strings, and lists of words of bounded length
        between them."""
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                yield part
                continue
            # lower case letter by letter: str.lower would look around a capital sigma
            if part.isascii():
                low, words = part.lower(), self.ascii
            else:
                low, words = unicodedata.normalize("NFC", part).replace("Σ", "σ"), self.words
                if self.odd.search(low):
                    low, words = low.translate(NEW_CAPITALS), self.exact
                low = low.lower()
            if len(low) <= PIECE:
                yield words.findall(low)
                continue
            match = words.finditer(low)
            while words := [m.group() for m in itertools.islice(match, PIECE // 8)]:
                yield words

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not kept."""
        new = words.difference(self.seen)
        if len(self.seen) + len(new) > KEPT_WORDS:
            self.seen.clear()
            new = words
        short = [w for w in new if len(w) <= SHORT]
        for first in range(0, len(short), 20_000):
            block = short[first:first + 20_000]
            ids, n = encode_all(self.arcs, *self.trie, *self.symbols([w.encode() for w in block]))
            data, label, at = ids.tobytes(), [self.label[i] for i in ids.tolist()], 0
            for w, k in zip(block, n.tolist()):
                self.seen[w] = data[4 * at:4 * (at + k)], b" ".join(label[at:at + k])
                at += k

    def _coded(self, word: str) -> tuple[bytes, bytes]:
        if len(word) <= SHORT:
            return self.seen[word]
        ids = self.v["automaton"].encode(self.symbols([word.encode()])[0].tolist())       # long words are not kept
        return np.array(ids, "<u4").tobytes(), self.decode(ids).encode()

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text, the token ids as little-endian unsigned 32-bit
        integers and the decoded text in UTF-8.  Texts together of a bounded
        size, or one text."""
        made = []
        parts = [self.parts(t) for t in texts]
        if len(texts) > 1:
            parts = [list(p) for p in parts]
            self.learn({w for p in parts for x in p if isinstance(x, list) for w in x})
        for of_text in parts:
            ids, labels = [], []
            for part in of_text:
                if isinstance(part, str):
                    ids.append(np.array([self.v["special"][part]], "<u4").tobytes())
                    labels.append(part.encode())
                    continue
                if len(texts) == 1:
                    self.learn(set(part))
                got = [self._coded(w) for w in part] if max(map(len, part), default=0) > SHORT else [*map(self.seen.__getitem__, part)]
                if got:
                    ids.append(b"".join([g[0] for g in got]))
                    labels.append(b" ".join([g[1] for g in got]))
            made.append((b"".join(ids), b" ".join(labels)))
        return made


def encoded(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row: the token ids (binary, see
    ``Codec.text``) and the decoded text."""
    return _mapped(docs, vocabulary_path, id_column, text_column, "doc_id bigint, ids binary, decoded string",
                   lambda ids, decoded: (ids, decoded.decode()))


def report(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return _mapped(docs, vocabulary_path, "doc_id", "text", RESULT, lambda ids, decoded: (
        len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))


def _mapped(docs: DataFrame, path: str, id_column: str, text_column: str, schema: str, row) -> DataFrame:
    spark = docs.sparkSession
    # the size of one vocabulary file, whatever the size of the table
    sent = spark.sparkContext.broadcast(read_vocabulary(path))
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[t]) for n, t in (c.split(" ") for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, _, _ in B.chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                made = [row(*x) for x in codec.texts(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids[first:end], *zip(*made)], arrow)], schema=arrow)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
