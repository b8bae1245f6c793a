"""The tokenization automaton against the tokenizers library and against
merging by rank."""
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spreadforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(PATH))


def wrong(codec, library, texts):
    out = []
    for text, (ids, decoded) in zip(texts, codec.texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        if np.frombuffer(ids, "<u4").tolist() != want or decoded.decode() != library.decode(want, skip_special_tokens=False):
            out.append(text)
    return out


def merged_by_rank(symbols, merges):
    out = list(symbols)
    for u, v, uv in merges:
        i = 0
        while i < len(out) - 1:
            if (out[i], out[i + 1]) == (u, v):
                out[i:i + 2] = [uv]
            i += 1
    return out


def test_random_merge_lists_give_the_sequence_of_merging_by_rank():
    for seed in range(60):
        rnd, spelling, merges = random.Random(seed), {0: "a", 1: "b", 2: "c"}, []
        while len(merges) < 12:
            u, v = rnd.choice(list(spelling)), rnd.choice(list(spelling))
            if spelling[u] + spelling[v] not in spelling.values():
                spelling[len(spelling)] = spelling[u] + spelling[v]
                merges.append((u, v, len(spelling) - 1))
        automaton = bpe.Automaton.compile([0, 1, 2], merges, len(spelling))
        arcs, trie = bpe.Arcs(automaton), bpe.trie_table(automaton)
        words = [list(w) for n in range(1, 7) for w in itertools.product((0, 1, 2), repeat=n)]
        want = [merged_by_rank(w, merges) for w in words]
        assert [automaton.encode(w) for w in words] == want
        ids, n = bpe.encode_all(arcs, *trie, np.array(sum(words, [])), np.array([len(w) for w in words]))
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
        # one accepted sequence for each word, and a state a merge at most
        assert len(automaton.owner) <= len(merges) + 1


def test_every_code_point(codec, library):
    texts = ["a" + chr(c) + "b1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert wrong(codec, library, texts) == []


def test_odd_texts(codec, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeinthst  'sADr1éß中😀<|endoftext|>Σ\ń") for _ in range(rnd.randrange(80))) for _ in range(4000)]
    texts += ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "İI", "é e<|endoftext|>́", "a\u0000b"]
    assert wrong(codec, library, texts) == []
    for text in ("x" * 5000, "中" * 5000, "ab cd'll " * 200_000, "in the" * 900):
        assert wrong(codec, library, [text]) == []


def test_rows(spark, library):
    texts = ["Hello there", "", None, "Hello there", "<|endoftext|>", "a b " * 1000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "Hello there", "y")], "doc_id long, text string, ids string")
    want = []
    for i, t in [*enumerate(texts), (None, "Hello there")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.report(docs, PATH).collect()), key=str) == sorted(want, key=str)
    kept = {r.doc_id: r for r in bpe.encoded(docs, PATH).collect()}
    assert kept[0].decoded == library.decode(np.frombuffer(kept[0].ids, "<u4").tolist())
    assert bpe.report(docs.where(F.lit(False)), PATH).collect() == []


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, bpe.report(docs, PATH).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
