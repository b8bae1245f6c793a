"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spreadforge.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def near_words(words):
    """By deletions: neighbours share a word with one code point less."""
    by: dict = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(v, set()).add(w)
    out = {w: set() for w in words}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            out[w] |= {x for x in by[v] if one_edit(w, x)}
    return out


def brute(docs, least=7, min_count=2, ratio=10):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= min_count}
    form, near = {}, near_words(n)
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_scan_finds_every_pair_of_a_sorted_list():
    for seed in range(40):
        rnd = random.Random(seed)
        lists = [sorted({"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 7))) for _ in range(rnd.randrange(1, 60))}) for _ in range(4)]
        words = [w for part in lists for w in part]
        group = np.repeat(np.arange(4), [len(p) for p in lists])
        length = np.array([len(w) for w in words])
        codes = np.full((len(words), max(1, length.max())), -1, np.int32)
        for i, w in enumerate(words):
            codes[i, :len(w)] = [ord(c) for c in w]
        a, b = S.scan(codes, length, group)
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if group[i] == group[j] and one_edit(words[i], words[j])}
        assert len(a) == len(set(zip(a.tolist(), b.tolist()))) and set(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("list_words", [1, 4, 2000])
def test_near_words_by_lists_of_any_size(spark, list_words):
    rnd = random.Random(list_words)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(300)}
    # a third of all words share both ends, very long words, and one word within another
    words |= {"prefix" + "".join(rnd.choice("xyz") for _ in range(5)) + "ending" for _ in range(120)}
    words |= {"q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1499, "q" * 3000 + "r", "r" + "q" * 3000}
    n = {w: rnd.randrange(1, 500) for w in words}
    found = S.near(spark.createDataFrame(sorted(n.items()), "word string, n long"), list_words).collect()
    want = {w: (len(x), *min((-n[v], v) for v in x)) for w, x in near_words(n).items() if x}
    assert {r.word: (r.n_near, -r.best_n, r.best) for r in found} == want and len(found) == len(want)


def test_variants_of_odd_documents(spark):
    rnd = random.Random(7)
    stems = ["variants", "spelling", "naïvement", "département", "ÉCOLESÀ", "Grouping", "telephone", "straße×÷ÿ"]
    docs = [(i, " ".join(rnd.choice([w, w, w.upper(), w[:3] + w[4:], w + "s"]) for w in rnd.choices(stems, k=60))) for i in range(60)]
    docs += [(None, "variants variantz variantz"), (5, None), (6, ""), (7, "short words only"), (3, docs[3][1]), (3, docs[3][1]), (8, "z" * 20000 + " " + "z" * 20000), (9, "telephone," * 3000)]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, word string, n int")
    assert got(S.variants(frame)) == brute(docs)
    assert any(r[1] for r in brute(docs)) and any(r[2] not in (r[0], r[1]) for r in brute(docs))
    assert S.variants(frame.where("false")).collect() == []


def test_whole_table(spark):
    from spreadforge.llm.queries import QUERIES
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_spelling"][0](spark, "/root/testdata/sf0.01")) == brute(docs)
