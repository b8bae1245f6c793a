"""Paragraph dedup against brute force and planted passages."""
import hashlib
import random
import sys
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spreadforge.llm import bytetext as B
from spreadforge.llm import paragraphs as P
from tests.llm.test_decontaminate import words

VOCABULARY = [f"w{i}" for i in range(4000)]


def text(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def shingles(line):
    w = words(line)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_lines_against_brute_force(spark):
    """Whole lines in groups of equal and edited copies; similarities are either
    well above or well below 0.8, where banding finds every pair."""
    rnd = random.Random(6)
    rows, d = [], 0
    for _ in range(12):
        line = text(rnd, 70)
        for k in range(rnd.randrange(1, 5)):
            w = line.split()
            if k % 2:
                w[-1] = f"edit{d}"                       # 65 of 67 shingles are shared
            rows.append((d, text(rnd, rnd.randrange(5, 15)) + "\n" + " ".join(w).upper() + "\n" + text(rnd, 30)))
            d += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = [], {}
    for i, t in rows:
        gone = 0
        for line in t.split("\n"):
            if len(words(line)) < P.MIN_WORDS:
                continue
            s = shingles(line)
            if any(len(s & o) / len(s | o) >= 0.8 for o in seen):
                gone += len(line.encode())
            seen.append(s)
        want[i] = gone
    got = {r.doc_id: r for r in P.report(docs).collect()}
    assert {i: r.n_removed for i, r in got.items()} == want
    assert any(want.values())
    assert all(r.n_paragraphs == 2 for r in got.values())
    for block in (2, 5):
        assert {r.doc_id: r.n_removed for r in P.report(docs, block=block).collect()} == want


def test_embedded_passages_are_found_and_clean_texts_left(spark):
    rnd = random.Random(9)
    rows = []
    passages = [text(rnd, 51) for _ in range(40)]
    for i, p in enumerate(passages):
        for k in range(3):
            rows.append((3 * i + k, f"{text(rnd, rnd.randrange(3, 90))} {p} {text(rnd, rnd.randrange(3, 90))}"))
    rows += [(1000 + i, text(rnd, 120)) for i in range(40)]
    got = {r.doc_id: r for r in P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(40):
        assert got[3 * i].n_removed == 0
        for k in (1, 2):
            assert got[3 * i + k].n_removed > 0 and got[3 * i + k].kept_in[0] == 3 * i
    assert not any(got[1000 + i].n_removed for i in range(40))


def test_odd_rows(spark):
    rnd = random.Random(3)
    line = text(rnd, 40)
    rows = [(1, line), (1, line), (None, line), (2, ""), (3, None), (4, "... \n !!"), (5, "a b c " * 30), (6, "Ä é " + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("ca", F.lit("z"))
    got = P.dedup_paragraphs(docs)
    assert got.columns[:4] == docs.columns and got.count() == len(rows)
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in out[1]] == [0, 0]                 # repeated rows are one document, and the first
    assert out[None][0].n_removed == len(line) and out[None][0].kept_in == [1]
    assert out[6][0]["_kept"] == "" and out[6][0].n_removed == len(("Ä é " + line).encode())   # 36 of 38 shingles
    assert all(out[d][0].n_removed == 0 for d in (2, 3, 4))
    sha = P.report(docs).where("doc_id = 3").first().kept_sha256
    assert sha == hashlib.sha256(b"").hexdigest()
    assert P.report(docs.limit(0)).count() == 0


def test_embedded_passages_are_removed_whole(spark):
    """Passages of 20 words or more inside longer lines, equal or with one word
    changed in the middle, against all 20-word windows that stood before."""
    rnd = random.Random(12)
    rows, near = [], {}
    for i in range(60):
        p = text(rnd, rnd.randrange(20, 130))
        for k in range(3):
            rows.append((3 * i + k, f"{text(rnd, rnd.randrange(1, 90))} {p} {text(rnd, rnd.randrange(1, 90))}"))
    for i in range(20):
        w = text(rnd, 60).split()
        changed = w[:30] + [f"edit{i}"] + w[31:]
        rows += [(500 + 2 * i, f"{text(rnd, 40)} {' '.join(w)} {text(rnd, 40)}"), (501 + 2 * i, f"{text(rnd, 40)} {' '.join(changed)} {text(rnd, 40)}")]
        near[501 + 2 * i] = " ".join(changed)
    seen, want = set(), {}
    for i, t in rows:
        w, gone, bytes_gone = t.split(), set(), 0
        windows = [tuple(w[k:k + 20]) for k in range(len(w) - 19)]
        for k, window in enumerate(windows):
            if window in seen:
                gone |= set(range(k, k + 20))
        seen |= set(windows)
        runs = [k for k in gone if k - 1 not in gone]
        want[i] = sum(len(w[k]) for k in gone) + len(gone) - len(runs)
        if i in near:
            want[i] = len(near[i])
    got = {r.doc_id: r.n_removed for r in P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(n > 0 for n in want.values()) == 140


def test_short_lines_and_blocks(spark):
    """Lines under 20 words (near copies from five words on, equal ones below)
    and hard-wrapped blocks, none of which holds a repeated 20-word passage."""
    rnd = random.Random(15)
    line = text(rnd, 19)
    edited = line.rsplit(" ", 1)[0] + " edit"                     # 14 of 16 shingles
    short = text(rnd, 3)
    words_ = text(rnd, 120).split()
    wrapped = "\n".join(" ".join(words_[k:k + 12]) for k in range(0, 120, 12))
    changed = words_[:8] + ["one"] + words_[9:]
    other = "\n".join(" ".join(changed[k:k + 17]) for k in range(0, 120, 17))    # 110 of 120 shingles, wrapped anew
    title, long = text(rnd, 2), text(rnd, 60)
    rows = [(0, f"{text(rnd, 15)}\n\n{line}\n\n{text(rnd, 15)}"), (1, f"{text(rnd, 15)}\n\n{edited}\n\n{text(rnd, 15)}"),
            (2, f"{short}\n\n{text(rnd, 15)}"), (3, f"{text(rnd, 15)}\n\n{short.upper()}"), (4, f"{text(rnd, 15)}\n\n{wrapped}\n\n{text(rnd, 15)}"),
            (5, f"{text(rnd, 15)}\n\n{other}\n\n{text(rnd, 15)}"), (6, f"{title}\n{long}")]    # a block like the line inside it
    got = {r.doc_id: r for r in P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {0: 0, 1: len(edited), 2: 0, 3: len(short), 4: 0, 5: len(other), 6: 0}
    assert [got[i].kept_in for i in (1, 3, 5)] == [[0], [2], [4]]


def test_tasks_hold_small_parts_of_a_batch(spark, monkeypatch):
    """Python workers work on a small part of an Arrow batch at a time and hand
    results on in pieces, so they need a few MB and not a multiple of the batch."""
    rnd = random.Random(18)
    texts = [text(rnd, 300) for _ in range(500)] * 10
    docs = spark.createDataFrame(list(enumerate(texts[480:520])), "doc_id long, text string")
    made, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema, *more: made.append(run) or plain(df, run, schema, *more))
    for kind in ("line", "piece"):
        P.occurrences(docs, kind)
    P.dedup_paragraphs(docs)
    ids, spans = pa.array(range(len(texts))), pa.array([None] * len(texts), pa.list_(pa.struct([(x, pa.int64()) for x in ("lo", "hi", "kept_in", "src")])))
    found = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "row", "text"])
    cut = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids, spans], names=["doc_id", "text", "row", "spans"])
    for run, batch, n in ((made[0], found, len(texts)), (made[1], found, None), (made[-1], cut, len(texts))):
        tracemalloc.start()
        rows = [(out.num_rows, out.nbytes) for out in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20 and max(size for _, size in rows) < 2 << 20
        assert n is None or sum(k for k, _ in rows) == n


def test_steps_take_many_texts_at_once(spark, monkeypatch):
    """Python's work for a short text is a small part of what a run of texts
    costs, in every step: few function calls a text."""
    rnd = random.Random(21)
    n = 600
    texts = [text(rnd, 60) for _ in range(n)]
    docs = spark.createDataFrame([(0, texts[0])], "doc_id long, text string")
    made, plain = {}, type(docs).mapInArrow

    def keep(df, run, schema, *more):
        made[run.__qualname__.split(".")[0]] = run
        return plain(df, run, schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", keep)
    P.occurrences(docs, "piece")
    P.dedup_paragraphs(docs)
    ids, place = pa.array(range(n)), {"lo": 0, "hi": len(texts[0].split()[0])}
    lines = pa.array([[{"g": k, "ca": k, "cb": k, "lo": 0, "hi": len(t)}] for k, t in enumerate(texts)], pa.list_(pa.struct(
        [("g", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])))
    pieces = pa.array([[{"ca": k, "at": 20}] for k in range(n)], pa.list_(pa.struct([("ca", pa.int64()), ("at", pa.int32())])))
    spans = pa.array([[{**place, "kept_in": 7, "src": None, "shift": None, "before": None, "after": None}]] * n, pa.list_(pa.struct(
        [("lo", pa.int32()), ("hi", pa.int32()), ("kept_in", pa.int64()), ("src", pa.int64()), ("shift", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])))
    sets = pa.array([bytes(range(k % 200, k % 200 + 50)) for k in range(0, n, 2) for _ in range(2)], pa.binary())
    batches = {"occurrences": [ids, ids, pa.array(texts)], "_line_sets": [pa.array(texts), lines], "_first_pieces": [pa.array(texts), pieces],
               "dedup_paragraphs": [ids, pa.array(texts), ids, spans], "_verified": [pa.array([k // 2 for k in range(n)]), ids, ids, sets]}
    names = {"occurrences": ["doc_id", "row", "text"], "_line_sets": ["text", "lines"], "_first_pieces": ["text", "pieces"],
             "dedup_paragraphs": ["doc_id", "text", "row", "spans"], "_verified": ["g", "ca", "cb", "s"]}
    for step, columns in batches.items():
        calls = [0]

        def count(frame, event, arg):
            calls[0] += event in ("call", "c_call")

        batch = pa.RecordBatch.from_arrays(columns, names=names[step])
        list(made[step](iter([batch])))
        sys.setprofile(count)
        try:
            rows = sum(out.num_rows for out in made[step](iter([batch])))
        finally:
            sys.setprofile(None)
        assert rows >= n // 2 and calls[0] < 4 * n, (step, rows, calls[0])


def test_pieces_of_a_run_are_those_of_each_text():
    """Short, empty and repetitive texts: no piece depends on the texts beside it."""
    rnd = np.random.default_rng(22)
    for choice in (1, 4, 13):
        texts = [rnd.integers(0, k, size, dtype=np.uint64) for size in (0, 1, 7, 8, 14, 15, 16, 40, 300) for k in (2, 1 << 40)] * 2
        rnd.shuffle(texts := np.array(texts, object))
        number = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        got = P._pieces(np.concatenate(list(texts)).astype(np.uint64), number, 8, choice).tolist()
        want, begin = [], 0
        for h in texts:
            grams = B.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
            want += [begin + k for k in B.minimizers(grams, choice).tolist() if k + 8 <= len(h)]
            begin += len(h)
        assert got == want and len(got) > 40


def test_buckets_against_brute_force():
    """Buckets of several groups of similar sets, of sets that share values but
    are not similar, and of single sets."""
    rnd = random.Random(23)
    for similarity in (0.5, 0.8):
        buckets = []
        for _ in range(60):
            groups = [rnd.sample(range(400), rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 5))]
            buckets.append([set(g) ^ set(rnd.sample(g, min(len(g) - 1, rnd.randrange(4)))) for g in groups for _ in range(rnd.randrange(1, 6))])
        sets = [s for b in buckets for s in b]
        ends, cut = (np.concatenate([[0], np.cumsum([len(x) for x in xs])]) for xs in (sets, buckets))
        u, v = P._similar(np.array([x for s in sets for x in sorted(s)], np.uint64), ends, cut, similarity)

        def parts(links):
            label = list(range(len(sets)))
            for a, b in links:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
            return label

        own = np.repeat(np.arange(len(buckets)), np.diff(cut))
        want = [(i, j) for i in range(len(sets)) for j in range(i) if own[i] == own[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
        assert all(own[u] == own[v]) and parts(zip(u.tolist(), v.tolist())) == parts(want)


def test_shuffle_files_go_with_the_tables_they_were_for(spark):
    """No shuffle file of the steps before is left when the result is written."""
    jsc, name = spark.sparkContext._jsc.sc(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)

    def blocks():
        return sum(1 for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(jsc.env().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle())

    rnd = random.Random(24)
    line = text(rnd, 40)
    have = blocks()
    docs = spark.createDataFrame([(k, f"{text(rnd, 30)} {line}\n{line}") for k in range(20)], "doc_id long, text string")
    P.dedup_paragraphs(docs)
    for _ in range(50):
        if blocks() <= have:
            break
        time.sleep(0.1)
    assert blocks() <= have and spark.conf.get(name) == before
