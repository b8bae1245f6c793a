"""Fingerprints against a step-by-step model, and their estimates."""
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from spreadforge.llm import fingerprint as fp

BINS, BITS = fp.BINS, fp.BITS


def hashes(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]

    def chain(ws):
        h = 42
        for x in ws:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        return h

    return [chain(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(text):
    hs = hashes(text)
    if not hs:
        return "-" * (BINS * BITS // 4)
    least = {}
    for h in hs:
        b = (signed(h) >> 56) + 128
        least[b] = min(least.get(b, 1 << 64), signed(h))
    start, stride, _ = fp._walk(BINS)
    out = []
    for b in range(BINS):
        t, at = 0, b
        while at not in least:
            at = (start[b] + stride[b] * t) % BINS
            t += 1
        out.append(least[at] & 15)
    return "".join("%x" % v for v in out)


def jaccard(a, b):
    x, y = set(hashes(a)), set(hashes(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_report_against_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fp.report(docs).collect()}
    errors = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edit = t[:len(t) - q] + nxt[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute(t), brute(edit))
        errors += [abs(r.near_edited - jaccard(t, edit)), abs(r.near_next - jaccard(t, nxt))]
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2


def test_short_and_odd_texts(spark):
    texts = ["", None, "one", "one two", "!!! ...", "a b c d e", "a b c d e f g", "Ünï cödé 😀 x y z", "same words " * 40, "same words " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "without id"), (3, "another three"), (5, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("part", F.lit(1))
    got = fp.report(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].fingerprint == by[1][0].fingerprint == "-" * 256 and by[0][0].near_next == 1.0
    assert by[8][0].fingerprint == by[9][0].fingerprint and by[8][0].near_next == 1.0
    assert {r.fingerprint for r in by[5]} == {brute("a b c d e")} and by[2][0].fingerprint == brute("one")
    assert by[None][0].fingerprint == brute("without id")
    assert fp.report(docs.limit(0)).count() == 0
    one = fp.report(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_successors(spark):
    ids = [5, -3, 9, 9, 100, 7, 10**15]
    docs = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    order = sorted(set(ids))
    assert {r.doc_id: r.next_id for r in fp.successors(docs).collect()} == {a: b for a, b in zip(order, order[1:] + order[:1])}
