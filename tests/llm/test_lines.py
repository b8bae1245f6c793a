"""Line dedup against brute force on texts of few different lines."""
import hashlib
import random

from pyspark.sql import functions as F

from spreadforge.llm import lines


def brute(rows):
    first, out = {}, []
    docs = sorted({(d is None, d if d is not None else 0, t) for d, t in rows if t is not None})
    gone = {}
    for no, d, t in docs:
        ls = t.split("\n")
        for i in range(len(ls) - 2):
            at = first.setdefault(tuple(ls[i:i + 3]), (no, d, t, i))
            if at != (no, d, t, i):
                own = at[:3] == (no, d, t)
                gone.setdefault((no, d, t), set()).update(k for k in range(i, i + 3) if not own or k >= at[3] + 3)
    for d, t in rows:
        if t is None:
            out.append((d, 0, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        ls, g = t.split("\n"), gone.get((d is None, d if d is not None else 0, t), set())
        kept = "\n".join(x for k, x in enumerate(ls) if k not in g)
        out.append((d, len(ls), len(g), sum(1 for k in g if k - 1 not in g), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 14)))) for i in range(60)]
    rows += [(70, "a\na\na\na\na\na"), (71, "a\na\na\na"), (72, ""), (73, None), (74, "x\ny"), (75, "\n\n\n\n"), (80, "q\nr\ns\nt"), (80, "q\nr\ns\nt"),
             (81, "q\nr\ns"), (82, "l\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("mine")).withColumn("at", F.lit(1))
    assert sorted((tuple(r) for r in lines.report(docs).collect()), key=str) == brute(rows)
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.where("n_lines <> 'mine'").isEmpty()
    assert kept.count() == sum(1 for r in brute(rows) if r[2] == 0 or r[2] < r[1])


def test_null_ids_come_last(spark):
    rows = [(None, "a\nb\nc\nd"), (3, "x\na\nb\nc")]
    got = {r.doc_id: r.n_removed for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 3, 3: 0}


def test_empty_table(spark):
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
