"""The pipeline stage by stage against brute force on its own input."""
import re
from collections import Counter

import corpus_pipeline as P

from spreadforge.llm import mix
from spreadforge.llm.tables import materialize
from tests.llm.test_simhash import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_lines(rows):
    """doc_id -> text without later three-line windows; None if nothing is left."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        ls = t.split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            first = seen.setdefault(tuple(ls[i:i + 3]), (d, i))
            if first != (d, i):
                gone |= {k for k in range(i, i + 3) if first[0] != d or k >= first[1] + 3}
        out[d] = None if len(gone) == len(ls) else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns[:len(columns)] == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert len(P.STAGES) == 5 and docs.columns == columns + ["copy"]
    every = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in label.items() if q == 1]
    bad = [d for d, q in label.items() if q == 0]
    assert sum(d in kept[0] for d in good) >= 0.97 * len(good)
    assert sum(d in kept[0] for d in bad) <= 0.1 * len(bad)
    # line dedup
    want = {d: t for d, t in brute_lines([(d, every[d]) for d in kept[0]]).items() if t is not None}
    assert kept[1] == want
    # SimHash: the smallest id of each group
    rows = [(d, brute_fp(t)) for d, t in sorted(kept[1].items())]
    assert set(kept[2]) == set(brute_groups(rows))
    # decontamination
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}

    def hit(t):
        w = words(t)
        return any(tuple(w[i:i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert set(kept[3]) == {d for d, t in kept[2].items() if not hit(t)}
    # the mixture: words per source near its target
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in kept[3].items()}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken = Counter()
    for r in docs.collect():
        taken[r.source] += size[r.doc_id]
    drawn = mix.copies(spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id in ({','.join(map(str, kept[3]))})").drop("text").join(
        spark.createDataFrame(list(kept[3].items()), "doc_id long, text string"), "doc_id")).collect()
    for r in drawn:
        largest = max(s for d, s in size.items() if source[d] == r.source)
        assert abs(taken[r.source] - r.target) <= largest + 1e-6


def test_run_on_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
