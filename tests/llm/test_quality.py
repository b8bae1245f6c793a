"""Held-out accuracy of the pairwise ranking; odd rows."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from spreadforge.llm import bytetext, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == docs.count()
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) >= 0.97
    # labels of held-out rows are never read
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in rows) < 1e-6


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, "some words here", "x"), (2, "", "x"), (3, None, "x"), (None, "!!! ###", "x"), (1, "some words here", "x"), (4, "a" * 500_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("x", F.lit(1)).withColumn("whole", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == len(rows) and all(abs(r.score - 0.7) < 1e-12 for r in got)
    one = spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, quality int")
    kept = quality.accepted(docs, one)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    both = spark.createDataFrame([(1, 1), (4, 0), (2, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.classify(docs, both).collect()}
    assert scores[1] > scores[4]
    assert quality.classify(docs.limit(0), both).count() == 0


def test_features_of_single_texts_equal_features_of_a_batch():
    import pyarrow as pa
    texts = ["one two two\nthree", "", "ÄÖ!! x | y", "a b c a b c a b c", " \n "]
    (_, _, data, off), = bytetext.chunks(pa.array(texts))
    every = quality.features(data, off)
    for i, t in enumerate(texts):
        (_, _, data, off), = bytetext.chunks(pa.array([t]))
        np.testing.assert_allclose(quality.features(data, off)[0], every[i])


def test_every_labelled_row_is_learnt_from(spark):
    """More rows than the sample of 20,000 that was taken before: each of them is in a pair, of either label."""
    n = 30_000
    known = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(1).alias("quality"),
                                  F.xxhash64("id").alias("h"), F.array(F.col("id").cast("double")).alias("x"))
    for rows, good, bad in [(known, 20_000, 10_000), (known.withColumn("quality", 1 - F.col("quality")), 10_000, 20_000)]:
        got = quality.pairs(rows, good, bad).agg(F.count("*").alias("n"), F.countDistinct("good").alias("good"), F.countDistinct("bad").alias("bad")).head()
        assert got.n == 20_000 * quality.PAIRS and got.good == good and got.bad == bad
    few = quality.pairs(known.where("doc_id < 4"), 2, 2).collect()
    assert len(few) == 2 * quality.PAIRS and {r.good[0] for r in few} == {1.0, 2.0} and {r.bad[0] for r in few} == {0.0, 3.0}


def test_threshold_and_scale_come_from_all_rows(spark):
    """Means, and the threshold between the shares of the labels, over more than 20,000 rows."""
    n = 32_000
    x = F.array(*[(F.xxhash64("id", F.lit(j)) % 1000 / 1000.0 + F.when((F.lit(j) == 0) & (F.col("id") % 4 == 0), -2.5).otherwise(0.0)).alias(str(j))
                  for j in range(len(quality.NAMES))])
    rows = spark.range(n).select(F.col("id").alias("doc_id"), x.alias("x")).cache()
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("quality"))
    learnt = rows.where(~quality.held_out(F.col("doc_id")))
    assert learnt.count() > 20_000
    ranker = quality.fit(rows, labels)
    mean = learnt.agg(*[F.avg(F.get("x", F.lit(j))).alias(str(j)) for j in range(len(quality.NAMES))]).head()
    np.testing.assert_allclose(ranker.mean, list(mean), atol=1e-9)
    both = learnt.join(labels, "doc_id").agg(F.avg((ranker.score(F.col("x")) < quality.CUT).cast("double")).alias("rejected"),
                                             F.avg((F.col("quality") == 0).cast("double")).alias("bad")).head()
    assert abs(both.rejected - both.bad) < 1e-9
