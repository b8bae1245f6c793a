"""Quality classifier: Bradley-Terry pairwise ranking.

A preference pair is a labelled good document and a labelled bad one.  The
score of a document is linear in its features; the weights maximise the
likelihood that the good one of each pair wins, which is logistic loss on the
pair's feature differences without an intercept.  The threshold is a quantile
of the training scores: the share of bad labels.  The score is moved so that
this quantile lies at ``CUT`` on the logistic scale.

Features are read from the whole text alone (shares of character classes, word
lengths, repetition of words, word triples and lines).  Labels are learnt from
rows whose ``crc32(doc_id) mod 4`` is not 2, all of them: each row of the more
frequent label meets ``PAIRS`` rows of the other, dealt in turn, so that every
labelled row is in a pair.

Defined results: null and empty texts have the features of no text and get a
score like any other; rows without an id are scored and never learnt from;
labels that are null are ignored; without both labels every score is ``CUT``
(kept); repeated rows score alike; other columns are kept or ignored."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.llm import bytetext as B
from spreadforge.llm.tables import materialize, shuffled
from spreadforge.operators.ordered import row_index
from spreadforge.operators.quantiles import exact_percentiles

CUT = 0.7
PAIRS = 8
#: rows that are numbered together
PIECE = 1_000
REGULARIZATION = 1e-3
CLIP = 6.0

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: character classes: 0 control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 stop, 7 emphasis, 8 bar, 9 symbol, 10 lead byte, 11 further byte
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 9
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]], _CLASS[[ord(c) for c in "!?"]], _CLASS[ord("|")] = 6, 7, 8
_CLASS[192:], _CLASS[128:192] = 10, 11
N_CLASS = 12
NAMES = ([f"class_{k}" for k in range(N_CLASS)] + ["log_bytes", "log_words", "log_lines", "word_length", "short_words", "long_words", "upper_words",
         "symbol_end", "same_as_last", "distinct_words", "repeated_triples", "repeated_lines", "line_words"])


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys of each text."""
    own = np.unique(B.mix(keys ^ B.mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return np.bincount(text[own], minlength=n)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Feature matrix (texts x ``NAMES``) of a run of texts."""
    n = len(off) - 1
    size = np.diff(off)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS)
    share = np.sqrt(counts / np.maximum(size, 1)[:, None])
    start, end, text = B.runs(~_SPACE[data], off)
    words = np.bincount(text, minlength=n)
    per_word = 1.0 / np.maximum(words, 1)

    def mean(x):
        return np.bincount(text, weights=x, minlength=n) * per_word

    length = end - start
    h = B.range_hash(data, start, end)
    lo, le, lt = B.runs(data != 10, off)
    lines = np.bincount(lt, minlength=n)
    lh = B.range_hash(data, lo, le)
    if len(h):
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])])
        first, last = _CLASS[data[start]], _CLASS[data[end - 1]]
        triple = B.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
        inside = text[2:] == text[:-2]
        n3 = np.bincount(text[:-2][inside], minlength=n)
        d3 = _distinct(triple[inside], text[:-2][inside], n)
    else:
        same = first = last = np.zeros(0)
        n3 = d3 = np.zeros(n)
    more = [np.log1p(size), np.log1p(words), np.log1p(lines), mean(np.minimum(length, 40)), mean(length <= 2), mean(length > 12), mean(first == 2),
            mean(last >= 7), mean(same), _distinct(h, text, n) / np.maximum(words, 1) ** 0.85 if len(h) else np.zeros(n),
            np.sqrt((n3 - d3) / np.maximum(n3, 1)), np.sqrt((lines - _distinct(lh, lt, n)) / np.maximum(lines, 1)) if len(lh) else np.zeros(n),
            np.log1p(words / np.maximum(lines, 1))]
    return np.column_stack([share, *more])


def featurize(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``x``, the features of the text."""
    src = docs.select(*keep, "text")
    schema = src.drop("text").schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            parts = [np.empty((0, len(NAMES)))]
            for first, end, data, off in B.chunks(batch.column(len(keep))):
                parts.append(features(data, off))
            x = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(batch.columns[:len(keep)] + [lists], names=[*keep, "x"])

    return src.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def pairs(known: DataFrame, n_good: int, n_bad: int, each: int = PAIRS) -> DataFrame:
    """``good, bad, t`` feature vectors: every row of the more frequent label
    against ``each`` rows of the other one, dealt in turn in hash order, the
    ``t``-th of its pairs."""
    many, few = ("good", "bad") if n_good >= n_bad else ("bad", "good")
    buckets = max(n_good, n_bad) // PIECE + 1
    known = known.where("quality IN (0, 1)").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("side"), "h", "doc_id", "x")
    at = F.floor((F.col("h") / float(2 ** 64) + 0.5) * buckets)
    rows = materialize(row_index(known, ["h", "doc_id"], by="side", bucket=at, name="k").select("side", "k", "x"))
    dealt = (rows.where(F.col("side") == many).select("k", F.col("x").alias(many), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("t"))
             .withColumn("k", F.pmod(F.col("k") * each + F.col("t"), F.lit(min(n_good, n_bad)))))
    return dealt.join(rows.where(F.col("side") == few).select("k", F.col("x").alias(few)), "k").select("good", "bad", "t")


class Ranker:
    """Weights, scale and threshold of a fitted ranking."""

    def __init__(self, mean, scale, weight, threshold):
        self.mean, self.scale, self.weight, self.threshold = mean, scale, weight, threshold

    def score(self, x: Column) -> Column:
        """Score in (0, 1); ``CUT`` at the threshold."""
        n = len(self.weight)
        centre, scale, weight = (F.array(*[F.lit(float(v)) for v in a]) for a in (self.mean, self.scale, self.weight))
        z = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(weight, i) * F.greatest(
            F.lit(-CLIP), F.least(F.lit(CLIP), (F.get(x, i) - F.get(centre, i)) / F.get(scale, i))))
        raw = F.aggregate(z, F.lit(0.0), lambda a, b: a + b)
        shift = math.log(CUT / (1 - CUT)) - self.threshold
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw + F.lit(float(shift)))))


def fit(rows: DataFrame, labels: DataFrame) -> Ranker:
    """Learn from all ``rows`` (``doc_id, x``) with ``labels`` (``doc_id,
    quality``), held-out rows left aside."""
    k = len(NAMES)
    known = (rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .join(shuffled(labels.where("quality is not null").select("doc_id", "quality")), "doc_id")
             .withColumn("h", F.xxhash64("doc_id", "x", F.lit(11))))
    known = materialize(known)
    got = known.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("quality") == q, 1)).alias(n) for q, n in ((1, "n_good"), (0, "n_bad"))], F.coalesce(F.avg(F.when(F.col("quality") == 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("bad"),
                    *[f(F.get("x", F.lit(i))).alias(f"{a}{i}") for i in range(k) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    mean = np.array([got[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([got[f"s{i}"] or 0.0 for i in range(k)])
    scale[scale < 1e-9] = 1.0
    if not (got["n_bad"] and got["n_good"]):
        return Ranker(mean, scale, np.zeros(k), 0.0)
    centre, width = (F.array(*[F.lit(float(v)) for v in a]) for a in (mean, scale))
    z = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(
        F.lit(-CLIP), F.least(F.lit(CLIP), (F.get("x", i) - F.get(centre, i)) / F.get(width, i))))
    known = materialize(known.withColumn("x", z))
    # a won pair and the same pair lost have one loss: every other pair is turned, so that both labels occur
    turned = F.col("t") % 2 == 1
    won = pairs(known, got["n_good"], got["n_bad"]).select(F.zip_with("good", "bad", lambda a, b: F.when(turned, b - a).otherwise(a - b)).alias("d"),
                                                           F.when(turned, 0.0).otherwise(1.0).alias("label"))
    train = materialize(won).select(array_to_vector("d").alias("features"), "label")
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=REGULARIZATION, maxIter=100).fit(train)
    weight = model.coefficients.toArray()
    raw = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weight]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    # halfway between the last of the rejected and the first of the kept
    at = min(max(int(round(got["bad"] * got["n"])), 1), got["n"] - 1)
    threshold = exact_percentiles(known.select(raw.alias("raw")), "raw", [(at - 0.5) / (got["n"] - 1)], names=["cut"]).head()["cut"]
    return Ranker(mean, scale, weight, float(threshold))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, held_out, score, predicted``."""
    rows = materialize(featurize(docs, "doc_id"))
    score = fit(rows, labels).score(F.col("x"))
    return (rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0)))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    ranker = fit(materialize(featurize(docs, "doc_id")), labels)
    scored = featurize(docs.select(F.struct(*docs.columns).alias("whole"), F.col("text").alias("text")), "whole")
    return scored.where(ranker.score(F.col("x")) >= CUT).select("whole.*")
