"""Model-quality metrics from scored rows: A24-A28.  Expected columns:
``transition``, ``y`` (-1/+1 true direction), ``pred`` (-1/+1 predicted class),
``p_up`` (score), ``y_mag`` and ``pred_mag`` for the regression metrics."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.operators.ordered import row_index, running_sum_max
from spreadforge.operators.quantiles import _join

KEY = "transition"
#: ranges of scores that the running count is split into
AUC_RANGES = 256


def accuracy(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """A24."""
    return scored.groupBy(KEY).agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy"),
                                   F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, y: str = "y", score: str = "p_up") -> DataFrame:
    """Exact tie-aware ROC-AUC = sum(pos * (neg_below + neg_tied / 2)) / (P N),
    NULL with a single class.  Scores are grouped, then the running count of
    negatives is a prefix scan over score ranges.  The ranges are quantiles of
    each transition's own distinct scores, so crowded scores are split as finely
    as sparse ones and no transition is ordered whole in one task."""
    g = scored.groupBy(KEY, F.col(score).alias("score")).agg(
        F.count(F.when(F.col(y) == 1, 1)).cast("double").alias("pos"),
        F.count(F.when(F.col(y) != 1, 1)).cast("double").alias("neg"))
    edges = g.groupBy(KEY).agg(F.percentile_approx(
        "score", [i / AUC_RANGES for i in range(1, AUC_RANGES)], 20 * AUC_RANGES).alias("__edges"))
    g = _join(g, edges, [KEY])
    bucket = F.size(F.filter("__edges", lambda e: e < F.col("score")))
    rs = running_sum_max(g, "neg", "score", by=KEY, bucket=bucket, cum="cum_neg", cum_max="__m")
    return rs.groupBy(KEY).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)),
                     F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def regression_metrics(scored: DataFrame, y: str = "y_mag", pred: str = "pred_mag") -> DataFrame:
    """MAE and R^2 = 1 - SSE / (n var_pop(y))."""
    e = F.col(pred) - F.col(y)
    return scored.groupBy(KEY).agg(
        F.avg(F.abs(e)).alias("reg_mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(F.col(y)) * F.count(F.col(y)))).alias("reg_r2"))


def _counts(scored: DataFrame, y: str, pred: str) -> DataFrame:
    Y, P = F.col(y), F.col(pred)
    return scored.groupBy(KEY).agg(
        F.count(F.when((Y == -1) & (P == -1), 1)).alias("nn"), F.count(F.when((Y == -1) & (P == 1), 1)).alias("np"),
        F.count(F.when((Y == 1) & (P == -1), 1)).alias("pn"), F.count(F.when((Y == 1) & (P == 1), 1)).alias("pp"))


def class_report(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and
    weighted averages (4 dp, undefined ratios are 0)."""
    c = _counts(scored, y, pred)
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    nn, np_, pn, pp = F.col("nn"), F.col("np"), F.col("pn"), F.col("pp")
    prec_n, rec_n = z(nn, nn + pn), z(nn, nn + np_)
    prec_p, rec_p = z(pp, pp + np_), z(pp, pp + pn)
    f1 = lambda p, r: F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    sup_n, sup_p = nn + np_, pn + pp
    tot = sup_n + sup_p
    acc = z(nn + pp, tot)
    w = lambda a, b: z(a * sup_n.cast("double") + b * sup_p.cast("double"), tot)
    rows = [
        ("-1", prec_n, rec_n, f1(prec_n, rec_n), sup_n),
        ("1", prec_p, rec_p, f1(prec_p, rec_p), sup_p),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, tot),
        ("macro avg", (prec_n + prec_p) / 2, (rec_n + rec_p) / 2, (f1(prec_n, rec_n) + f1(prec_p, rec_p)) / 2, tot),
        ("weighted avg", w(prec_n, prec_p), w(rec_n, rec_p), w(f1(prec_n, rec_n), f1(prec_p, rec_p)), tot),
    ]
    items = [F.struct(F.lit(lbl).alias("label"), F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"),
                      F.bround(f, 4).alias("f1"), s.cast("bigint").alias("support"))
             for lbl, p, r, f, s in rows]
    return c.select(KEY, F.explode(F.array(*items)).alias("e")).select(KEY, "e.*")


def confusion(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """2x2 confusion matrix for labels [-1, 1] with total and row shares."""
    c = _counts(scored, y, pred)
    cells = [(-1, -1, "nn"), (-1, 1, "np"), (1, -1, "pn"), (1, 1, "pp")]
    tot = F.col("nn") + F.col("np") + F.col("pn") + F.col("pp")
    row_tot = {-1: F.col("nn") + F.col("np"), 1: F.col("pn") + F.col("pp")}
    items = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(k).alias("count"),
                      F.try_divide(F.col(k).cast("double"), tot.cast("double")).alias("total_share"),
                      F.try_divide(F.col(k).cast("double"), row_tot[a].cast("double")).alias("row_share"))
             for a, b, k in cells]
    return c.select(KEY, F.explode(F.array(*items)).alias("e")).select(KEY, "e.*")


def fold_accuracy(scored: DataFrame, splits: int = 5, order: Sequence[str] = ("ts",), y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy of given scores on the walk-forward test folds (W10): of ``n``
    rows in order, fold k of ``splits`` tests the k-th of the last ``splits``
    parts of ``n div (splits + 1)`` rows."""
    p = row_index(scored, list(order), by=KEY, name="__rn")
    p = _join(p, scored.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n")), [KEY])
    m = F.floor(F.col("__n") / F.lit(splits + 1))
    fold = F.floor((F.col("__rn") - (F.col("__n") - F.lit(splits) * m)) / m)
    return (p.withColumn("fold", F.when(m > 0, fold)).where("fold >= 0")
            .groupBy(KEY, "fold").agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy")))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population std of the fold accuracies."""
    return folds.groupBy(KEY).agg(F.avg("accuracy").alias("cv_accuracy"), F.stddev_pop("accuracy").alias("cv_std"))


def model_metrics(scored: DataFrame, cv: DataFrame) -> DataFrame:
    """Per-transition metric row (accuracy, AUC, CV accuracy, MAE, R^2) rounded
    to 4 dp, as the leaderboard joins them."""
    m = accuracy(scored).join(roc_auc(scored), KEY).join(regression_metrics(scored), KEY).join(cv, KEY, "left")
    return m.select(KEY, *[F.bround(a, 4).alias(b) for a, b in (
        ("accuracy", "test_accuracy"), ("roc_auc", "roc_auc"), ("cv_accuracy", "cv_accuracy"), ("cv_std", "cv_std"),
        ("reg_r2", "reg_r2"), ("reg_mae", "reg_mae"))])


def best_accuracy_confusion(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """A28 as published: the confusion matrix of the transition with the highest
    test accuracy (ties: larger transition name), with recalls per direction."""
    acc = accuracy(scored, y, pred)
    best = acc.agg(F.max_by(KEY, F.struct("accuracy", KEY)).alias(KEY))
    return confusion(scored, y, pred).join(best, KEY, "left_semi")
