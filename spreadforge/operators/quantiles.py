"""Exact percentiles (linear interpolation, as numpy / ``quantile_cont``) by
narrowing: values are never all exchanged, and no group is held in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
which breaks on a hot group.  Here, at every size alike:

1. an approximate sketch per group (``percentile_approx``, bounded memory,
   merged map-side) brackets each wanted rank by the values at
   ``p -/+ 4/accuracy``;
2. one conditional aggregate per group, merged map-side, counts the rows below,
   at both ends of and strictly inside every bracket;
3. while a bracket has more than ``bound`` rows strictly inside, a second sketch
   of those rows alone narrows it (to about 1/64) and step 2 is repeated;
4. only the values strictly inside a bracket are counted and exchanged; a
   prefix scan over them finds the two order statistics, which are interpolated.

So a group sends a few numbers per partition, and at most ``bound`` rows per
wanted rank.  The table of brackets has one row per group; it is written, so
that it is computed once and its size is known when its join is planned: small
ones are broadcast under Spark's own limit, larger ones are not.
"""
from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.functions.scalar import col
from spreadforge.session import materialize

DEFAULT_ACCURACY = 100_000
#: most rows strictly inside a bracket that are sorted together
DEFAULT_BOUND = 1_000_000
#: parts that a further sketch cuts a wide bracket into
GRID = 256


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Add the columns of ``stats`` (one row per key) to ``df``.  Without keys
    ``stats`` is a single global-aggregate row: it becomes one scalar subquery
    (evaluated once, no join); with keys it is an equi-join whose small side
    AQE sizes at run time."""
    if keys:
        return _join(df, stats, keys, how)
    cols = stats.columns
    sc = stats.select(F.struct(*[F.col(c) for c in cols]).alias("__st")).scalar()
    out = df.withColumn("__st", sc)
    return out.select(*[F.col(c) for c in df.columns], *[F.col("__st").getField(c).alias(c) for c in cols])


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], by=None,
                      names: Sequence[str] | None = None, accuracy: int = DEFAULT_ACCURACY,
                      exact: bool = True, bound: int = DEFAULT_BOUND) -> DataFrame:
    """One row per group: ``by`` columns, ``n`` (non-missing count) and one
    column per probability (default names ``q_<p>``).  A null group key is a
    group.  ``exact=False`` returns the one-pass sketch values
    (``percentile_approx``) instead."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q_{p:g}" for p in probs]
    base = df.select(*[col(c).alias(c) for c in by], col(value).cast("double").alias("__x")) \
        .where(F.col("__x").isNotNull())
    if not exact:
        a = base.groupBy(*by).agg(F.count("__x").alias("n"), F.percentile_approx("__x", probs, accuracy).alias("__q"))
        return a.select(*by, "n", *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])
    P, x = len(probs), F.col("__x")
    stats = _counted(base, materialize(_bracketed(base, by, probs, accuracy)), by, P)
    while stats.where(F.exists("__p", lambda b: b["strict"] > bound)).head() is not None:
        stats = _counted(base, materialize(_narrowed(base, stats, by, bound)), by, P)

    # ranks among the rows strictly inside
    inside = (attach(base, stats, by).where(reduce(or_, [_within(x, F.col("__p")[i]) for i in range(P)]))
              .select(*by, "__x", F.explode(F.filter("__p", lambda b: _within(x, b))).alias("b"))
              .groupBy(*by, F.col("b.i").alias("__i"), (F.col("b.klo") - F.col("b.below") - F.col("b.at_lo")).alias("__ra"),
                       (F.col("b.khi") - F.col("b.below") - F.col("b.at_lo")).alias("__rb"), "__x").agg(F.count(F.lit(1)).alias("__c")))
    w = Window.partitionBy(*by, "__i").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("__r", F.sum("__c").over(w)).groupBy(*by).agg(*[
        F.min(F.when((F.col("__i") == i) & (F.col("__r") > F.col(r)), x)).alias(f"__{s}{i}")
        for i in range(P) for s, r in (("a", "__ra"), ("b", "__rb"))])
    out = attach(stats, found, by, "left")

    def statistic(i, k, picked):
        """Order statistic ``k`` (0-based) from the counts of bracket ``i``."""
        b = F.col("__p")[i]
        start = b["below"] + b["at_lo"]
        return (F.when(k < b["below"], b["prev"]).when(k < start, b["lo"]).when(k < start + b["strict"], F.col(picked))
                .when(k < start + b["strict"] + b["at_hi"], b["hi"]).otherwise(b["next"]))

    def interpolated(i):
        b = F.col("__p")[i]
        lo, hi = statistic(i, b["klo"], f"__a{i}"), statistic(i, b["khi"], f"__b{i}")
        return F.when(b["f"] == 0, lo).otherwise(lo + (hi - lo) * b["f"])

    return out.select(*by, F.col("__n").alias("n"), *[interpolated(i).alias(nm) for i, nm in enumerate(names)])


def _within(x, b):
    """Whether ``x`` lies strictly inside bracket ``b``."""
    return (x > b["lo"]) & (x < b["hi"])


def _bracketed(base: DataFrame, by: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """``by``, ``__n`` and the brackets ``__p``: wanted ranks, fraction, ends."""
    eps, P = 4.0 / accuracy, len(probs)
    ends = [max(p - eps, 0.0) for p in probs] + [min(p + eps, 1.0) for p in probs]
    sketch = base.groupBy(*by).agg(F.count("__x").alias("__n"), F.percentile_approx("__x", ends, accuracy).alias("__b"))

    def bracket(i):
        pos = (F.col("__n") - 1).cast("double") * F.lit(probs[i])
        return F.struct(F.lit(i).alias("i"), F.floor(pos).alias("klo"), F.ceil(pos).alias("khi"), (pos - F.floor(pos)).alias("f"),
                        F.col("__b")[i].alias("lo"), F.col("__b")[P + i].alias("hi"))

    return sketch.select(*by, "__n", F.array(*[bracket(i) for i in range(P)]).alias("__p"))


def _counted(base: DataFrame, stats: DataFrame, by: list[str], P: int) -> DataFrame:
    """The brackets with their row counts and the nearest values outside."""
    x = F.col("__x")

    def counts(i):
        lo, hi = F.col("__p")[i]["lo"], F.col("__p")[i]["hi"]
        return [F.count(F.when(x < lo, 1)).alias(f"__below{i}"), F.count(F.when(x == lo, 1)).alias(f"__at_lo{i}"),
                F.count(F.when((x > lo) & (x < hi), 1)).alias(f"__strict{i}"), F.count(F.when((x == hi) & (lo < hi), 1)).alias(f"__at_hi{i}"),
                F.max(F.when(x < lo, x)).alias(f"__prev{i}"), F.min(F.when(x > hi, x)).alias(f"__next{i}")]

    seen = attach(base, stats, by).groupBy(*by).agg(*[c for i in range(P) for c in counts(i)])

    def bracket(i):
        b = F.col("__p")[i]
        return F.struct(*[b[f].alias(f) for f in ("i", "klo", "khi", "f", "lo", "hi")],
                        *[F.col(f"__{f}{i}").alias(f) for f in ("below", "at_lo", "strict", "at_hi", "prev", "next")])

    return materialize(attach(stats, seen, by).select(*by, "__n", F.array(*[bracket(i) for i in range(P)]).alias("__p")))


def _narrowed(base: DataFrame, stats: DataFrame, by: list[str], bound: int) -> DataFrame:
    """Brackets with more than ``bound`` rows strictly inside are cut down to
    the few parts of ``GRID`` that hold their ranks; the others stay."""
    x = F.col("__x")
    rows = attach(base, stats, by).select(*by, "__x", F.explode(
        F.filter("__p", lambda b: (b["strict"] > bound) & _within(x, b))["i"]).alias("__i"))
    cuts = rows.groupBy(*by, "__i").agg(F.percentile_approx("__x", [j / GRID for j in range(1, GRID)], 20 * GRID).alias("__cuts"))
    cuts = cuts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__i", "__cuts"))).alias("__g"))

    def cut(b):
        g, s = F.try_element_at("__g", b["i"]), b["strict"]
        first, last = (b[k] - b["below"] - b["at_lo"] for k in ("klo", "khi"))
        j1 = (F.floor(first * GRID / s) - 1).cast("int")
        j2 = (F.ceil((last + 1) * GRID / s) + 1).cast("int")
        lo = F.when(first >= s, b["hi"]).when((first < 0) | (j1 < 1), b["lo"]).otherwise(F.get(g, j1 - 1))
        hi = F.when(last < 0, b["lo"]).when((last >= s) | (j2 >= GRID), b["hi"]).otherwise(F.get(g, j2 - 1))
        wide = g.isNotNull()
        return F.struct(*[b[f].alias(f) for f in ("i", "klo", "khi", "f")],
                        F.when(wide, lo).otherwise(b["lo"]).alias("lo"), F.when(wide, hi).otherwise(b["hi"]).alias("hi"))

    return attach(stats, cuts, by, "left").select(*by, "__n", F.transform("__p", cut).alias("__p"))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, key columns kept once."""
    r = right.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = None
    for j, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{j}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__k{j}" for j in range(len(keys))])


def exact_median(df: DataFrame, value: str, by=None, name: str = "median", **kw) -> DataFrame:
    return exact_percentiles(df, value, [0.5], by=by, names=[name], **kw)
