"""Ordered operators that stay distributed on long or hot series.

A window with ``orderBy`` and no (or a skewed) ``partitionBy`` puts a whole
series on one task.  Three building blocks avoid that:

* ``row_index``       (W8)  - 0-based position per series: per-bucket counts ->
  running offsets over the small bucket table -> ``row_number`` inside a bucket.
* ``halo_windows``    (W1-W3) - bounded ROWS frames by *chunk and halo*: a row is
  copied into every chunk whose frames can reach it, windows run per
  ``(series, chunk)``, only home rows are kept.  Exact (same frame contents).
* ``running_sum_max`` (W5-W7) - unbounded running sum / running max by a prefix
  scan over per-bucket totals.

Buckets and chunks derive from the data (time or row position), never from
physical partition ids, so recomputation after executor loss gives the same
result.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadforge.functions.scalar import col
from spreadforge.operators.quantiles import _join, attach

DEFAULT_CHUNK = 20_000


def _by(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def row_index(df: DataFrame, order: Sequence[str] | str, by=None, bucket: Column | None = None,
              name: str = "idx", fan: int = 1000) -> DataFrame:
    """0-based row position after ordering by ``order`` within each series.

    ``bucket`` must be non-decreasing in ``order`` (default: the calendar day of
    the first order column).  Rows are numbered inside their bucket.  Offsets
    have two levels: buckets are summed inside groups of ``fan`` neighbours (by
    bucket number), and only the groups' totals are summed per series.  Rows
    with a null key form a series, rows with a null order value come first.
    """
    by = _by(by)
    order = [order] if isinstance(order, str) else list(order)
    if bucket is None:
        bucket = F.date_trunc("DD", col(order[0]))
    number = F.unix_date(bucket.cast("date")) if _is_time(df.select(bucket.alias("b")).schema["b"].dataType) else bucket.cast("bigint")
    b = df.withColumn("__bkt", number)
    counts = b.groupBy(*by, "__bkt").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__grp", F.floor(F.col("__bkt") / F.lit(fan)))
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*by, "__grp").orderBy("__bkt").rowsBetween(*before)
    outer = Window.partitionBy(*by).orderBy("__grp").rowsBetween(*before)
    groups = counts.groupBy(*by, "__grp").agg(F.sum("__n").alias("__g")) \
        .select(*by, "__grp", F.coalesce(F.sum("__g").over(outer), F.lit(0)).alias("__base"))
    offsets = _join(counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))), groups, [*by, "__grp"]) \
        .select(*by, "__bkt", (F.col("__base") + F.col("__in")).alias("__off"))
    j = _join(b, offsets, [*by, "__bkt"])
    wr = Window.partitionBy(*by, "__bkt").orderBy(*[col(c) for c in order])
    return j.withColumn(name, (F.row_number().over(wr) - 1 + F.col("__off")).cast("bigint")) \
        .drop("__bkt", "__off")


def _is_time(kind) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


WindowFn = Callable[[Window], Column]


def halo_windows(df: DataFrame, idx: str, exprs: dict[str, WindowFn], reach: int, by=None,
                 chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Evaluate bounded backward-looking ROWS window expressions per series.

    ``exprs`` maps output names to ``fn(w)`` where ``w`` is the base window
    (partitioned by series and chunk, ordered by ``idx``); ``reach`` is the
    longest look-back in rows.  Rows are copied into the next chunks they can
    be seen from (``chunk >> reach`` keeps the copy small: 719/20000 < 4 %).
    """
    if chunk <= reach:
        raise ValueError("chunk must be larger than the window reach")
    by = _by(by)
    home = F.floor(col(idx) / F.lit(chunk)).cast("bigint")
    last = F.floor((col(idx) + F.lit(reach)) / F.lit(chunk)).cast("bigint")
    rep = df.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(home, last)))
    w = Window.partitionBy(*by, "__chunk").orderBy(col(idx))
    out = rep.select("*", *[fn(w).alias(n) for n, fn in exprs.items()])
    return out.where(F.col("__chunk") == F.col("__home")).drop("__home", "__chunk")


def lag_expr(c: str, k: int) -> WindowFn:
    """value k rows earlier (NULL for the first k rows)."""
    return lambda w: F.lag(col(c), k).over(w)


def shifted_rolling(c: str, shift: int, rows: int, min_periods: int, stat: str = "mean") -> WindowFn:
    """Statistic over the ``rows`` values ending ``shift`` rows back, NULL when
    fewer than ``min_periods`` of them are present (pandas shift+rolling)."""
    def fn(w: Window) -> Column:
        frame = w.rowsBetween(-(shift + rows - 1), -shift)
        n = F.count(col(c)).over(frame)
        v = F.avg(col(c)).over(frame) if stat == "mean" else F.stddev_samp(col(c)).over(frame)
        return F.when(n >= max(min_periods, 2 if stat == "std" else 1), v)
    return fn


def running_sum_max(df: DataFrame, value: str, order: Sequence[str] | str, by=None,
                    bucket: Column | None = None, cum: str = "cum", cum_max: str = "cum_max") -> DataFrame:
    """Running sum of ``value`` and running maximum of that sum, per series,
    ordered by ``order``; a prefix scan over per-bucket totals (``bucket``
    non-decreasing in ``order``; default: calendar month of the first order
    column), so no series is ever windowed whole."""
    by = _by(by)
    order = [order] if isinstance(order, str) else list(order)
    if bucket is None:
        bucket = F.date_trunc("MM", col(order[0]))
    b = df.withColumn("__bkt", bucket)
    wl = Window.partitionBy(*by, "__bkt").orderBy(*[col(c) for c in order]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.withColumn("__ls", F.sum(col(value)).over(wl))
    local = local.withColumn("__lm", F.max("__ls").over(wl))
    tot = local.groupBy(*by, "__bkt").agg(F.sum(col(value)).alias("__tot"), F.max("__ls").alias("__mx"))
    wp = Window.partitionBy(*by).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("__off", F.coalesce(F.sum("__tot").over(wp), F.lit(0)))
    tot = tot.withColumn("__prev", F.max(F.col("__off") + F.col("__mx")).over(wp))
    j = _join(local, tot.select(*by, "__bkt", "__off", "__prev"), [*by, "__bkt"])
    return (j.withColumn(cum, F.col("__ls") + F.col("__off"))
            .withColumn(cum_max, F.greatest(F.col("__prev"), F.col("__lm") + F.col("__off")))
            .drop("__bkt", "__ls", "__lm", "__off", "__prev"))


def halo_rolling(df: DataFrame, idx: str, lags: dict[str, tuple[str, int]],
                 rolls: dict[str, tuple[str, int, int, int, str]], by=None,
                 chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Lags and shifted rolling mean / sample std in O(1) per row.

    ``lags``:  out -> (column, k)                         value k rows back
    ``rolls``: out -> (column, shift, rows, min_periods, 'mean' | 'std')
               statistic over the ``rows`` values ending ``shift`` rows back,
               NULL with fewer than ``min_periods`` present values.

    Sliding ROWS frames re-aggregate the whole frame for every row (O(rows)
    per row).  Here positions are cut into blocks as long as the frame, so a
    frame is the end of one block and the beginning of the next.  Each row
    carries count, mean and squared deviations of its block up to itself and
    from itself on; a frame merges two of them.  Only values inside the frame
    enter, so neighbours cost no precision and an infinite value marks the
    frames that hold it and no others.
    """
    by = _by(by)
    reach = max([k for _, k in lags.values()] + [s + r for _, s, r, _, _ in rolls.values()] + [1])
    if chunk <= reach:
        raise ValueError("chunk must be larger than the window reach")
    home = F.floor(col(idx) / F.lit(chunk)).cast("bigint")
    last = F.floor((col(idx) + F.lit(reach)) / F.lit(chunk)).cast("bigint")
    rep = df.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(home, last)))
    pairs = sorted({(c, r) for c, _, r, _, _ in rolls.values()})
    helpers = []
    for rows in sorted({r for _, r in pairs}):
        block = Window.partitionBy(*by, "__chunk", F.floor(col(idx) / F.lit(rows)))
        sides = {"u": block.orderBy(col(idx)), "d": block.orderBy(col(idx).desc())}
        new = {}
        for side, o in sides.items():
            w = o.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            for i, (c, r) in enumerate(pairs):
                if r == rows:
                    x = col(c).cast("double")
                    new[f"__{side}n{i}"] = F.count(x).over(w)
                    new[f"__{side}m{i}"] = F.avg(x).over(w)
                    new[f"__{side}v{i}"] = F.var_pop(x).over(w) * F.count(x).over(w)
        helpers += list(new)
        rep = rep.select("*", *[e.alias(n) for n, e in new.items()])
    w = Window.partitionBy(*by, "__chunk").orderBy(col(idx))
    outs = {n: F.lag(col(c), k).over(w) for n, (c, k) in lags.items()}
    for n, (c, shift, rows, minp, stat) in rolls.items():
        i = pairs.index((c, rows))
        end, start = shift, shift + rows - 1
        # a frame that is a whole block needs its beginning alone
        two = F.pmod(col(idx) - F.lit(start), F.lit(rows)) != 0
        n1, m1, v1 = (F.lag(f"__u{k}{i}", end).over(w) for k in "nmv")
        n2, m2, v2 = (F.when(two, F.lag(f"__d{k}{i}", start).over(w)) for k in "nmv")
        n1, n2 = F.coalesce(n1, F.lit(0)), F.coalesce(n2, F.lit(0))
        cnt = n1 + n2
        both = (n1 > 0) & (n2 > 0)
        if stat == "mean":
            v = F.when(both, (m1 * n1 + m2 * n2) / cnt).otherwise(F.when(n1 > 0, m1).otherwise(m2))
            ok = cnt >= max(minp, 1)
        else:
            dev = F.when(both, v1 + v2 + (m1 - m2) * (m1 - m2) * n1 * n2 / cnt).otherwise(F.when(n1 > 0, v1).otherwise(v2))
            v = F.sqrt(F.greatest(F.lit(0.0), dev) / (cnt - 1))
            ok = cnt >= max(minp, 2)
        outs[n] = F.when(ok, v)
    out = rep.select("*", *[e.alias(n) for n, e in outs.items()])
    return out.where(F.col("__chunk") == F.col("__home")).drop("__home", "__chunk", *helpers)


def _starts(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Rows that have a time, with the first time of their series (``__lo``)."""
    d = df.where(col(ts).isNotNull())
    return attach(d, d.groupBy(*by).agg(F.min(col(ts)).alias("__lo")), by)


def missing_slots(df: DataFrame, ts: str = "ts", by=None, step_minutes: int = 30, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Columns ``by`` and ``ts``: the slots of every series' calendar (first
    time plus multiples of the step, up to the last time) that have no row.

    Gaps, not calendars: each time is compared with the one before it, inside
    chunks of ``chunk`` slots and, for the first time of a chunk, with the last
    one of the chunk before; a gap emits only its own slots, ``chunk`` at a time."""
    by = _by(by)
    step = int(step_minutes) * 60_000_000
    d = _starts(df, ts, by).select(*by, col(ts).alias(ts), "__lo").distinct()
    d = d.withColumn("__at", F.expr(f"timestampdiff(MICROSECOND, __lo, `{ts}`)"))
    d = d.withColumn("__c", F.floor(F.col("__at") / F.lit(step * chunk)))
    inside = Window.partitionBy(*by, "__c").orderBy("__at")
    last = d.groupBy(*by, "__c").agg(F.max("__at").alias("__end"))           # a row per chunk that has rows
    across = Window.partitionBy(*by).orderBy("__c")
    last = last.select(*by, "__c", F.lag("__end").over(across).alias("__end"))
    d = _join(d.withColumn("__prev", F.lag("__at").over(inside)), last, [*by, "__c"])
    prev = F.coalesce("__prev", "__end")
    first, stop = F.floor(prev / F.lit(step)) + 1, F.ceil(F.col("__at") / F.lit(step)) - 1
    gaps = d.select(*by, "__lo", first.cast("bigint").alias("__a"), stop.cast("bigint").alias("__b")).where("__a <= __b")
    gaps = gaps.withColumn("__k", F.explode(F.sequence("__a", "__b", F.lit(chunk).cast("bigint"))))
    slot = F.explode(F.sequence("__k", F.least(F.col("__k") + (chunk - 1), F.col("__b")))).alias("__k")
    minutes = (F.col("__k") * int(step_minutes)).cast("int")
    return gaps.select(*by, "__lo", slot).select(*by, (F.col("__lo") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias(ts))


def regular_calendar(df: DataFrame, ts: str = "ts", by=None, step_minutes: int = 30) -> DataFrame:
    """Every series on its complete ``step_minutes`` calendar (first to last
    ``ts``), so that position-based lags equal clock lags: the rows on it, and an
    all-NULL row for each missing slot.  No calendar is built or joined."""
    by = _by(by)
    on = F.expr(f"timestampdiff(MICROSECOND, __lo, `{ts}`)") % F.lit(int(step_minutes) * 60_000_000) == 0
    rest = [c for c in df.columns if c not in (*by, ts)]
    rows = _starts(df, ts, by).where(on).select(*by, ts, *[F.col(f"`{c}`") for c in rest])
    return rows.unionByName(missing_slots(df, ts, by, step_minutes), allowMissingColumns=True)
