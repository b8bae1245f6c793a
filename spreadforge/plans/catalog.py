"""The driver queries (Spark) with their SQL oracles (DuckDB).

Tables: "panel" = cleaned market panel derived from ``lineitem`` (with
spreads, directions and net demand), "scored" = one scored row per
``lineitem`` row.  See FIXTURES.md."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadforge.config import BacktestConfig, SPREADS
from spreadforge.operators import backtest as BT
from spreadforge.operators import explore as EX
from spreadforge.operators.clean import clean_market_data
from spreadforge.operators.spreads import add_spreads_and_fundamentals
from spreadforge.plans.oracle import final, panel_ctes, q, scored_sql, with_ctes
from spreadforge.plans.queries import finalize, register
from spreadforge.sources.fixtures import market_panel, scored_rows

SPR = [s for s, _, _ in SPREADS]


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned panel with spreads.  It is a reduced table (one row per
    half-hour) reused by every later stage, so it is checkpointed into the
    shared checkpoint folder: one ``lineitem`` scan, and short lineage for the
    many stages built on it."""
    from spreadforge.session import materialize
    return materialize(add_spreads_and_fundamentals(clean_market_data(raw_panel(spark, d))))


def raw_panel(spark: SparkSession, d: str, dirty: bool = False) -> DataFrame:
    """The raw market table derived from ``lineitem`` (one row per day),
    materialised once: it stands in for a stored raw table, and the cleaning
    stage then runs on a scan instead of being fused into the aggregation."""
    from spreadforge.session import materialize
    from spreadforge.sources.fixtures import dirty_panel
    return materialize(dirty_panel(spark, d) if dirty else market_panel(spark, d))


def holed(spark: SparkSession, d: str) -> DataFrame:
    """The raw table with gaps, blanks, NaN and infinities, materialised."""
    from spreadforge.session import materialize
    from spreadforge.sources.fixtures import holed_panel
    return materialize(holed_panel(spark, d))


def unpivot_sql(src: str, keep: list[str], cols: list[str], name: str = "spread") -> str:
    k = ", ".join(keep)
    return (f"SELECT {k + ', ' if k else ''}{q(name)}, value FROM (UNPIVOT (SELECT {k + ', ' if k else ''}"
            f"{', '.join(f'CAST({q(c)} AS DOUBLE) AS {q(c)}' for c in cols)} FROM {src}) "
            f"ON {', '.join(q(c) for c in cols)} INTO NAME {q(name)} VALUE value)")


# --------------------------------------------------------------------------- spreads
@register("hod_profile", with_ctes(panel_ctes() + [("lf", unpivot_sql("panel", ["hod"], SPR))], final(
    "SELECT hod, spread, avg(value) AS mean, stddev_samp(value) AS std, avg(CAST(value < 0 AS DOUBLE)) AS neg_share, "
    "avg(CAST(value = 0 AS DOUBLE)) AS zero_share, avg(CAST(value > 0 AS DOUBLE)) AS pos_share, count(value) AS n "
    "FROM lf GROUP BY hod, spread",
    dbl=["hod", "mean", "std", "neg_share", "zero_share", "pos_share"], ints=["n"], rest=["spread"])))
def q_hod_profile(spark, d):
    return finalize(EX.hod_profile(panel(spark, d)))


@register("spreads", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(SPR)} FROM panel", dbl=SPR, rest=["ts"])))
def q_spreads(spark, d):
    return finalize(panel(spark, d).select("ts", *SPR))


@register("direction_labels", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join('dir_' + s for s in SPR)} FROM panel", ints=["dir_" + s for s in SPR], rest=["ts"])))
def q_direction_labels(spark, d):
    return finalize(panel(spark, d).select("ts", *["dir_" + s for s in SPR]))


_ND = [f"NetDemand_{s}" for s in ("DAM", "IDA1", "IDA2", "IDA3")]


@register("net_demand", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(_ND)} FROM panel", dbl=_ND, rest=["ts"])))
def q_net_demand(spark, d):
    return finalize(panel(spark, d).select("ts", *_ND))


# --------------------------------------------------------------------------- backtest
_CFG = BacktestConfig()


def _sized_sql() -> list[tuple[str, str]]:
    return scored_sql() + [
        ("size_base", "SELECT transition, greatest(quantile_cont(abs(pred_mag), 0.25), 0.5e0) AS size_base "
                      "FROM scored GROUP BY transition"),
        ("sized", "SELECT s.*, least(greatest(abs(pred_mag) / b.size_base, 0.1e0), 10e0) AS volume, "
                  "abs(p_up - 0.5e0) AS conf, CAST(sign(p_up - 0.5e0) AS INTEGER) AS dir, "
                  "CAST(sign(spread) AS INTEGER) AS ss FROM scored s JOIN size_base b USING (transition)"),
        ("sized_pnl", "SELECT *, CASE WHEN dir = ss THEN abs(spread) ELSE -abs(spread) END * volume AS pnl FROM sized"),
    ]


def _trading_sql() -> str:
    parts = []
    for t in _CFG.thresholds:
        f = f"FILTER (WHERE conf > {t!r}e0)"
        parts.append(
            f"SELECT transition, {t!r}e0 AS conf_thresh, count(*) {f} AS n_trades, "
            f"round_even(CAST(count(*) FILTER (WHERE conf > {t!r}e0 AND dir = ss) AS DOUBLE) / NULLIF(count(*) {f}, 0), 4) AS hit_rate, "
            f"round_even(CASE WHEN sum(volume) {f} > 0 THEN sum(pnl) {f} / sum(volume) {f} END, 4) AS eur_per_mwh, "
            f"round_even(coalesce(sum(pnl) {f}, 0e0), 2) AS total_pnl_eur, "
            f"round_even(CASE WHEN count(*) {f} > 1 THEN avg(pnl) {f} / (stddev_pop(pnl) {f} + 1e-9) END, 4) AS sharpe_proxy, "
            f"count(*) AS test_size, round_even(CAST(count(*) {f} AS DOUBLE) / count(*), 4) AS pct_traded "
            f"FROM sized_pnl GROUP BY transition")
    return " UNION ALL ".join(parts)


_TRADE_DBL = ["conf_thresh", "hit_rate", "eur_per_mwh", "total_pnl_eur", "sharpe_proxy", "pct_traded"]


@register("trading_table", with_ctes(_sized_sql() + [("trading", _trading_sql())], final(
    "SELECT * FROM trading", dbl=_TRADE_DBL, ints=["n_trades", "test_size"], rest=["transition"])))
def q_trading_table(spark, d):
    return finalize(BT.trading_table(scored_rows(spark, d), _CFG))


# --------------------------------------------------------------------------- cleaning
from spreadforge.operators import clean as CL  # noqa: E402
from spreadforge.operators import quality as QA  # noqa: E402
from spreadforge.functions.calendar import add_calendar, add_cyclical  # noqa: E402
from spreadforge.plans.oracle import REVISION_SQL, clean_sql, holed_sql, raw_panel_sql, spreads_sql, zone_sql  # noqa: E402
from spreadforge.sources.fixtures import dirty_panel, event_bins  # noqa: E402
from spreadforge.sources.market import table_profile  # noqa: E402


def _stage(spark, d, stop, dirty=False):
    src = raw_panel(spark, d, dirty)
    return CL.clean_market_data(src, order_col="seq" if dirty else None, stop=stop)


def _stage_sql(stop, dirty=False, out="st"):
    return raw_panel_sql(dirty) + clean_sql("panel_dirty" if dirty else "panel_raw", out,
                                            seq="seq" if dirty else None, stop=stop)


@register("parse_ts", with_ctes(_stage_sql("parsed"), final(
    "SELECT ts, TradeDate, Time, StartDateTime, hour, minute, hod FROM st",
    dbl=["hod"], ints=["hour", "minute"], rest=["ts", "TradeDate", "Time", "StartDateTime"])))
def q_parse_ts(spark, d):
    return finalize(_stage(spark, d, "parsed").select("ts", "TradeDate", "Time", "StartDateTime", "hour", "minute", "hod"))


_CAL = ["dow", "month", "is_weekend", "is_winter", "is_peak"]


@register("calendar_flags", with_ctes(panel_ctes(), final(
    "SELECT ts, isodow(ts) - 1 AS dow, month(ts) AS month, CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend, "
    "CAST(month(ts) IN (11, 12, 1, 2, 3) AS INTEGER) AS is_winter, CAST(hod BETWEEN 7 AND 21 AS INTEGER) AS is_peak "
    "FROM panel", ints=_CAL, rest=["ts"])))
def q_calendar_flags(spark, d):
    return finalize(add_calendar(panel(spark, d)).select("ts", *_CAL))


_CYC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]


@register("cyclical", with_ctes(panel_ctes(), final(
    "SELECT ts, sin(2 * pi() * hod / 24e0) AS hour_sin, cos(2 * pi() * hod / 24e0) AS hour_cos, "
    "sin(2 * pi() * (isodow(ts) - 1) / 7e0) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7e0) AS dow_cos, "
    "sin(2 * pi() * month(ts) / 12e0) AS month_sin, cos(2 * pi() * month(ts) / 12e0) AS month_cos FROM panel",
    dbl=_CYC, rest=["ts"])))
def q_cyclical(spark, d):
    return finalize(add_cyclical(add_calendar(panel(spark, d))).select("ts", *_CYC))


_RAW_NUM = [c for c, _, _ in __import__("spreadforge.sources.fixtures", fromlist=["panel_spec"]).panel_spec()]


@register("normalise_missing", with_ctes(holed_sql(), final(
    "SELECT * FROM panel_holed", dbl=_RAW_NUM, rest=["TradeDate", "Time", "StartDateTime"])))
def q_normalise_missing(spark, d):
    from spreadforge.functions.scalar import normalise_missing
    return finalize(normalise_missing(holed(spark, d)))


_FILL = ["EirgridActualWind", "ISEMSOLAR_DAM", "ISEMSOLAR_IDA1", "EirGridWindFc_DAM", "EirGridWindFc_IDA1"]


@register("clip_fill_cascade", with_ctes(holed_sql() + clean_sql("panel_holed", "st", stop="must_have"), final(
    f"SELECT ts, {', '.join(_FILL)} FROM st", dbl=_FILL, rest=["ts"])))
def q_clip_fill_cascade(spark, d):
    return finalize(CL.clean_market_data(holed(spark, d), stop="must_have").select("ts", *_FILL))


_REP = ["ISEMSOLAR_IDA2", "ISEMSOLAR_IDA3", "EirGridWindFc_IDA2", "EirGridWindFc_IDA3"]


@register("window_repair", with_ctes(holed_sql() + clean_sql("panel_holed", "st"), final(
    f"SELECT ts, hod, {', '.join(_REP)} FROM st", dbl=["hod"] + _REP, rest=["ts"])))
def q_window_repair(spark, d):
    return finalize(CL.clean_market_data(holed(spark, d)).select("ts", "hod", *_REP))


@register("must_have_filter", with_ctes(holed_sql() + clean_sql("panel_holed", "st", stop="must_have"), final(
    "SELECT ts, hod, PriceDAM FROM st", dbl=["hod", "PriceDAM"], rest=["ts"])))
def q_must_have_filter(spark, d):
    return finalize(CL.clean_market_data(holed(spark, d), stop="must_have").select("ts", "hod", "PriceDAM"))


@register("dedup_rows", with_ctes(raw_panel_sql(True), final(
    "SELECT DISTINCT * FROM panel_dirty", dbl=_RAW_NUM, ints=["seq"], rest=["TradeDate", "Time", "StartDateTime"])))
def q_dedup_rows(spark, d):
    return finalize(CL.dedup_rows(dirty_panel(spark, d)))


_COLL = ["PredictedICFlow", "PriceDAM", "PriceIDA2", "hod"]


@register("collapse_duplicate_ts", with_ctes(_stage_sql("collapse", dirty=True), final(
    f"SELECT ts, TradeDate, hour, {', '.join(_COLL)} FROM st", dbl=_COLL, ints=["hour"], rest=["ts", "TradeDate"])))
def q_collapse_duplicate_ts(spark, d):
    return finalize(_stage(spark, d, "collapse", dirty=True).select("ts", "TradeDate", "hour", *_COLL))


@register("collapse_via_join", with_ctes(_stage_sql("collapse", dirty=True), final(
    f"SELECT ts, TradeDate, hour, {', '.join(_COLL)} FROM st", dbl=_COLL, ints=["hour"], rest=["ts", "TradeDate"])))
def q_collapse_via_join(spark, d):
    parsed = _stage(spark, d, "parsed", dirty=True)
    return finalize(CL.collapse_via_join(parsed, order_col="seq").select("ts", "TradeDate", "hour", *_COLL))


@register("colliding_ts", with_ctes(_stage_sql("parsed", dirty=True), final(
    "SELECT ts, seq, PredictedICFlow FROM st WHERE ts IN (SELECT ts FROM st GROUP BY ts HAVING count(*) > 1)",
    dbl=["PredictedICFlow"], ints=["seq"], rest=["ts"])))
def q_colliding_ts(spark, d):
    return finalize(QA.colliding_ts(_stage(spark, d, "parsed", dirty=True)).select("ts", "seq", "PredictedICFlow"))


@register("negative_rows", with_ctes(_stage_sql("parsed"), final(
    "SELECT ts, EirgridActualWind FROM st WHERE EirgridActualWind < 0 ORDER BY EirgridActualWind, ts LIMIT 10",
    dbl=["EirgridActualWind"], rest=["ts"])))
def q_negative_rows(spark, d):
    return finalize(QA.negative_rows(_stage(spark, d, "parsed")))


@register("dup_counts", with_ctes(_stage_sql("parsed", dirty=True), final(
    "SELECT (SELECT count(*) FROM st) AS n_rows, "
    "(SELECT count(*) FROM st) - (SELECT count(*) FROM (SELECT DISTINCT * FROM st)) AS dup_rows, "
    "(SELECT count(*) FROM st) - (SELECT count(*) FROM (SELECT DISTINCT ts FROM st)) AS dup_ts",
    ints=["n_rows", "dup_rows", "dup_ts"])))
def q_dup_counts(spark, d):
    return finalize(QA.dup_counts(_stage(spark, d, "parsed", dirty=True)))


# --------------------------------------------------------------------------- quality reports
def _validity_cols():
    from spreadforge.config import VALIDITY_EXCLUDE, VALIDITY_INCLUDE
    cols = _RAW_NUM + ["hour", "minute", "hod"]
    return [c for c in cols if any(k in c.upper() for k in VALIDITY_INCLUDE)
            and not any(x in c.upper() for x in VALIDITY_EXCLUDE)]


def _long_union(src: str, cols: list[str], exprs: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"{e.format(c=q(c))} AS {n}" for n, e in exprs.items())
        + f" FROM {src}" for c in cols)


@register("validity_report", with_ctes(_stage_sql("parsed") + [("v", _long_union(
    "st", _validity_cols(), {"non_missing_values": "count({c})", "negative_values": "count(*) FILTER (WHERE {c} < 0)"}))],
    final("SELECT \"column\", non_missing_values, negative_values, "
          "round_even(CAST(negative_values AS DOUBLE) / NULLIF(non_missing_values, 0), 6) AS proportion_negative FROM v",
          dbl=["proportion_negative"], ints=["non_missing_values", "negative_values"], rest=["column"])))
def q_validity_report(spark, d):
    return finalize(QA.validity_report(_stage(spark, d, "parsed")))


_PARSED_COLS = ["TradeDate", "Time", "StartDateTime"] + _RAW_NUM + ["ts", "hour", "minute", "hod"]


@register("missing_report", with_ctes(_stage_sql("parsed") + [("v", _long_union(
    "st", _PARSED_COLS, {"missing_count": "count(*) FILTER (WHERE {c} IS NULL)", "n": "count(*)"}))],
    final("SELECT \"column\", missing_count, round_even(missing_count * 100e0 / n, 2) AS missing_pct FROM v "
          "ORDER BY missing_count DESC, \"column\" LIMIT 20",
          dbl=["missing_pct"], ints=["missing_count"], rest=["column"])))
def q_missing_report(spark, d):
    return finalize(QA.missing_report(_stage(spark, d, "parsed")))


def _mh_cols():
    from spreadforge.config import MUST_HAVE, MUST_HAVE_PRICES
    return list(MUST_HAVE) + list(MUST_HAVE_PRICES)


@register("must_have_missing", with_ctes(holed_sql() + clean_sql("panel_holed", "st", stop="collapse") + [("v", _long_union(
    "st", _mh_cols(), {"missing_count": "count(*) FILTER (WHERE {c} IS NULL)"}))],
    final("SELECT * FROM v WHERE missing_count > 0", ints=["missing_count"], rest=["column"])))
def q_must_have_missing(spark, d):
    return finalize(QA.must_have_missing(CL.clean_market_data(holed(spark, d), stop="collapse")))


def _structural_sql():
    win = {"all": "TRUE", "ida2": "hod >= 11 AND hod < 23", "ida3": "hod >= 17 AND hod < 23"}
    parts = []
    for c, w in QA.STRUCTURAL_PAIRS:
        ins = win[w]
        parts.append(
            f"SELECT '{c}' AS \"column\", '{w}' AS \"window\", count(*) FILTER (WHERE {ins}) AS inside_total, "
            f"count(*) FILTER (WHERE ({ins}) AND {c} IS NULL) AS inside_missing, "
            f"count(*) FILTER (WHERE NOT ({ins})) AS outside_total, "
            f"count(*) FILTER (WHERE NOT ({ins}) AND {c} IS NULL) AS outside_missing FROM st")
    return " UNION ALL ".join(parts)


@register("structural_check", with_ctes(_stage_sql("must_have") + [("v", _structural_sql())], final(
    "SELECT *, CAST(inside_missing AS DOUBLE) / NULLIF(inside_total, 0) AS inside_rate, "
    "CAST(outside_missing AS DOUBLE) / NULLIF(outside_total, 0) AS outside_rate, "
    "outside_total - outside_missing AS outside_nonmissing FROM v",
    dbl=["inside_rate", "outside_rate"],
    ints=["inside_total", "inside_missing", "outside_total", "outside_missing", "outside_nonmissing"],
    rest=["column", "window"])))
def q_structural_check(spark, d):
    return finalize(QA.structural_check(_stage(spark, d, "must_have")))


def _outlier_sql():
    parts = []
    for c in QA.OUTLIER_COLUMNS:
        parts.append(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM panel WHERE {c} IS NOT NULL")
    lf = " UNION ALL ".join(parts)
    return [("lf", lf),
            ("b", "SELECT \"column\", min(value) AS minimum, max(value) AS maximum, skewness(value) AS skewness, "
                  "count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY 1"),
            ("b2", "SELECT *, q1 - 3e0 * (q3 - q1) AS lower_bound, q3 + 3e0 * (q3 - q1) AS upper_bound FROM b")]


@register("outlier_report", with_ctes(panel_ctes() + _outlier_sql(), final(
    "SELECT b2.\"column\", minimum, maximum, skewness, lower_bound, upper_bound, "
    "count(*) FILTER (WHERE value < lower_bound OR value > upper_bound) AS outlier_count, "
    "count(*) FILTER (WHERE value < lower_bound OR value > upper_bound) * 100e0 / n AS outlier_pct "
    "FROM b2 JOIN lf USING (\"column\") GROUP BY b2.\"column\", minimum, maximum, skewness, lower_bound, upper_bound, n",
    dbl=["minimum", "maximum", "skewness", "lower_bound", "upper_bound", "outlier_pct"], ints=["outlier_count"],
    rest=["column"])))
def q_outlier_report(spark, d):
    return finalize(QA.outlier_report(panel(spark, d)))


@register("inf_count", with_ctes(holed_sql() + [("v", _long_union(
    "panel_holed", _RAW_NUM, {"n_inf": "count(*) FILTER (WHERE abs({c}) = 'infinity'::DOUBLE)"}))],
    final("SELECT * FROM v", ints=["n_inf"], rest=["column"])))
def q_inf_count(spark, d):
    return finalize(QA.inf_count(holed(spark, d)))


_EVB = ("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, count(*) AS n_events"
        + "".join(f", avg(value) FILTER (WHERE event_type = '{t}') AS {t}_mean"
                  for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")


@register("missing_intervals", with_ctes([("eb", _EVB)], final(
    "SELECT ts FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM eb) "
    "WHERE ts NOT IN (SELECT ts FROM eb)", rest=["ts"])))
def q_missing_intervals(spark, d):
    return finalize(QA.missing_intervals(event_bins(spark, d)))


@register("panel_gaps", with_ctes(holed_sql() + clean_sql("panel_holed", "st"), final(
    "SELECT count(*) AS n_missing FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts "
    "FROM st) WHERE ts NOT IN (SELECT ts FROM st)", ints=["n_missing"])))
def q_panel_gaps(spark, d):
    return finalize(QA.missing_intervals(CL.clean_market_data(holed(spark, d))).agg(F.count(F.lit(1)).alias("n_missing")))


@register("order_check", final(
    "SELECT count(*) FILTER (WHERE ts < prev) AS negative_steps FROM "
    "(SELECT ts, lag(ts) OVER (ORDER BY event_id * 3 + CASE WHEN event_id % 7 = 0 THEN 11 ELSE 0 END) AS prev FROM events)",
    ints=["negative_steps"]))
def q_order_check(spark, d):
    """Ingestion ids with gaps, every seventh event registered late."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    late = F.col("event_id") * 3 + F.when(F.col("event_id") % 7 == 0, 11).otherwise(0)
    return finalize(QA.order_check(ev.withColumn("seen", late), "ts", "seen"))


@register("load_profile", with_ctes(panel_ctes(), final(
    "SELECT count(*) AS n_rows, min(ts) AS ts_min, max(ts) AS ts_max FROM panel",
    ints=["n_rows"], rest=["ts_min", "ts_max"])))
def q_load_profile(spark, d):
    return finalize(table_profile(panel(spark, d)).select("n_rows", "ts_min", "ts_max"))


# --------------------------------------------------------------------------- exploration
_PRICES = ["PriceDAM", "PriceIDA1", "PriceIDA2", "PriceIDA3", "PriceImbalance"]
#: fixed values: the described columns
_SUMMARY_COLS = ["PriceDAM", "PriceIDA1", "PriceIDA2", "PriceIDA3", "PriceImbalance",
                 "EirGridDemandFc_DAM", "EirGridDemandFc_IDA1", "EirGridDemandFc_IDA2", "EirGridDemandFc_IDA3",
                 "EirGridWindFc_DAM", "EirGridWindFc_IDA1", "EirGridWindFc_IDA2", "EirGridWindFc_IDA3", "NIV_Actual", "TotalPN"]
_FUNDAMENTALS = ["EirGridDemandFc_DAM", "EirgridActualWind", "NIV_Actual", "ActualMeterData", "TotalPN"]
_DESC_COLS = _SUMMARY_COLS + SPR


@register("describe", with_ctes(panel_ctes() + [("lf", unpivot_sql("panel", [], _DESC_COLS, "column"))], final(
    "SELECT \"column\", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
    "max(value) AS max, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, "
    "quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, "
    "quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM lf GROUP BY 1",
    dbl=["mean", "std", "min", "max", "p01", "p05", "p25", "p50", "p75", "p95", "p99"], ints=["count"],
    rest=["column"])))
def q_describe(spark, d):
    return finalize(EX.describe(panel(spark, d), _DESC_COLS))


_CORR_SETS = {"summary": _SUMMARY_COLS, "updated": _PRICES + SPR + _FUNDAMENTALS + _ND}


def _corr_sql():
    parts = []
    for name, cols in _CORR_SETS.items():
        cells = ", ".join(f"corr({a}, {b}) AS \"{a}|{b}\"" for i, a in enumerate(cols) for b in cols[i + 1:])
        cells += ", " + ", ".join(f"CASE WHEN count({a}) > 1 THEN 1e0 END AS \"{a}|{a}\"" for a in cols)
        parts.append(f"SELECT '{name}' AS report, split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, r "
                     f"FROM (SELECT {cells} FROM panel) AS t UNPIVOT INCLUDE NULLS (r FOR pair IN (*))")
    one = " UNION ALL ".join(parts)
    return [("c1", one), ("c", "SELECT report, a AS x, b AS y, r FROM c1 UNION ALL SELECT report, b AS x, a AS y, r FROM c1 WHERE a <> b")]


@register("correlations", with_ctes(panel_ctes() + _corr_sql(), final(
    "SELECT * FROM c", dbl=["r"], rest=["report", "x", "y"])))
def q_correlations(spark, d):
    p = panel(spark, d)
    out = None
    for name, cols in _CORR_SETS.items():
        one = EX.correlations(p, cols).withColumn("report", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return finalize(out.select("report", "x", "y", "r"))


_HIST_COLS = ["PriceImbalance", "PriceIDA1", "PriceDAM"] + SPR


@register("histogram", with_ctes(panel_ctes() + [
    ("lf", unpivot_sql("panel", [], _HIST_COLS, "column")),
    ("rg", "SELECT \"column\", min(value) AS lo, max(value) AS hi FROM lf GROUP BY 1"),
    ("bb", "SELECT \"column\", CAST(CASE WHEN hi - lo > 0 THEN least(floor((value - lo) / (hi - lo) * 80e0), 79) "
           "ELSE 0 END AS BIGINT) AS bin, lo, hi FROM lf JOIN rg USING (\"column\")")], final(
    "SELECT \"column\", bin, lo + (hi - lo) * bin / 80e0 AS bin_lo, lo + (hi - lo) * (bin + 1) / 80e0 AS bin_hi, "
    "count(*) AS count FROM bb GROUP BY \"column\", bin, lo, hi",
    dbl=["bin_lo", "bin_hi"], ints=["bin", "count"], rest=["column"])))
def q_histogram(spark, d):
    return finalize(EX.histogram(panel(spark, d), _HIST_COLS, 80))


@register("monthly_stats", with_ctes(panel_ctes() + [
    ("lf", unpivot_sql("(SELECT *, strftime(ts, '%Y-%m') AS month_label FROM panel)", ["month_label"], SPR))], final(
    "SELECT month_label, spread, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n "
    "FROM lf GROUP BY 1, 2", dbl=["mean", "std"], ints=["n"], rest=["month_label", "spread"])))
def q_monthly_stats(spark, d):
    return finalize(EX.monthly_stats(panel(spark, d)))


@register("direction_balance", with_ctes(panel_ctes() + [
    ("lf", unpivot_sql("panel", [], ["dir_" + s for s in SPR], "column"))], final(
    "SELECT replace(\"column\", 'dir_', '') AS spread, avg(CAST(value < 0 AS DOUBLE)) AS neg_share, "
    "avg(CAST(value = 0 AS DOUBLE)) AS zero_share, avg(CAST(value > 0 AS DOUBLE)) AS pos_share, count(value) AS n "
    "FROM lf GROUP BY 1", dbl=["neg_share", "zero_share", "pos_share"], ints=["n"], rest=["spread"])))
def q_direction_balance(spark, d):
    return finalize(EX.direction_balance(panel(spark, d), on="dir"))


@register("spread_balance", with_ctes(panel_ctes() + [("lf", unpivot_sql("panel", [], SPR))], final(
    "SELECT spread, avg(CAST(value < 0 AS DOUBLE)) AS neg_share, avg(CAST(value = 0 AS DOUBLE)) AS zero_share, "
    "avg(CAST(value > 0 AS DOUBLE)) AS pos_share, count(value) AS n FROM lf GROUP BY 1",
    dbl=["neg_share", "zero_share", "pos_share"], ints=["n"], rest=["spread"])))
def q_spread_balance(spark, d):
    return finalize(EX.direction_balance(panel(spark, d), on="spread"))


def _bounds_ctes(keep=()):
    k = list(keep)
    return panel_ctes() + [
        ("lf", unpivot_sql("(SELECT *, strftime(ts, '%Y-%m') AS month_label FROM panel)", k, SPR)),
        ("bd", "SELECT spread, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM lf GROUP BY 1"),
        ("lb", "SELECT * FROM lf JOIN bd USING (spread)")]


@register("extremes", with_ctes(_bounds_ctes(), final(
    "SELECT spread, q01, q99, count(*) FILTER (WHERE value <= q01) AS n_extreme_low, "
    "count(*) FILTER (WHERE value >= q99) AS n_extreme_high, "
    "round_even(avg(CAST(value <= q01 OR value >= q99 AS DOUBLE)), 4) AS pct_extreme_total FROM lb GROUP BY 1, 2, 3",
    dbl=["q01", "q99", "pct_extreme_total"], ints=["n_extreme_low", "n_extreme_high"], rest=["spread"])))
def q_extremes(spark, d):
    return finalize(EX.extremes(panel(spark, d)))


@register("extremes_by_hod", with_ctes(_bounds_ctes(["hod"]), final(
    "SELECT spread, hod, count(*) AS n_events FROM lb WHERE value <= q01 OR value >= q99 GROUP BY 1, 2",
    dbl=["hod"], ints=["n_events"], rest=["spread"])))
def q_extremes_by_hod(spark, d):
    return finalize(EX.extremes_by(panel(spark, d), "hod", side="both"))


@register("extremes_by_month", with_ctes(_bounds_ctes(["month_label"]), final(
    "SELECT spread, month_label, count(*) AS n_events FROM lb WHERE value >= q99 GROUP BY 1, 2",
    ints=["n_events"], rest=["spread", "month_label"])))
def q_extremes_by_month(spark, d):
    p = panel(spark, d).withColumn("month_label", F.date_format("ts", "yyyy-MM"))
    return finalize(EX.extremes_by(p, "month_label", side="high"))


_QCUT = (("EirgridActualWind", ["spr_IDA1_DAM", "spr_BM_IDA1", "spr_BM_DAM"]),
         ("NetDemand_DAM", ["spr_IDA1_DAM", "spr_BM_DAM"]),
         ("NetDemand_IDA1", ["spr_BM_IDA1"]))


def _qcut_sql():
    parts = []
    for x, spreads in _QCUT:
        edges = f"list_sort(list_distinct(quantile_cont({x}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))"
        inner = f"(SELECT list_slice(e, 2, len(e) - 1) AS inner_e FROM (SELECT {edges} AS e FROM panel))"
        binned = (f"(SELECT *, len(list_filter(inner_e, lambda v: v < {x})) AS bin FROM panel, {inner} "
                  f"WHERE {x} IS NOT NULL)")
        for s in spreads:
            parts.append(f"SELECT '{x}' AS driver, bin, '{s}' AS spread, avg({s}) AS mean, count({s}) AS n "
                         f"FROM {binned} GROUP BY bin")
    return " UNION ALL ".join(parts)


@register("qcut_means", with_ctes(panel_ctes() + [("qm", _qcut_sql())], final(
    "SELECT * FROM qm", dbl=["mean"], ints=["bin", "n"], rest=["driver", "spread"])))
def q_qcut_means(spark, d):
    return finalize(EX.qcut_means(panel(spark, d), dict(_QCUT)))


#: fixed values: drivers and targets of the scatter plots
_FIT = tuple((x, y) for y, xs in (
    ("spr_IDA1_DAM", ("NetDemand_DAM", "EirGridDemandFc_DAM", "EirGridWindFc_DAM", "ISEMSOLAR_DAM", "GB DAM Epex", "GB DAM N2EX", "GB DAM HH Epex")),
    ("spr_BM_DAM", ("NetDemand_DAM", "EirGridDemandFc_DAM", "EirGridWindFc_DAM", "ISEMSOLAR_DAM", "GB DAM Epex", "GB DAM N2EX", "GB DAM HH Epex")),
    ("spr_BM_IDA1", ("NetDemand_IDA1", "EirGridDemandFc_IDA1", "EirGridWindFc_IDA1", "ISEMSOLAR_IDA1", "PredictedICFlow", "PumpStorage")),
) for x in xs)
_SAMPLE = 8000


def _fit_sql():
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, regr_slope({y}, {q(x)}) AS slope, regr_intercept({y}, {q(x)}) AS intercept, "
        f"regr_count({y}, {q(x)}) AS n FROM panel" for x, y in _FIT)


@register("line_fit", with_ctes(panel_ctes() + [("lfit", _fit_sql())], final(
    "SELECT * FROM lfit", dbl=["slope", "intercept"], ints=["n"], rest=["x", "y"])))
def q_line_fit(spark, d):
    return finalize(EX.line_fit(panel(spark, d), _FIT))


def _scatter_sql():
    """Rows by an arithmetic hash of the minute, as many as the plot shows."""
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{x}' AS x, '{y}' AS y, ts, {q(x)} AS x_value, {y} AS y_value FROM panel "
        f"WHERE {q(x)} IS NOT NULL AND {y} IS NOT NULL "
        f"ORDER BY ((epoch(ts)::BIGINT // 60) * 48271 + 42) % 2147483647, ts LIMIT {_SAMPLE})" for x, y in _FIT)


@register("scatter_sample", with_ctes(panel_ctes() + [("sc", _scatter_sql())], final(
    "SELECT * FROM sc", dbl=["x_value", "y_value"], rest=["x", "y", "ts"])))
def q_scatter_sample(spark, d):
    """A19 extracts: at most 8 000 pairwise-complete rows of every pair, chosen
    by a seeded hash (a sampling operator: the limit is the feature)."""
    p = panel(spark, d)
    out = None
    for x, y in _FIT:
        one = EX.scatter_sample(p, x, y, n=_SAMPLE, seed=42).select(
            F.lit(x).alias("x"), F.lit(y).alias("y"), "ts", F.col(f"`{x}`").alias("x_value"), F.col(y).alias("y_value"))
        out = one if out is None else out.unionByName(one)
    return finalize(out)


@register("price_summary", with_ctes(panel_ctes() + [("lf", unpivot_sql(
    "(SELECT PriceDAM AS DAM, PriceIDA1 AS IDA1, PriceIDA2 AS IDA2, PriceIDA3 AS IDA3, PriceImbalance AS BM FROM panel)",
    [], ["DAM", "IDA1", "IDA2", "IDA3", "BM"], "market"))], final(
    "SELECT market, avg(value) AS mean_eur_mwh, stddev_samp(value) AS std_eur_mwh, "
    "quantile_cont(value, 0.5) AS median_eur_mwh, min(value) AS min_eur_mwh, max(value) AS max_eur_mwh, "
    "count(value) AS observations FROM lf GROUP BY 1",
    dbl=["mean_eur_mwh", "std_eur_mwh", "median_eur_mwh", "min_eur_mwh", "max_eur_mwh"], ints=["observations"],
    rest=["market"])))
def q_price_summary(spark, d):
    return finalize(EX.price_summary(panel(spark, d)))


@register("spread_summary", with_ctes(_bounds_ctes(), final(
    "SELECT spread, avg(value) AS mean, stddev_samp(value) AS std, avg(abs(value)) AS mean_abs, q01, q99 "
    "FROM lb GROUP BY spread, q01, q99", dbl=["mean", "std", "mean_abs", "q01", "q99"], rest=["spread"])))
def q_spread_summary(spark, d):
    return finalize(EX.spread_summary(panel(spark, d)).drop("n"))


# --------------------------------------------------------------------------- features
from spreadforge.config import GB_PRICES, HORIZONS, LAG_BASES, LAG_FEATURES, REVISIONS, WIND_PROVIDERS  # noqa: E402
from spreadforge.operators import features as FE  # noqa: E402
from spreadforge.operators.ordered import halo_windows, lag_expr, row_index, shifted_rolling  # noqa: E402
from spreadforge.sources.fixtures import supplier_daily  # noqa: E402


def features(spark, d):
    """Engineered feature table (checkpointed, as the job does)."""
    from spreadforge.session import materialize
    return materialize(FE.engineer_features(panel(spark, d)))


def _ens_sql():
    out = []
    for s in HORIZONS:
        cs = [p.format(s=s) for p in WIND_PROVIDERS]
        n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cs)
        tot = " + ".join(f"coalesce({c}, 0e0)" for c in cs)
        m = f"(CASE WHEN ({n}) > 0 THEN ({tot}) / ({n}) END)"
        ss = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN ({c} - {m}) * ({c} - {m}) ELSE 0e0 END" for c in cs)
        out += [f"{m} AS wind_consensus_{s}",
                f"CASE WHEN ({n}) >= 2 THEN sqrt(({ss}) / (({n}) - 1)) END AS wind_uncertainty_{s}",
                f"greatest({', '.join(cs)}) - least({', '.join(cs)}) AS wind_range_{s}",
                f"EirGridWindFc_{s} - {m} AS wind_eirg_dev_{s}"]
    return out


_ENS = [f"{k}_{s}" for s in HORIZONS for k in ("wind_consensus", "wind_uncertainty", "wind_range", "wind_eirg_dev")]


@register("ensemble_stats", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(_ens_sql())} FROM panel", dbl=_ENS, rest=["ts"])))
def q_ensemble_stats(spark, d):
    return finalize(FE.ensemble_features(panel(spark, d)).select("ts", *_ENS))


_REV = [f"demand_disagreement_{s}" for s in HORIZONS] + [n for n, _, _ in REVISIONS]


@register("revisions", with_ctes(panel_ctes(), final(
    "SELECT ts, " + ", ".join([f"Meteo_ISEMDEMAND_{s} - EirGridDemandFc_{s} AS demand_disagreement_{s}" for s in HORIZONS]
                              + list(REVISION_SQL)) + " FROM panel",
    dbl=_REV, rest=["ts"])))
def q_revisions(spark, d):
    return finalize(FE.disagreement_and_revisions(panel(spark, d)).select("ts", *_REV))


_REN = [f"ren_pct_{s}" for s in HORIZONS] + [f"GB_vs_IRL_{g.replace(' ', '_')}" for g in GB_PRICES]


@register("renewables_cross_border", with_ctes(panel_ctes(), final(
    "SELECT ts, " + ", ".join(
        [f"(EirGridWindFc_{s} + ISEMSOLAR_{s}) / (EirGridDemandFc_{s} + 1e0) AS ren_pct_{s}" for s in HORIZONS]
        + [f"{q(g)} - PriceDAM AS GB_vs_IRL_{g.replace(' ', '_')}" for g in GB_PRICES]) + " FROM panel",
    dbl=_REN, rest=["ts"])))
def q_renewables_cross_border(spark, d):
    return finalize(FE.renewables_cross_border(panel(spark, d)).select("ts", *_REN))


def _lag_sql(kinds):
    out = []
    for b in LAG_BASES:
        for sfx, shift, kind, rows, minp in LAG_FEATURES:
            if kind not in kinds:
                continue
            if kind == "lag":
                out.append(f"lag({b}, {shift}) OVER w AS {b}{sfx}")
            else:
                fr = f"(ORDER BY ts ROWS BETWEEN {shift + rows - 1} PRECEDING AND {shift} PRECEDING)"
                fn = "avg" if kind == "mean" else "stddev_samp"
                out.append(f"CASE WHEN count({b}) OVER {fr} >= {minp} THEN {fn}({b}) OVER {fr} END AS {b}{sfx}")
    return out


def _lag_names(kinds):
    return [f"{b}{sfx}" for b in LAG_BASES for sfx, _, kind, _, _ in LAG_FEATURES if kind in kinds]


@register("lags", with_ctes(panel_ctes(), final(
    f"SELECT ts, row_number() OVER w - 1 AS idx, {', '.join(_lag_sql(['lag']))} FROM panel WINDOW w AS (ORDER BY ts)",
    dbl=_lag_names(["lag"]), ints=["idx"], rest=["ts"])))
def q_lags(spark, d):
    return finalize(features(spark, d).select("ts", "idx", *_lag_names(["lag"])))


@register("rolling_mean", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(_lag_sql(['mean']))} FROM panel", dbl=_lag_names(["mean"]), rest=["ts"])))
def q_rolling_mean(spark, d):
    return finalize(features(spark, d).select("ts", *_lag_names(["mean"])))


@register("rolling_std", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(_lag_sql(['std']))} FROM panel", dbl=_lag_names(["std"]), rest=["ts"])))
def q_rolling_std(spark, d):
    return finalize(features(spark, d).select("ts", *_lag_names(["std"])))


_SUP = ("SELECT l_suppkey, l_shipdate, sum(l_quantity) AS qty, "
        "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n_lines "
        "FROM lineitem GROUP BY 1, 2")


@register("row_index", with_ctes([("sd", _SUP)], final(
    "SELECT l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) - 1 AS idx FROM sd",
    ints=["l_suppkey", "idx"], rest=["l_shipdate"])))
def q_row_index(spark, d):
    return finalize(row_index(supplier_daily(spark, d), "l_shipdate", by="l_suppkey").select("l_suppkey", "l_shipdate", "idx"))


def _series_windows():
    return {"qty_lag1": lag_expr("qty", 1),
            "qty_ma7": shifted_rolling("qty", 1, 7, 3, "mean"),
            "qty_std7": shifted_rolling("qty", 1, 7, 3, "std"),
            "revenue_ma28": shifted_rolling("revenue", 1, 28, 7, "mean")}


def rolling_by_series_df(spark, d, chunk: int = 20_000):
    sd = row_index(supplier_daily(spark, d), "l_shipdate", by="l_suppkey")
    return halo_windows(sd, "idx", _series_windows(), reach=28, by="l_suppkey", chunk=chunk)


@register("rolling_by_series", with_ctes([("sd", _SUP)], final(
    "SELECT l_suppkey, l_shipdate, qty, lag(qty, 1) OVER w AS qty_lag1, "
    "CASE WHEN count(qty) OVER w7 >= 3 THEN avg(qty) OVER w7 END AS qty_ma7, "
    "CASE WHEN count(qty) OVER w7 >= 3 THEN stddev_samp(qty) OVER w7 END AS qty_std7, "
    "CASE WHEN count(revenue) OVER w28 >= 7 THEN avg(revenue) OVER w28 END AS revenue_ma28 FROM sd "
    "WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate), "
    "w7 AS (PARTITION BY l_suppkey ORDER BY l_shipdate ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), "
    "w28 AS (PARTITION BY l_suppkey ORDER BY l_shipdate ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)",
    dbl=["qty", "qty_lag1", "qty_ma7", "qty_std7", "revenue_ma28"], ints=["l_suppkey"], rest=["l_shipdate"],
    digits=4)))
def q_rolling_by_series(spark, d):
    return finalize(rolling_by_series_df(spark, d).select(
        "l_suppkey", "l_shipdate", "qty", "qty_lag1", "qty_ma7", "qty_std7", "revenue_ma28"), 4)


# --------------------------------------------------------------------------- data sets
from spreadforge.config import LAG_BURNIN, TRANSITIONS, TIME_FEATURES, ALWAYS_EXCLUDE, TARGET_PREFIXES  # noqa: E402
from spreadforge.operators import dataset as DS  # noqa: E402


def indexed_panel(spark, d):
    return row_index(panel(spark, d), "ts")


def long_ds(spark, d):
    return DS.long_dataset(indexed_panel(spark, d))


def _ds_sql():
    parts = []
    for t in TRANSITIONS:
        w = f" AND ({t.window})" if t.window else ""
        parts.append(f"SELECT '{t.name}' AS transition, idx, ts, CAST(sign({t.spread}) AS INTEGER) AS y_dir, "
                     f"{t.spread} AS y_mag FROM ip WHERE idx >= {LAG_BURNIN} AND {t.spread} IS NOT NULL "
                     f"AND sign({t.spread}) <> 0{w}")
    return [("ip", "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx FROM panel"),
            ("ds", " UNION ALL ".join(parts)),
            ("dsp", "SELECT *, row_number() OVER (PARTITION BY transition ORDER BY idx) - 1 AS rn0, "
                    "count(*) OVER (PARTITION BY transition) AS n FROM ds"),
            ("split", "SELECT *, CASE WHEN rn0 < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM dsp")]


@register("transition_guard", with_ctes(panel_ctes(), final(
    " UNION ALL ".join(f"SELECT '{t.name}' AS transition, '{t.spread}' AS spread, count({t.spread}) AS n_non_missing, "
                       f"count({t.spread}) >= 500 AS usable FROM panel" for t in TRANSITIONS),
    ints=["n_non_missing"], rest=["transition", "spread", "usable"])))
def q_transition_guard(spark, d):
    return finalize(DS.transition_guard(panel(spark, d)))


@register("usable_targets", with_ctes(panel_ctes() + _ds_sql(), final(
    "SELECT transition, count(*) AS n_rows, min(idx) AS idx_min, sum(CAST(y_dir = 1 AS INTEGER)) AS n_up, "
    "sum(y_mag) AS y_sum FROM ds GROUP BY 1", dbl=["y_sum"], ints=["n_rows", "idx_min", "n_up"], rest=["transition"],
    digits=4)))
def q_usable_targets(spark, d):
    return finalize(long_ds(spark, d).groupBy("transition").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("idx").alias("idx_min"),
        F.sum((F.col("y_dir") == 1).cast("int")).alias("n_up"), F.sum("y_mag").alias("y_sum")), 4)


@register("long_dataset", with_ctes(panel_ctes() + _ds_sql(), final(
    "SELECT * FROM ds", dbl=["y_mag"], ints=["idx", "y_dir"], rest=["transition", "ts"])))
def q_long_dataset(spark, d):
    return finalize(long_ds(spark, d))


@register("temporal_split", with_ctes(panel_ctes() + _ds_sql(), final(
    "SELECT transition, idx, ts, y_dir, rn0, n, split FROM split", ints=["idx", "y_dir", "rn0", "n"],
    rest=["transition", "ts", "split"])))
def q_temporal_split(spark, d):
    return finalize(DS.temporal_split(long_ds(spark, d)).select("transition", "idx", "ts", "y_dir", "rn0", "n", "split"))


def _folds_sql():
    parts = []
    for k in range(5):
        start = f"(n - {5 - k} * (n // 6))"
        parts.append(f"SELECT transition, {k} AS fold, CASE WHEN rn0 < {start} THEN 'train' WHEN rn0 < {start} + n // 6 "
                     f"THEN 'test' END AS role, idx FROM dsp")
    return " UNION ALL ".join(parts)


@register("walk_forward_folds", with_ctes(panel_ctes() + _ds_sql() + [("fo", _folds_sql())], final(
    "SELECT transition, fold, role, count(*) AS rows, min(idx) AS idx_min, max(idx) AS idx_max FROM fo "
    "WHERE role IS NOT NULL GROUP BY 1, 2, 3", ints=["fold", "rows", "idx_min", "idx_max"],
    rest=["transition", "role"])))
def q_walk_forward_folds(spark, d):
    return finalize(DS.fold_summary(DS.walk_forward_roles(long_ds(spark, d))))


@register("class_balance", with_ctes(panel_ctes() + _ds_sql(), final(
    "SELECT transition, count(*) FILTER (WHERE y_dir = 1) AS n_up, count(*) FILTER (WHERE y_dir = -1) AS n_down, "
    "avg(CAST(y_dir = 1 AS DOUBLE)) AS up_share FROM split WHERE split = 'train' GROUP BY 1",
    dbl=["up_share"], ints=["n_up", "n_down"], rest=["transition"])))
def q_class_balance(spark, d):
    return finalize(DS.class_balance(DS.temporal_split(long_ds(spark, d))))


def feature_panel_columns() -> list[str]:
    """Column names of the engineered feature table (static mirror, checked by
    the ``feature_names`` query against the live schema)."""
    base = (["ts"] + ["TradeDate", "StartDateTime"] + [c for c in _RAW_NUM if c != "PredictedICFlow"]
            + ["hour", "minute", "hod", "PredictedICFlow"] + SPR + ["dir_" + s for s in SPR] + _ND
            + _CAL + _CYC + _ENS + _REV + ["idx"] + _lag_names(["lag", "mean", "std"]) + _REN)
    return base


def _feature_sql():
    names = ", ".join("('" + c.replace("'", "''") + "')" for c in feature_panel_columns())
    parts = []
    for t in TRANSITIONS:
        toks = ", ".join("'" + x.upper() + "'" for x in t.tokens)
        always = ", ".join("'" + x + "'" for x in t.always)
        tf = ", ".join("'" + x + "'" for x in TIME_FEATURES)
        excl = ", ".join("'" + x + "'" for x in ALWAYS_EXCLUDE + ("idx",))
        pref = " AND ".join(f"NOT starts_with(c, '{p}')" for p in TARGET_PREFIXES)
        parts.append(
            f"SELECT '{t.name}' AS transition, c AS feature FROM cols WHERE c NOT IN ({excl}) AND {pref} AND "
            f"(c IN ({tf}) OR c IN ({always}) OR len(list_filter([{toks}], lambda k: contains(upper(c), k))) > 0)")
    return [("cols", f"SELECT * FROM (VALUES {names}) v(c)"), ("fx", " UNION ALL ".join(parts))]


def _nonmissing_sql():
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, count({q(c)}) AS non_missing FROM fp"
                              for c in feature_panel_columns())





# --------------------------------------------------------------------------- metrics (on scored rows)
from spreadforge.operators import metrics as MT  # noqa: E402


def scored_eval(spark, d):
    """Scored rows with true / predicted direction and magnitude."""
    return scored_rows(spark, d).withColumns({
        "y": F.signum("spread").cast("int"),
        "pred": F.when(F.col("p_up") > 0.5, F.lit(1)).otherwise(F.lit(-1)),
        "y_mag": F.col("spread")})


def _eval_sql():
    return scored_sql() + [("ev", "SELECT *, CAST(sign(spread) AS INTEGER) AS y, "
                                  "CASE WHEN p_up > 0.5e0 THEN 1 ELSE -1 END AS pred, spread AS y_mag FROM scored")]


_AUC_SQL = [("sg", "SELECT transition, p_up AS score, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, "
                   "CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS neg FROM ev GROUP BY 1, 2"),
            ("sc", "SELECT *, sum(neg) OVER (PARTITION BY transition ORDER BY score ROWS UNBOUNDED PRECEDING) - neg "
                   "AS neg_below FROM sg"),
            ("auc", "SELECT transition, sum(pos * (neg_below + neg / 2e0)) / NULLIF(sum(pos) * sum(neg), 0) AS roc_auc "
                    "FROM sc GROUP BY 1"),
            ("acc", "SELECT transition, avg(CAST(pred = y AS DOUBLE)) AS accuracy, count(*) AS n FROM ev GROUP BY 1")]


@register("accuracy_auc", with_ctes(_eval_sql() + _AUC_SQL, final(
    "SELECT transition, accuracy, n, roc_auc FROM acc JOIN auc USING (transition)",
    dbl=["accuracy", "roc_auc"], ints=["n"], rest=["transition"])))
def q_accuracy_auc(spark, d):
    s = scored_eval(spark, d)
    return finalize(MT.accuracy(s).join(MT.roc_auc(s), "transition"))


_REG_SQL = ("SELECT transition, avg(abs(pred_mag - y_mag)) AS reg_mae, "
            "1 - sum((pred_mag - y_mag) * (pred_mag - y_mag)) / NULLIF(var_pop(y_mag) * count(y_mag), 0) AS reg_r2 "
            "FROM ev GROUP BY 1")


@register("regression_metrics", with_ctes(_eval_sql(), final(_REG_SQL, dbl=["reg_mae", "reg_r2"], rest=["transition"])))
def q_regression_metrics(spark, d):
    return finalize(MT.regression_metrics(scored_eval(spark, d)))


_CNT_SQL = ("cm", "SELECT transition, count(*) FILTER (WHERE y = -1 AND pred = -1) AS nn, "
                  "count(*) FILTER (WHERE y = -1 AND pred = 1) AS np, count(*) FILTER (WHERE y = 1 AND pred = -1) AS pn, "
                  "count(*) FILTER (WHERE y = 1 AND pred = 1) AS pp FROM ev GROUP BY 1")


def _report_sql():
    z = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0e0)"
    f1 = lambda p, r: f"coalesce(2 * ({p}) * ({r}) / NULLIF(({p}) + ({r}), 0), 0e0)"
    pn_, rn_ = z("nn", "nn + pn"), z("nn", "nn + np")
    pp_, rp_ = z("pp", "pp + np"), z("pp", "pp + pn")
    w = lambda a, b: f"coalesce((({a}) * (nn + np) + ({b}) * (pn + pp)) / NULLIF(nn + np + pn + pp, 0), 0e0)"
    rows = [("-1", pn_, rn_, f1(pn_, rn_), "nn + np"), ("1", pp_, rp_, f1(pp_, rp_), "pn + pp"),
            ("accuracy", "NULL", "NULL", z("nn + pp", "nn + np + pn + pp"), "nn + np + pn + pp"),
            ("macro avg", f"({pn_} + {pp_}) / 2", f"({rn_} + {rp_}) / 2", f"({f1(pn_, rn_)} + {f1(pp_, rp_)}) / 2",
             "nn + np + pn + pp"),
            ("weighted avg", w(pn_, pp_), w(rn_, rp_), w(f1(pn_, rn_), f1(pp_, rp_)), "nn + np + pn + pp")]
    return " UNION ALL ".join(
        f"SELECT transition, '{lbl}' AS label, round_even(CAST({p} AS DOUBLE), 4) AS precision, "
        f"round_even(CAST({r} AS DOUBLE), 4) AS recall, round_even({f}, 4) AS f1, {s} AS support FROM cm"
        for lbl, p, r, f, s in rows)


@register("class_report", with_ctes(_eval_sql() + [_CNT_SQL], final(
    _report_sql(), dbl=["precision", "recall", "f1"], ints=["support"], rest=["transition", "label"])))
def q_class_report(spark, d):
    return finalize(MT.class_report(scored_eval(spark, d)))


@register("confusion", with_ctes(_eval_sql() + [_CNT_SQL], final(
    " UNION ALL ".join(
        f"SELECT transition, {a} AS actual, {b} AS predicted, {k} AS count, "
        f"CAST({k} AS DOUBLE) / NULLIF(nn + np + pn + pp, 0) AS total_share, CAST({k} AS DOUBLE) / NULLIF({r}, 0) AS row_share FROM cm"
        for a, b, k, r in ((-1, -1, "nn", "nn + np"), (-1, 1, "np", "nn + np"), (1, -1, "pn", "pn + pp"),
                           (1, 1, "pp", "pn + pp"))),
    dbl=["total_share", "row_share"], ints=["actual", "predicted", "count"], rest=["transition"])))
def q_confusion(spark, d):
    return finalize(MT.confusion(scored_eval(spark, d)))


@register("best_confusion", with_ctes(_eval_sql() + [_CNT_SQL] + _AUC_SQL[3:], final(
    " UNION ALL ".join(
        f"SELECT transition, {a} AS actual, {b} AS predicted, {k} AS count, "
        f"CAST({k} AS DOUBLE) / NULLIF(nn + np + pn + pp, 0) AS total_share, CAST({k} AS DOUBLE) / NULLIF({r}, 0) AS row_share "
        f"FROM cm WHERE transition = (SELECT transition FROM acc ORDER BY accuracy DESC, transition DESC LIMIT 1)"
        for a, b, k, r in ((-1, -1, "nn", "nn + np"), (-1, 1, "np", "nn + np"), (1, -1, "pn", "pn + pp"),
                           (1, 1, "pp", "pn + pp"))),
    dbl=["total_share", "row_share"], ints=["actual", "predicted", "count"], rest=["transition"])))
def q_best_confusion(spark, d):
    return finalize(MT.best_accuracy_confusion(scored_eval(spark, d)))


# --------------------------------------------------------------------------- backtest rows & series
@register("signals", with_ctes(_sized_sql(), final(
    "SELECT transition, ts, spread, p_up, conf, CASE WHEN conf <= 0.2e0 THEN 0 ELSE dir END AS signal FROM sized",
    dbl=["spread", "p_up", "conf"], ints=["signal"], rest=["transition", "ts"])))
def q_signals(spark, d):
    s = scored_rows(spark, d)
    return finalize(s.select("transition", "ts", "spread", "p_up", BT.confidence(F.col("p_up")).alias("conf"),
                             BT.signal(F.col("p_up"), 0.2).alias("signal")))


@register("sizing", with_ctes(_sized_sql(), final(
    "SELECT transition, ts, pred_mag, size_base, volume FROM sized JOIN size_base USING (transition)",
    dbl=["pred_mag", "size_base", "volume"], rest=["transition", "ts"])))
def q_sizing(spark, d):
    return finalize(BT.add_sizing(scored_rows(spark, d), _CFG).select("transition", "ts", "pred_mag", "size_base", "volume"))


_ROWPNL = ("rp", "SELECT transition, ts, spread, CASE WHEN conf <= 0.2e0 THEN 0 ELSE dir END AS signal, "
                 "CASE WHEN conf <= 0.2e0 THEN 0e0 ELSE pnl END AS pnl FROM sized_pnl")


@register("row_pnl", with_ctes(_sized_sql() + [_ROWPNL], final(
    "SELECT * FROM rp", dbl=["spread", "pnl"], ints=["signal"], rest=["transition", "ts"])))
def q_row_pnl(spark, d):
    r = BT.row_pnl(BT.add_sizing(scored_rows(spark, d), _CFG), 0.2)
    return finalize(r.select("transition", "ts", "spread", "signal", "pnl"))


_SERIES = [("ps", "SELECT transition, ts, sum(CAST(round_even(pnl * 1e6, 0) / 1e6 AS DECIMAL(38, 6))) AS pnl "
                  "FROM rp GROUP BY 1, 2"),
           ("pc", "SELECT *, sum(pnl) OVER w AS cum_pnl FROM ps WINDOW w AS (PARTITION BY transition ORDER BY ts "
                  "ROWS UNBOUNDED PRECEDING)"),
           ("pm", "SELECT *, max(cum_pnl) OVER (PARTITION BY transition ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum_max "
                  "FROM pc"),
           ("pd", "SELECT transition, ts, CAST(pnl AS DOUBLE) AS pnl, CAST(cum_pnl AS DOUBLE) AS cum_pnl, "
                  "CAST(cum_max AS DOUBLE) AS cum_max, CAST(cum_pnl - cum_max AS DOUBLE) AS drawdown FROM pm")]


@register("pnl_series", with_ctes(_sized_sql() + [_ROWPNL] + _SERIES, final(
    "SELECT * FROM pd", dbl=["pnl", "cum_pnl", "cum_max", "drawdown"], rest=["transition", "ts"], digits=3)))
def q_pnl_series(spark, d):
    return finalize(BT.pnl_series(scored_rows(spark, d), _CFG), 3)


@register("max_drawdown", with_ctes(_sized_sql() + [_ROWPNL] + _SERIES, final(
    "SELECT transition, min(drawdown) AS max_drawdown, arg_max(cum_pnl, ts) AS final_pnl FROM pd GROUP BY 1",
    dbl=["max_drawdown", "final_pnl"], rest=["transition"], digits=3)))
def q_max_drawdown(spark, d):
    return finalize(BT.max_drawdown(BT.pnl_series(scored_rows(spark, d), _CFG)), 3)


@register("threshold_sensitivity", with_ctes(_sized_sql() + [("trading", _trading_sql())], final(
    "SELECT transition, conf_thresh, eur_per_mwh, n_trades FROM trading", dbl=["conf_thresh", "eur_per_mwh"],
    ints=["n_trades"], rest=["transition"])))
def q_threshold_sensitivity(spark, d):
    return finalize(BT.threshold_sensitivity(BT.trading_table(scored_rows(spark, d), _CFG)))


@register("pct_traded", with_ctes(_sized_sql() + [("trading", _trading_sql())], final(
    "SELECT transition, conf_thresh, n_trades, test_size, pct_traded FROM trading",
    dbl=["conf_thresh", "pct_traded"], ints=["n_trades", "test_size"], rest=["transition"])))
def q_pct_traded(spark, d):
    return finalize(BT.trading_table(scored_rows(spark, d), _CFG).select(
        "transition", "conf_thresh", "n_trades", "test_size", "pct_traded"))


_BOARD = [("trading", _trading_sql()),
          ("rk", "SELECT transition, y, pred, row_number() OVER (PARTITION BY transition ORDER BY ts, spread, p_up, pred_mag) - 1 AS rn, "
                 "count(*) OVER (PARTITION BY transition) AS n FROM ev"),
          ("fa", "SELECT transition, (rn - (n - 5 * (n // 6))) // (n // 6) AS fold, avg(CAST(pred = y AS DOUBLE)) AS accuracy "
                 "FROM rk WHERE rn >= n - 5 * (n // 6) GROUP BY 1, 2"),
          ("cv", "SELECT transition, avg(accuracy) AS cv_accuracy, stddev_pop(accuracy) AS cv_std FROM fa GROUP BY 1"),
          ("best", "SELECT * EXCLUDE (rk, test_size, pct_traded) FROM (SELECT *, row_number() OVER (PARTITION BY transition "
                   "ORDER BY eur_per_mwh DESC NULLS LAST, conf_thresh) AS rk FROM trading) WHERE rk = 1"),
          ("met", "SELECT transition, round_even(accuracy, 4) AS test_accuracy, round_even(roc_auc, 4) AS roc_auc, "
                  "round_even(cv_accuracy, 4) AS cv_accuracy, round_even(cv_std, 4) AS cv_std, round_even(reg_r2, 4) AS reg_r2, "
                  "round_even(reg_mae, 4) AS reg_mae FROM acc JOIN auc USING (transition) JOIN (" + _REG_SQL
                  + ") USING (transition) JOIN cv USING (transition)"),
          ("board", "SELECT * FROM best JOIN met USING (transition)")]
_BOARD_DBL = ["conf_thresh", "hit_rate", "eur_per_mwh", "total_pnl_eur", "sharpe_proxy", "test_accuracy", "roc_auc",
              "cv_accuracy", "cv_std", "reg_r2", "reg_mae"]


def leaderboard_df(spark, d):
    from spreadforge.session import materialize
    s = materialize(scored_eval(spark, d))       # read by the trading table, the metrics and the folds
    cv = MT.cv_summary(MT.fold_accuracy(s, order=("ts", "spread", "p_up", "pred_mag")))
    return BT.leaderboard(BT.trading_table(s, _CFG), MT.model_metrics(s, cv))


@register("leaderboard", with_ctes(_sized_sql() + _eval_sql() + _AUC_SQL + _BOARD, final(
    "SELECT * FROM board", dbl=_BOARD_DBL, ints=["n_trades"], rest=["transition"])))
def q_leaderboard(spark, d):
    return finalize(leaderboard_df(spark, d))


@register("top_rows", with_ctes(_sized_sql() + _eval_sql() + _AUC_SQL + _BOARD, final(
    "SELECT 'best_profit' AS kind, * FROM (SELECT * FROM board ORDER BY total_pnl_eur DESC, transition DESC LIMIT 1) "
    "UNION ALL SELECT 'best_accuracy' AS kind, * FROM (SELECT * FROM board ORDER BY test_accuracy DESC, transition DESC "
    "LIMIT 1)", dbl=_BOARD_DBL, ints=["n_trades"], rest=["kind", "transition"])))
def q_top_rows(spark, d):
    return finalize(BT.top_rows(leaderboard_df(spark, d)))


# --------------------------------------------------------------------------- models, job, IO
from spreadforge.config import ModelConfig, TRANSITION_BY_NAME  # noqa: E402
from spreadforge.operators import models as MD  # noqa: E402
from spreadforge.session import scratch_dir  # noqa: E402

QUERY_MODEL = ModelConfig()


def _feature_ctes():
    cal = ["isodow(ts) - 1 AS dow", "month(ts) AS month", "CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend",
           "CAST(month(ts) IN (11, 12, 1, 2, 3) AS INTEGER) AS is_winter",
           "CAST(hod BETWEEN 7 AND 21 AS INTEGER) AS is_peak",
           "sin(2 * pi() * hod / 24e0) AS hour_sin", "cos(2 * pi() * hod / 24e0) AS hour_cos",
           "sin(2 * pi() * (isodow(ts) - 1) / 7e0) AS dow_sin", "cos(2 * pi() * (isodow(ts) - 1) / 7e0) AS dow_cos",
           "sin(2 * pi() * month(ts) / 12e0) AS month_sin", "cos(2 * pi() * month(ts) / 12e0) AS month_cos"]
    rev = ([f"Meteo_ISEMDEMAND_{s} - EirGridDemandFc_{s} AS demand_disagreement_{s}" for s in HORIZONS]
           + list(REVISION_SQL))
    ren = ([f"(EirGridWindFc_{s} + ISEMSOLAR_{s}) / (EirGridDemandFc_{s} + 1e0) AS ren_pct_{s}" for s in HORIZONS]
           + [f"{q(g)} - PriceDAM AS GB_vs_IRL_{g.replace(' ', '_')}" for g in GB_PRICES])
    body = ", ".join(cal + _ens_sql() + rev + ["row_number() OVER w - 1 AS idx"] + _lag_sql(["lag", "mean", "std"]) + ren)
    return panel_ctes() + [("fp", f"SELECT *, {body} FROM panel WINDOW w AS (ORDER BY ts)")]


def _impute_cols():
    from spreadforge.functions.selection import build_xcols
    t = TRANSITION_BY_NAME["DAM→IDA1"]
    return build_xcols(feature_panel_columns(), t.tokens, t.always)


def _impute_sql():
    t = TRANSITION_BY_NAME["DAM→IDA1"]
    cols = _impute_cols()
    ds = (f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS rn0, count(*) OVER () AS n FROM fp "
          f"WHERE idx >= {LAG_BURNIN} AND {t.spread} IS NOT NULL AND sign({t.spread}) <> 0) "
          "WHERE rn0 < floor(n * 0.8e0)")
    lf = (f"SELECT feature, value FROM (SELECT {', '.join(f'CAST({q(c)} AS DOUBLE) AS {q(c)}' for c in cols)} "
          f"FROM tr) AS t UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(q(c) for c in cols)}))")
    return [("tr", ds), ("lfi", lf),
            ("md", "SELECT feature, quantile_cont(value, 0.5) AS median FROM lfi GROUP BY 1"),
            ("im", "SELECT feature, median, coalesce(value, median) AS v FROM lfi JOIN md USING (feature) "
                   "WHERE median IS NOT NULL")]


@register("impute_scale", with_ctes(_feature_ctes() + _impute_sql(), final(
    "SELECT feature, median, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS n FROM im GROUP BY 1, 2",
    dbl=["median", "mean", "std"], ints=["n"], rest=["feature"], digits=4)))
def q_impute_scale(spark, d):
    from spreadforge.operators.explore import long_form
    t = TRANSITION_BY_NAME["DAM→IDA1"]
    wide = features(spark, d)
    ds = wide.where(DS.usable_target(t.spread, t.window)).withColumn("transition", F.lit(t.name))
    tr = DS.temporal_split(ds).where("split = 'train'")
    cols = _impute_cols()
    meds = MD.column_medians(tr, cols)
    lf = long_form(MD.impute(tr, meds).select(*[F.col(f"`{c}`") for c in meds]), list(meds), name="feature")
    stats = lf.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                      F.count(F.lit(1)).alias("n"))
    med_df = spark.createDataFrame(list(meds.items()), "feature string, median double")
    return finalize(stats.join(F.broadcast(med_df), "feature"), 4)


def _wide_ckpt(spark, d):
    return features(spark, d)


#: oracle of the model queries: what any fitted model must return
_GUARD = [("guard", " UNION ALL ".join(f"SELECT '{t.name}' AS transition, count({t.spread}) >= 500 AS usable FROM panel" for t in TRANSITIONS)),
          ("live", "SELECT * FROM split WHERE transition IN (SELECT transition FROM guard WHERE usable)")]


@register("fit_score", with_ctes(panel_ctes() + _ds_sql() + _GUARD, final(
    "SELECT transition, idx, ts, y_mag AS spread, TRUE AS p_ok, TRUE AS pred_ok, TRUE AS mag_ok, TRUE AS learned "
    "FROM live WHERE split = 'test'",
    dbl=["spread"], ints=["idx"], rest=["transition", "ts", "p_ok", "pred_ok", "mag_ok", "learned"])))
def q_fit_score(spark, d):
    """Every test row scored: a probability, the class it implies, a magnitude;
    ``learned``: both training losses are below nine tenths of those of constants."""
    fits = MD.run_models(_wide_ckpt(spark, d), QUERY_MODEL)
    p = F.col("p_up")
    good = [f.spec.name for f in fits if f.losses["log_loss"] < 0.9 * f.losses["log_loss_of_share"]
            and f.losses["squared"] < 0.9 * f.losses["squared_of_mean"]]
    return finalize(MD.scored_union(fits).select(
        "transition", "idx", "ts", "spread", ((p >= 0) & (p <= 1)).alias("p_ok"),
        ((p == 0.5) | ((p > 0.5) == (F.col("pred") == 1))).alias("pred_ok"), (F.abs("pred_mag") < 1e9).alias("mag_ok"),
        F.col("transition").isin(good).alias("learned")))


@register("walk_forward_cv", with_ctes(panel_ctes() + _ds_sql() + _GUARD + [("fo", " UNION ALL ".join(
    f"SELECT transition, {k} AS fold, count(*) AS n_test FROM live WHERE rn0 >= n - {5 - k} * (n // 6) "
    f"AND rn0 < n - {4 - k} * (n // 6) GROUP BY 1" for k in range(5)))], final(
        "SELECT transition, fold, n_test, TRUE AS acc_ok, TRUE AS summary_ok FROM fo", ints=["fold", "n_test"],
        rest=["transition", "acc_ok", "summary_ok"])))
def q_walk_forward_cv(spark, d):
    """All folds of all usable transitions, with their summary."""
    wide = _wide_ckpt(spark, d)
    folds = MD.walk_forward_all(wide, MD.usable_transitions(wide), QUERY_MODEL)
    both = folds.join(MT.cv_summary(folds), "transition")
    return finalize(both.select("transition", "fold", "n_test", ((F.col("accuracy") >= 0) & (F.col("accuracy") <= 1)).alias("acc_ok"),
                                (F.abs(F.col("accuracy") - F.col("cv_accuracy")) <= 5 * F.col("cv_std") + 1e-9).alias("summary_ok")))


@register("importances", with_ctes(panel_ctes() + _GUARD[:1], final(
    "SELECT transition, unnest(range(1, 16)) AS rank, TRUE AS listed, TRUE AS share_ok FROM guard WHERE usable AND transition IN "
    "('DAM→IDA1', 'IDA1→BM', 'IDA1→IDA2', 'IDA2→IDA3')", ints=["rank"], rest=["transition", "listed", "share_ok"])))
def q_importances(spark, d):
    """Top 15 of the first four transitions: selected features, shares that
    fall with the rank and add up to at most 1."""
    from pyspark.sql import Window
    wide = _wide_ckpt(spark, d)
    fits = MD.run_models(wide, QUERY_MODEL, names=[t.name for t in TRANSITIONS[:4]], regressor=False)
    got = MD.importances(spark, fits)
    names = DS.feature_table(spark, wide.columns).withColumn("in_list", F.lit(True))
    w = Window.partitionBy("transition")
    got = got.join(names, ["transition", "feature"], "left").withColumn("total", F.sum("importance").over(w)) \
        .withColumn("next", F.lead("importance", 1, 0.0).over(w.orderBy("rank")))
    i = F.col("importance")
    return finalize(got.select("transition", "rank", F.coalesce("in_list", F.lit(False)).alias("listed"),
                               ((i >= F.col("next")) & (F.col("total") <= 1 + 1e-9)).alias("share_ok")))


@register("pipeline_job", with_ctes(panel_ctes() + _ds_sql() + _GUARD, final(
    f"SELECT transition, count(*) AS test_size, {len(_CFG.thresholds)} AS n_thresholds, TRUE AS on_board, TRUE AS cv_ok "
    "FROM live WHERE split = 'test' GROUP BY 1", ints=["test_size", "n_thresholds"], rest=["transition", "on_board", "cv_ok"])))
def q_pipeline_job(spark, d):
    """The whole job; the result tables are read back from the CSV it wrote."""
    from spreadforge.config import JobConfig
    from spreadforge.plans.job import run
    out = scratch_dir(spark, "pipeline_job")
    run(spark, market_panel(spark, d), out, JobConfig(model=QUERY_MODEL))

    def back(name):
        return spark.read.option("header", True).csv(f"{out}/{name}")

    n = back("trading_results_all_thresholds").groupBy("transition").agg(F.count(F.lit(1)).alias("n_thresholds"))
    board = back("leaderboard").select("transition", F.lit(True).alias("on_board"))
    perf = back("model_performance").select("transition", F.col("test_size").cast("bigint").alias("test_size"),
                                            F.col("cv_accuracy").cast("double").between(0.0, 1.0).alias("cv_ok"))
    return finalize(perf.join(n, "transition").join(board, "transition").select("transition", "test_size", "n_thresholds", "on_board", "cv_ok"))


@register("csv_roundtrip", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(SPR)} FROM panel", dbl=SPR, rest=["ts"])))
def q_csv_roundtrip(spark, d):
    from spreadforge.sources.market import csv_roundtrip
    raw = market_panel(spark, d)
    # with a written-out index column, which loading drops
    raw = raw.select(F.unix_timestamp("StartDateTime").alias("Unnamed: 0"), *[F.col(f"`{c}`") for c in raw.columns])
    back = csv_roundtrip(spark, raw, scratch_dir(spark, "market.csv"))
    return finalize(add_spreads_and_fundamentals(CL.clean_market_data(back)).select("ts", *SPR))


@register("feature_names", with_ctes(_feature_ctes() + _feature_sql()[:1] + [_feature_sql()[1], ("nm", _nonmissing_sql())],
                                     final("SELECT transition, feature, count(*) OVER (PARTITION BY transition) AS n_features, "
                                           "non_missing FROM fx JOIN nm USING (feature)",
                                           ints=["n_features", "non_missing"], rest=["transition", "feature"])))
def q_feature_names(spark, d):
    """P23 per transition with the number of non-missing values of each
    selected feature over the whole engineered table."""
    from pyspark.sql import Window
    from spreadforge.operators.quality import _long_counts
    wide = features(spark, d)
    ft = DS.feature_table(spark, wide.columns)
    nm = _long_counts(wide, wide.columns, {"non_missing": lambda c: F.count(c)}).withColumnRenamed("column", "feature")
    out = ft.join(nm, "feature").withColumn("n_features", F.count(F.lit(1)).over(Window.partitionBy("transition")))
    return finalize(out.select("transition", "feature", "n_features", "non_missing"))


_REG_LAG = ["PriceDAM", "PriceDAM_lag1d", "PriceDAM_lag7d", "PriceDAM_ma7d"]


@register("regularised_lags", with_ctes(panel_ctes() + [
    ("cal", "SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM panel"),
    ("rp", "SELECT cal.ts, p.PriceDAM FROM cal LEFT JOIN panel p USING (ts)")], final(
    "SELECT ts, row_number() OVER w - 1 AS idx, PriceDAM, lag(PriceDAM, 48) OVER w AS PriceDAM_lag1d, "
    "lag(PriceDAM, 336) OVER w AS PriceDAM_lag7d, "
    "CASE WHEN count(PriceDAM) OVER fr >= 24 THEN avg(PriceDAM) OVER fr END AS PriceDAM_ma7d FROM rp "
    "WINDOW w AS (ORDER BY ts), fr AS (ORDER BY ts ROWS BETWEEN 383 PRECEDING AND 48 PRECEDING)",
    dbl=_REG_LAG, ints=["idx"], rest=["ts"], digits=4)))
def q_regularised_lags(spark, d):
    """W1 on the regularised half-hour calendar (gaps filled with NULL rows)."""
    f = FE.engineer_features(panel(spark, d), regularise=True)
    return finalize(f.select("ts", "idx", *_REG_LAG), 4)


@register("parquet_roundtrip", with_ctes(panel_ctes(), final(
    f"SELECT ts, {', '.join(SPR)} FROM panel", dbl=SPR, rest=["ts"])))
def q_parquet_roundtrip(spark, d):
    """S1 parquet branch: the raw table written as parquet, read back through
    the suffix-dispatching loader, cleaned, spreads derived."""
    from spreadforge.sources.market import load_market_data, write_table
    path = scratch_dir(spark, "market.parquet")
    write_table(market_panel(spark, d), path, "parquet")
    back = load_market_data(spark, path)
    return finalize(add_spreads_and_fundamentals(CL.clean_market_data(back)).select("ts", *SPR))


# --------------------------------------------------------------------------- many series (one market per zone)
_ZONE_SPREADS = [("zp", "SELECT *, hour(ts) + minute(ts) / 60e0 AS hod, PriceIDA1 - PriceDAM AS spr_IDA1_DAM, "
                        "PriceImbalance - PriceIDA1 AS spr_BM_IDA1, PriceImbalance - PriceDAM AS spr_BM_DAM, "
                        "row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS idx FROM zone_day")]


def zone_panel(spark, d):
    """One parsed row per (zone, half-hour) with spreads and positions."""
    from spreadforge.session import materialize
    raw = materialize(market_panel(spark, d, zones=True))
    p = CL.clean_market_data(raw, stop="collapse", by=["zone"])
    return row_index(add_spreads_and_fundamentals(p), "ts", by="zone")


@register("zone_collapse", with_ctes(zone_sql(dirty=True), final(
    "SELECT zone, ts, hour(ts) + minute(ts) / 60e0 AS hod, arg_min(PriceDAM, seq) AS PriceDAM, arg_min(PriceIDA1, seq) AS PriceIDA1, "
    "avg(PredictedICFlow) AS PredictedICFlow FROM zone_rows GROUP BY zone, ts",
    dbl=["hod", "PriceDAM", "PriceIDA1", "PredictedICFlow"], ints=["zone"], rest=["ts"])))
def q_zone_collapse(spark, d):
    """A1 with a series key: equal timestamps of different zones stay apart."""
    p = CL.clean_market_data(dirty_panel(spark, d, zones=True), order_col="seq", stop="collapse", by=["zone"])
    return finalize(p.select("zone", "ts", "hod", "PriceDAM", "PriceIDA1", "PredictedICFlow"))


_ZONE_ROLL = ["PriceDAM_lag1d", "PriceDAM_ma7d", "PriceDAM_std7d", "PriceDAM_ma14d"]


@register("zone_rolling", with_ctes(zone_sql(), final(
    "SELECT zone, ts, lag(PriceDAM, 48) OVER w AS PriceDAM_lag1d, "
    "CASE WHEN count(PriceDAM) OVER f7 >= 24 THEN avg(PriceDAM) OVER f7 END AS PriceDAM_ma7d, "
    "CASE WHEN count(PriceDAM) OVER f7 >= 24 THEN stddev_samp(PriceDAM) OVER f7 END AS PriceDAM_std7d, "
    "CASE WHEN count(PriceDAM) OVER f14 >= 48 THEN avg(PriceDAM) OVER f14 END AS PriceDAM_ma14d FROM zone_day "
    "WINDOW w AS (PARTITION BY zone ORDER BY ts), f7 AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN 383 PRECEDING AND 48 PRECEDING), "
    "f14 AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN 719 PRECEDING AND 48 PRECEDING)",
    dbl=_ZONE_ROLL, ints=["zone"], rest=["ts"], digits=4)))
def q_zone_rolling(spark, d):
    """W1-W3 per zone; every series crosses several chunks of 800 rows."""
    p = FE.add_lag_features(zone_panel(spark, d), by=["zone"], bases=["PriceDAM"], chunk=800)
    return finalize(p.select("zone", "ts", *_ZONE_ROLL), 4)


_ZONE_T = [t for t in TRANSITIONS if t.spread in ("spr_IDA1_DAM", "spr_BM_IDA1", "spr_BM_DAM")]


@register("zone_split", with_ctes(zone_sql() + _ZONE_SPREADS + [
    ("zd", " UNION ALL ".join(f"SELECT zone, '{t.name}' AS transition, idx FROM zp WHERE idx >= {LAG_BURNIN} AND sign({t.spread}) <> 0"
                              for t in _ZONE_T)),
    ("zn", "SELECT *, row_number() OVER (PARTITION BY zone, transition ORDER BY idx) - 1 AS rn0, "
           "count(*) OVER (PARTITION BY zone, transition) AS n FROM zd")], final(
    "SELECT zone, transition, CASE WHEN rn0 < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, "
    "min(idx) AS idx_min, max(idx) AS idx_max FROM zn GROUP BY 1, 2, 3", ints=["zone", "n_rows", "idx_min", "idx_max"],
    rest=["transition", "split"])))
def q_zone_split(spark, d):
    """W9 per zone and transition."""
    ds = DS.long_dataset(zone_panel(spark, d), _ZONE_T, by=["zone"])
    return finalize(DS.temporal_split(ds, by=["zone"]).groupBy("zone", "transition", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("idx").alias("idx_min"), F.max("idx").alias("idx_max")))
