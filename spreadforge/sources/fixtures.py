"""Input tables derived from the driver's parquet tables.

* ``market_panel``  - one half-hourly market row per ``l_shipdate`` of ``lineitem``
  (the wide price / forecast table the cleaning stage expects, raw text clock);
* ``dirty_panel``   - the same with exact copies and colliding timestamps;
* ``scored_rows``   - one scored row per ``lineitem`` row (stand-in model output);
* ``event_bins``    - 30-minute bins of ``events``;
* ``supplier_daily``- daily ``lineitem`` totals per supplier (many series).

Every aggregate below is algebraic (sum / count / min / max / avg), so the
``groupBy(day)`` is combined map-side and a day holding a third of all rows
costs no more than any other.  Sums of money go through DECIMAL so the panel is
exact and engine-independent.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# predicates of the row subsets behind each market (shared with the SQL oracle)
SUBSETS = {
    "all": "TRUE",
    "A": "l_returnflag = 'A'",
    "N": "l_returnflag = 'N'",
    "R": "l_returnflag = 'R'",
    "O": "l_linestatus = 'O'",
    "tax_lo": "l_tax < 0.03e0",
    "tax_mid": "l_tax >= 0.03e0 AND l_tax < 0.06e0",
    "tax_hi": "l_tax >= 0.06e0",
}
WINDOWS = {"w2": "hour(ts) >= 11 AND hour(ts) < 23", "w3": "hour(ts) >= 17 AND hour(ts) < 23"}


def _unit_price(p: str, decimal: bool = False) -> str:
    """sum(price) / sum(quantity) over a subset, summed exactly: as DECIMAL(18,2)
    (oracle form) or, equal and ~3x cheaper on Spark, as integer cents (prices
    have two decimals, quantities are whole, so both sums are exact)."""
    if decimal:
        return (f"CAST(SUM(CASE WHEN {p} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE)"
                f" / CAST(SUM(CASE WHEN {p} THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE)")
    return (f"CAST(SUM(CASE WHEN {p} THEN CAST(round(l_extendedprice * 100e0) AS BIGINT) END) AS DOUBLE) / 100e0"
            f" / SUM(CASE WHEN {p} THEN l_quantity END)")


def _count(p: str, k: float) -> str:
    return f"CAST(NULLIF(COUNT(CASE WHEN {p} THEN 1 END), 0) AS DOUBLE) * {k!r}e0"


def panel_spec(decimal: bool = False) -> list[tuple[str, str, str | None]]:
    """(column, aggregate SQL over lineitem rows of one day, window or None)."""
    S = SUBSETS

    def _unit(p):
        return _unit_price(p, decimal)
    spec = [
        ("PriceDAM", _unit(S["all"]), None),
        ("PriceIDA1", _unit(S["A"]), None),
        ("PriceIDA2", _unit(S["N"]), "w2"),
        ("PriceIDA3", _unit(S["R"]), "w3"),
        ("PriceImbalance", _unit(S["O"]), None),
        ("EirgridActualDemand", "SUM(l_quantity)", None),
        ("EirgridActualWind", "MIN(l_quantity) - 3e0", None),
        ("NIV_Actual", "SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity "
                       "WHEN l_linestatus = 'F' THEN -l_quantity ELSE 0e0 END)", None),
        ("TotalPN", "CAST(COUNT(*) AS DOUBLE)", None),
        ("ActualMeterData", "SUM(l_quantity)", None),
        ("Aggregated Forecast", _count("TRUE", 25.0), None),
        ("AggregatedForecast", _count("TRUE", 26.0), None),
        ("PredictedICFlow", "AVG(CAST(l_suppkey % 100 - 50 AS DOUBLE))", None),
        ("PumpStorage", f"AVG(CASE WHEN {S['R']} THEN CAST(l_suppkey % 100 - 50 AS DOUBLE) END)", None),
        ("GB DAM Epex", _unit(S["tax_lo"]), None),
        ("GB DAM N2EX", _unit(S["tax_mid"]), None),
        ("GB DAM HH Epex", _unit(S["tax_hi"]), None),
        ("PostIDA1Flow", f"AVG(CASE WHEN {S['A']} THEN CAST(l_suppkey % 100 - 50 AS DOUBLE) END)", None),
        ("PostIDA2Flow", f"AVG(CASE WHEN {S['N']} THEN CAST(l_suppkey % 100 - 50 AS DOUBLE) END)", None),
        ("LoadForecast_MW", _count("TRUE", 27.0), None),
    ]
    for s, sub, win in (("DAM", "all", None), ("IDA1", "A", None), ("IDA2", "N", "w2"),
                        ("IDA3", "R", "w3")):
        p = S[sub]
        spec += [
            (f"EirGridDemandFc_{s}", f"SUM(CASE WHEN {p} THEN l_quantity END)", win),
            (f"Meteo_ISEMDEMAND_{s}", _count(p, 25.5), None),
            (f"EirGridWindFc_{s}", f"AVG(CASE WHEN {p} THEN l_quantity END)", win),
            (f"Meteo_ISEMWIND_{s}", f"MAX(CASE WHEN {p} THEN l_quantity END)", None),
            (f"EmSys_C_ISEMWIND_{s}", f"MIN(CASE WHEN {p} THEN l_quantity END)", None),
            (f"EmSys_U_ISEMWIND_{s}", f"AVG(CASE WHEN {p} AND l_linenumber <= 2 THEN l_quantity END)", None),
            (f"ISEMSOLAR_{s}", _count(f"{p} AND l_discount >= 0.05e0", 1.0), win),
        ]
    return spec


PANEL_COLUMNS = ["TradeDate", "Time", "StartDateTime"] + [c for c, _, _ in panel_spec()]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ZONES = 7


def market_panel(spark: SparkSession, sf_dir: str, with_day: bool = False, zones: bool = False) -> DataFrame:
    """Raw half-hourly market table: text ``TradeDate``/``Time``/``StartDateTime``
    and 48 numeric columns; day d of ``lineitem`` becomes half-hour d after
    2022-01-01 00:00.  ``zones`` adds a series key: one market per supplier
    group, so the panel has many series."""
    li = _read(spark, sf_dir, "lineitem")
    spec = panel_spec()
    needed = ["l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"]
    daily = (
        li.select(*needed)
        .withColumn("day", F.expr("datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01')"))
        .withColumn("zone", F.col("l_suppkey") % ZONES)
        .groupBy("day", *(["zone"] if zones else []))
        .agg(*[F.expr(sql).alias(name) for name, sql, _ in spec])
        .withColumn("ts", F.expr("timestampadd(MINUTE, day * 30, TIMESTAMP_NTZ'2022-01-01 00:00:00')"))
    )
    out = [
        *([F.col("zone")] if zones else []),
        F.date_format("ts", "yyyy-MM-dd").alias("TradeDate"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("StartDateTime"),
    ]
    for name, _, win in spec:
        c = F.col(f"`{name}`")
        if win:
            c = F.when(F.expr(WINDOWS[win]), c)
        out.append(c.alias(name))
    if with_day:
        out.append(F.col("day"))
    return daily.select(*out)


def dirty_panel(spark: SparkSession, sf_dir: str, zones: bool = False) -> DataFrame:
    """Panel plus (a) exact copies of days d % 29 = 0 and (b) colliding copies of
    days d % 31 = 0 with ``PredictedICFlow + 2``; ``seq`` (0 original, 1 copy) is
    the deterministic 'first' order."""
    base = market_panel(spark, sf_dir, with_day=True, zones=zones).withColumn("seq", F.lit(0))
    exact = base.where(F.col("day") % 29 == 0)
    coll = (base.where(F.col("day") % 31 == 0)
            .withColumn("PredictedICFlow", F.col("PredictedICFlow") + F.lit(2.0))
            .withColumn("seq", F.lit(1)))
    return base.unionByName(exact).unionByName(coll).drop("day")


#: holes by day number: (column, value in Spark SQL, every, offset)
HOLES = (
    ("PriceDAM", "NULL", 43, 5), ("NIV_Actual", "NULL", 47, 9),
    ("NIV_Actual", "double('infinity')", 19, 1), ("TotalPN", "-double('infinity')", 38, 20),
    ("EirGridWindFc_DAM", "NULL", 11, 3), ("EirGridWindFc_DAM", "double('NaN')", 11, 4), ("EmSys_U_ISEMWIND_DAM", "NULL", 22, 3),
    ("Meteo_ISEMWIND_DAM", "NULL", 44, 3), ("EirGridWindFc_IDA1", "double('NaN')", 13, 2), ("EmSys_U_ISEMWIND_IDA1", "NULL", 26, 2),
    ("Meteo_ISEMWIND_IDA1", "NULL", 52, 2), ("EirGridWindFc_IDA3", "NULL", 7, 1), ("EmSys_U_ISEMWIND_IDA3", "NULL", 14, 1),
    ("Meteo_ISEMWIND_IDA3", "NULL", 28, 1), ("ISEMSOLAR_DAM", "double('NaN')", 17, 0), ("ISEMSOLAR_IDA1", "NULL", 17, 1),
    ("StartDateTime", "' '", 23, 6),
)
#: rows left out: every, offset
GAPS = ((41, 7), (97, 50))


def holed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with missing half-hours, missing must-haves and forecasts (NULL and
    NaN), infinite values and blank text, each on days of one residue."""
    p = market_panel(spark, sf_dir, with_day=True)
    for every, at in GAPS:
        p = p.where(F.col("day") % every != at)
    for name, value, every, at in HOLES:
        p = p.withColumn(name, F.when(F.col("day") % every == at, F.expr(value)).otherwise(F.col(f"`{name}`")))
    return p.drop("day")


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row per lineitem row: transition, ts, spread, p_up, pred_mag."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("transition"),
        F.col("l_shipdate").alias("ts"),
        F.expr("l_extendedprice / l_quantity / 10e0 - 150e0").alias("spread"),
        F.expr("CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 997 AS DOUBLE)").alias("h"),
        F.expr("CAST((l_suppkey * 37 + l_partkey) % 200 AS DOUBLE)").alias("g"),
    ).select(
        "transition", "ts", "spread",
        F.expr("least(greatest(0.5e0 + 0.15e0 * sign(spread) + (h / 997e0 - 0.5e0) * 0.8e0, 0e0), 1e0)").alias("p_up"),
        F.expr("0.5e0 * spread + (g - 100e0) / 5e0").alias("pred_mag"),
    )


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-minute bins of ``events``: count and mean value per event type."""
    ev = _read(spark, sf_dir, "events")
    b = ev.select(
        F.expr("timestampadd(MINUTE, CASE WHEN minute(ts) >= 30 THEN 30 ELSE 0 END, "
               "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ))").alias("ts"),
        "event_type", "value")
    aggs = [F.count(F.lit(1)).alias("n_events")]
    for t in EVENT_TYPES:
        aggs.append(F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(f"{t}_mean"))
    return b.groupBy("ts").agg(*aggs)


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily lineitem totals per supplier: many independent daily series."""
    li = _read(spark, sf_dir, "lineitem")
    return (li.groupBy("l_suppkey", "l_shipdate")
            .agg(F.sum("l_quantity").alias("qty"),
                 F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"),
                 F.count(F.lit(1)).alias("n_lines")))
