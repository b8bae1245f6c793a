"""Reference SQL (DuckDB dialect) for the derived input tables, used only as the
independent correctness oracle of the driver queries."""
from __future__ import annotations

from spreadforge.config import HORIZONS, MUST_HAVE, MUST_HAVE_PRICES
from spreadforge.sources.fixtures import PANEL_COLUMNS, WINDOWS, panel_spec


def q(name: str) -> str:
    return '"' + name + '"'


def raw_panel_sql(dirty: bool = False) -> list[tuple[str, str]]:
    spec = panel_spec(decimal=True)
    aggs = ", ".join(f"{sql} AS {q(n)}" for n, sql, _ in spec)
    outs = ", ".join((f"CASE WHEN {WINDOWS[w]} THEN {q(n)} END AS {q(n)}" if w else q(n)) for n, _, w in spec)
    daily = (f"SELECT day, TIMESTAMP '2022-01-01 00:00:00' + to_minutes(CAST(day * 30 AS BIGINT)) AS ts, {aggs} "
             "FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem) "
             "GROUP BY day")
    raw = (f"SELECT strftime(ts, '%Y-%m-%d') AS TradeDate, strftime(ts, '%H:%M:%S') AS Time, "
           f"strftime(ts, '%Y-%m-%d %H:%M:%S') AS StartDateTime, {outs}, day FROM panel_daily")
    ctes = [("panel_daily", daily), ("panel_raw_day", raw),
            ("panel_raw", "SELECT * EXCLUDE (day) FROM panel_raw_day")]
    if dirty:
        ctes.append(("panel_dirty",
                     "SELECT * EXCLUDE (day), 0 AS seq FROM panel_raw_day "
                     "UNION ALL SELECT * EXCLUDE (day), 0 AS seq FROM panel_raw_day WHERE day % 29 = 0 "
                     "UNION ALL SELECT * EXCLUDE (day) REPLACE (PredictedICFlow + 2e0 AS PredictedICFlow), "
                     "1 AS seq FROM panel_raw_day WHERE day % 31 = 0"))
    return ctes


#: forecast revisions, written out
REVISION_SQL = (
    "EirGridWindFc_DAM - EirGridWindFc_IDA1 AS wind_revision_IDA1_DAM",
    "EirGridWindFc_IDA1 - EirGridWindFc_IDA2 AS wind_revision_IDA2_IDA1",
    "EirGridWindFc_IDA2 - EirGridWindFc_IDA3 AS wind_revision_IDA3_IDA2",
    "EirGridDemandFc_IDA1 - EirGridDemandFc_DAM AS demand_revision_IDA1_DAM",
    "EirGridDemandFc_IDA1 - EirGridDemandFc_IDA2 AS demand_revision_IDA2_IDA1",
    "EirGridDemandFc_IDA2 - EirGridDemandFc_IDA3 AS demand_revision_IDA3_IDA2",
)


def zone_sql(dirty: bool = False) -> list[tuple[str, str]]:
    """The raw panel per zone (supplier number modulo 7), times parsed."""
    (_, daily), (_, raw), *_ = raw_panel_sql()
    daily = daily.replace("SELECT day, TIMESTAMP", "SELECT l_suppkey % 7 AS zone, day, TIMESTAMP").replace("GROUP BY day", "GROUP BY l_suppkey % 7, day")
    raw = raw.replace("SELECT strftime", "SELECT zone, ts, strftime", 1).replace("FROM panel_daily", "FROM zone_daily")
    ctes = [("zone_daily", daily), ("zone_day", raw)]
    if dirty:
        ctes.append(("zone_rows", "SELECT *, 0 AS seq FROM zone_day UNION ALL SELECT * REPLACE (PredictedICFlow + 2e0 AS PredictedICFlow), "
                                  "1 AS seq FROM zone_day WHERE day % 31 = 0"))
    return ctes


def holed_sql() -> list[tuple[str, str]]:
    """The panel with holes as the operators should see it: NaN and blanks
    already missing.  Written out, not derived from the Spark side."""
    return raw_panel_sql() + [("panel_holed", """
SELECT * EXCLUDE (day) REPLACE (
  CASE WHEN day % 43 = 5 THEN NULL ELSE "PriceDAM" END AS "PriceDAM",
  CASE WHEN day % 19 = 1 THEN 'infinity'::DOUBLE WHEN day % 47 = 9 THEN NULL ELSE "NIV_Actual" END AS "NIV_Actual",
  CASE WHEN day % 38 = 20 THEN '-infinity'::DOUBLE ELSE "TotalPN" END AS "TotalPN",
  CASE WHEN day % 11 IN (3, 4) THEN NULL ELSE "EirGridWindFc_DAM" END AS "EirGridWindFc_DAM",
  CASE WHEN day % 22 = 3 THEN NULL ELSE "EmSys_U_ISEMWIND_DAM" END AS "EmSys_U_ISEMWIND_DAM",
  CASE WHEN day % 44 = 3 THEN NULL ELSE "Meteo_ISEMWIND_DAM" END AS "Meteo_ISEMWIND_DAM",
  CASE WHEN day % 13 = 2 THEN NULL ELSE "EirGridWindFc_IDA1" END AS "EirGridWindFc_IDA1",
  CASE WHEN day % 26 = 2 THEN NULL ELSE "EmSys_U_ISEMWIND_IDA1" END AS "EmSys_U_ISEMWIND_IDA1",
  CASE WHEN day % 52 = 2 THEN NULL ELSE "Meteo_ISEMWIND_IDA1" END AS "Meteo_ISEMWIND_IDA1",
  CASE WHEN day % 7 = 1 THEN NULL ELSE "EirGridWindFc_IDA3" END AS "EirGridWindFc_IDA3",
  CASE WHEN day % 14 = 1 THEN NULL ELSE "EmSys_U_ISEMWIND_IDA3" END AS "EmSys_U_ISEMWIND_IDA3",
  CASE WHEN day % 28 = 1 THEN NULL ELSE "Meteo_ISEMWIND_IDA3" END AS "Meteo_ISEMWIND_IDA3",
  CASE WHEN day % 17 = 0 THEN NULL ELSE "ISEMSOLAR_DAM" END AS "ISEMSOLAR_DAM",
  CASE WHEN day % 17 = 1 THEN NULL ELSE "ISEMSOLAR_IDA1" END AS "ISEMSOLAR_IDA1",
  CASE WHEN day % 23 = 6 THEN NULL ELSE StartDateTime END AS StartDateTime)
FROM panel_raw_day WHERE day % 41 <> 7 AND day % 97 <> 50""")]


def clean_sql(src: str = "panel_raw", out: str = "panel_clean", seq: str | None = None,
              stop: str | None = None) -> list[tuple[str, str]]:
    """The cleaning stage in SQL; ``stop`` returns early after a named step."""
    p = out
    base_cols = [c for c in PANEL_COLUMNS if c != "PredictedICFlow"] + ["hour", "minute", "hod"]
    first = (lambda c: f"arg_min({q(c)}, {seq}) AS {q(c)}") if seq else (lambda c: f"first({q(c)}) AS {q(c)}")
    ctes = [
        (f"{p}_d", f"SELECT DISTINCT * FROM {src}"),
        (f"{p}_p", f"SELECT * REPLACE (try_strptime(TradeDate, '%Y-%m-%d') AS TradeDate, "
                   "strftime(try_strptime('1970-01-01 ' || trim(Time), '%Y-%m-%d %H:%M:%S'), '%H:%M:%S') AS Time, "
                   "try_strptime(StartDateTime, '%Y-%m-%d %H:%M:%S') AS StartDateTime) "
                   f"FROM {p}_d"),
        (f"{p}_t", "SELECT *, try_strptime(strftime(TradeDate, '%Y-%m-%d') || ' ' || Time, '%Y-%m-%d %H:%M:%S') AS ts "
                   f"FROM {p}_p"),
        (f"{p}_c", f"SELECT *, hour(ts) AS hour, minute(ts) AS minute, hour(ts) + minute(ts) / 60e0 AS hod FROM {p}_t"),
        (f"{p}_g", f"SELECT ts, {', '.join(first(c) for c in base_cols)}, avg(PredictedICFlow) AS PredictedICFlow "
                   f"FROM {p}_c WHERE ts IS NOT NULL GROUP BY ts"),
    ]
    if stop == "parsed":
        return ctes[:-1] + [(out, f"SELECT * FROM {p}_c")]
    if stop == "collapse":
        return ctes + [(out, f"SELECT * FROM {p}_g")]
    fills = ["CASE WHEN EirgridActualWind < 0 THEN 0e0 ELSE EirgridActualWind END AS EirgridActualWind",
             "coalesce(ISEMSOLAR_DAM, 0e0) AS ISEMSOLAR_DAM", "coalesce(ISEMSOLAR_IDA1, 0e0) AS ISEMSOLAR_IDA1"]
    for s in ("DAM", "IDA1"):
        fills.append(f"coalesce(EirGridWindFc_{s}, EmSys_U_ISEMWIND_{s}, Meteo_ISEMWIND_{s}, 0e0) AS EirGridWindFc_{s}")
    ctes.append((f"{p}_f", f"SELECT * REPLACE ({', '.join(fills)}) FROM {p}_g"))
    mh = list(MUST_HAVE) + list(MUST_HAVE_PRICES)
    ctes.append((f"{p}_m", f"SELECT * FROM {p}_f WHERE " + " AND ".join(f"{q(c)} IS NOT NULL" for c in mh)))
    if stop == "must_have":
        return ctes + [(out, f"SELECT * FROM {p}_m")]
    rep = ["CASE WHEN hod >= 11 AND hod < 23 THEN coalesce(ISEMSOLAR_IDA2, 0e0) END AS ISEMSOLAR_IDA2",
           "CASE WHEN hod >= 17 AND hod < 23 THEN coalesce(ISEMSOLAR_IDA3, 0e0) ELSE ISEMSOLAR_IDA3 END AS ISEMSOLAR_IDA3",
           "CASE WHEN hod >= 17 AND hod < 23 THEN coalesce(EirGridWindFc_IDA3, EmSys_U_ISEMWIND_IDA3, "
           "Meteo_ISEMWIND_IDA3, 0e0) ELSE EirGridWindFc_IDA3 END AS EirGridWindFc_IDA3"]
    ctes.append((out, f"SELECT * EXCLUDE (Time) REPLACE ({', '.join(rep)}) FROM {p}_m"))
    return ctes


def spreads_sql(src: str = "panel_clean", out: str = "panel") -> list[tuple[str, str]]:
    # written out, so a wrong pair in the configuration shows
    spr = ["PriceIDA1 - PriceDAM AS spr_IDA1_DAM", "PriceImbalance - PriceIDA1 AS spr_BM_IDA1",
           "PriceImbalance - PriceDAM AS spr_BM_DAM", "PriceIDA2 - PriceIDA1 AS spr_IDA2_IDA1",
           "PriceIDA3 - PriceIDA2 AS spr_IDA3_IDA2", "PriceImbalance - PriceIDA2 AS spr_BM_IDA2",
           "PriceImbalance - PriceIDA3 AS spr_BM_IDA3"]
    dirs = [f"CASE WHEN {s.split()[-1]} >= 0 THEN 1 ELSE -1 END AS dir_{s.split()[-1]}" for s in spr]
    nd = [f"EirGridDemandFc_{s} - EirGridWindFc_{s} - ISEMSOLAR_{s} AS NetDemand_{s}" for s in HORIZONS]
    return [(f"{out}_s", f"SELECT *, {', '.join(spr)} FROM {src}"),
            (out, f"SELECT *, {', '.join(dirs)}, {', '.join(nd)} FROM {out}_s")]


def panel_ctes(dirty: bool = False) -> list[tuple[str, str]]:
    return raw_panel_sql(dirty) + clean_sql() + spreads_sql()


def scored_sql() -> list[tuple[str, str]]:
    base = ("SELECT l_returnflag || '-' || l_linestatus AS transition, l_shipdate AS ts, "
            "l_extendedprice / l_quantity / 10e0 - 150e0 AS spread, "
            "CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 997 AS DOUBLE) AS h, "
            "CAST((l_suppkey * 37 + l_partkey) % 200 AS DOUBLE) AS g FROM lineitem")
    sc = ("SELECT transition, ts, spread, "
          "least(greatest(0.5e0 + 0.15e0 * sign(spread) + (h / 997e0 - 0.5e0) * 0.8e0, 0e0), 1e0) AS p_up, "
          "0.5e0 * spread + (g - 100e0) / 5e0 AS pred_mag FROM scored_base")
    return [("scored_base", base), ("scored", sc)]


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    seen, uniq = set(), []
    for n, s in ctes:
        if n not in seen:
            seen.add(n)
            uniq.append((n, s))
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in uniq) + "\n" + body


def final(inner: str, dbl=(), ints=(), rest=(), digits: int = 6) -> str:
    """Outer projection: doubles rounded, integers as BIGINT (same on the Spark side)."""
    cols = [q(c) for c in rest] + [f"CAST({q(c)} AS BIGINT) AS {q(c)}" for c in ints] + \
           [f"CASE WHEN abs(CAST({q(c)} AS DOUBLE) * 1e{digits}) < 4503599627370496e0 THEN floor(CAST({q(c)} AS DOUBLE) * 1e{digits} + 0.5e0) / 1e{digits} "
            f"ELSE CAST({q(c)} AS DOUBLE) END AS {q(c)}" for c in dbl]
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS fin"
