import math

import pytest
from pyspark.sql import functions as F

from spreadforge.functions.calendar import add_calendar, add_clock_parts, parse_market_time
from spreadforge.functions.scalar import normalise_missing, row_mean, row_range, row_std
from spreadforge.operators import clean as CL
from spreadforge.sources.market import load_market_data


def _raw(spark, rows, extra=""):
    schema = ("TradeDate string, Time string, StartDateTime string, PredictedICFlow double, "
              "EirgridActualWind double, seq int" + extra)
    return spark.createDataFrame(rows, schema)


def test_parse_coerces_bad_values(spark):
    df = _raw(spark, [("2025-01-01", "00:30:00", "2025-01-01 00:30:00", 1.0, 1.0, 0),
                      ("not a date", "00:30:00", "x", 1.0, 1.0, 0),
                      ("2025-01-02", "25:99:00", "2025-01-02 00:00:00", 1.0, 1.0, 0)])
    out = add_clock_parts(parse_market_time(df)).orderBy("seq").collect()
    got = {(r["TradeDate"] is None, r["ts"] is None) for r in out}
    assert (False, False) in got and (True, True) in got
    ok = [r for r in out if r["ts"] is not None][0]
    assert ok["hour"] == 0 and ok["minute"] == 30 and ok["hod"] == 0.5


def test_collapse_first_non_missing_and_mean_flow(spark):
    rows = [("2025-01-01", "10:00:00", "s", 10.0, None, 0), ("2025-01-01", "10:00:00", "s", 20.0, 5.0, 1),
            ("2025-01-01", "10:00:00", "s", 30.0, 7.0, 2), ("2025-01-01", "10:30:00", "s", 1.0, 2.0, 0)]
    df = add_clock_parts(parse_market_time(_raw(spark, rows)))
    out = {r["hod"]: r for r in CL.collapse_duplicate_ts(df, order_col="seq").collect()}
    assert out[10.0]["PredictedICFlow"] == 20.0 and out[10.0]["EirgridActualWind"] == 5.0
    via_join = {r["hod"]: r for r in CL.collapse_via_join(df, order_col="seq").collect()}
    assert via_join[10.0]["PredictedICFlow"] == 20.0 and via_join[10.0]["EirgridActualWind"] == 5.0


def test_window_repair_asymmetry(spark):
    df = spark.createDataFrame(
        [(5.0, None, 3.0, None, 1.0, 2.0), (12.0, None, None, None, 1.0, 2.0), (18.0, 4.0, None, None, None, 2.0),
         (23.5, 9.0, 8.0, 6.0, 1.0, 2.0)],
        "hod double, ISEMSOLAR_IDA2 double, ISEMSOLAR_IDA3 double, EirGridWindFc_IDA3 double, "
        "EmSys_U_ISEMWIND_IDA3 double, Meteo_ISEMWIND_IDA3 double")
    r = {x["hod"]: x for x in CL.window_repair(df).collect()}
    assert r[5.0]["ISEMSOLAR_IDA2"] is None and r[12.0]["ISEMSOLAR_IDA2"] == 0.0
    assert r[5.0]["ISEMSOLAR_IDA3"] == 3.0          # outside IDA3 window left as is
    assert r[18.0]["ISEMSOLAR_IDA3"] == 0.0 and r[18.0]["EirGridWindFc_IDA3"] == 2.0
    assert r[23.5]["ISEMSOLAR_IDA2"] is None and r[23.5]["EirGridWindFc_IDA3"] == 6.0


def test_normalise_and_row_stats(spark):
    df = spark.createDataFrame([(float("nan"), " ", 1.0, 3.0, None), (2.0, "a", 1.0, None, None)],
                               "a double, s string, x double, y double, z double")
    r = normalise_missing(df).collect()
    assert r[0]["a"] is None and r[0]["s"] is None and r[1]["s"] == "a"
    cols = [F.col("x"), F.col("y"), F.col("z")]
    out = df.select(row_mean(cols).alias("m"), row_std(cols).alias("s"), row_range(cols).alias("r")).collect()
    assert out[0]["m"] == 2.0 and math.isclose(out[0]["s"], math.sqrt(2.0)) and out[0]["r"] == 2.0
    assert out[1]["s"] is None and out[1]["m"] == 1.0 and out[1]["r"] == 0.0


def test_calendar_monday_is_zero(spark):
    df = spark.createDataFrame([("2025-01-06 07:00:00",)], "t string") \
        .select(F.col("t").cast("timestamp_ntz").alias("ts")).withColumn("hod", F.lit(21.0))
    r = add_calendar(df).collect()[0]
    assert r["dow"] == 0 and r["is_weekend"] == 0 and r["is_winter"] == 1 and r["is_peak"] == 1


def test_loader_rejects_other_suffix(spark):
    with pytest.raises(ValueError):
        load_market_data(spark, "/tmp/whatever.json")


def test_must_have_and_clip(spark):
    df = spark.createDataFrame([(-2.0, 1.0), (3.0, None)], "EirgridActualWind double, TotalPN double")
    assert [r[0] for r in CL.clip_negative(df).collect()] == [0.0, 3.0]
    assert CL.must_have_filter(df).count() == 1


def test_csv_index_column_dropped(spark, tmp_path):
    import pandas as pd
    pdf = pd.DataFrame({"TradeDate": ["2025-01-01"], "Time": ["00:30:00"], "StartDateTime": ["2025-01-01 00:30:00"],
                        "PriceDAM": [" "], "TotalPN": ["12.5"]})
    path = str(tmp_path / "m.csv")
    pdf.to_csv(path, index=True)          # leading unnamed index column
    df = load_market_data(spark, path)
    assert df.columns == ["TradeDate", "Time", "StartDateTime", "PriceDAM", "TotalPN"]
    r = df.first()
    assert r["PriceDAM"] is None and r["TotalPN"] == 12.5


def test_collapse_keeps_series_apart(spark):
    from spreadforge.operators.clean import collapse_duplicate_ts
    rows = [("a", 1, 10.0, 1.0, 0), ("a", 1, 12.0, 3.0, 1), ("b", 1, 20.0, 5.0, 0), (None, 1, 30.0, 7.0, 0)]
    df = spark.createDataFrame(rows, "zone string, ts long, price double, PredictedICFlow double, seq int")
    got = {r["zone"]: (r["price"], r["PredictedICFlow"]) for r in collapse_duplicate_ts(df, order_col="seq", by=["zone"]).collect()}
    assert got == {"a": (10.0, 2.0), "b": (20.0, 5.0), None: (30.0, 7.0)}
