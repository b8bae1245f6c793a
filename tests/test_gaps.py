"""Missing slots of calendars against building them."""
import datetime as dt
import random

from pyspark.sql import functions as F

from spreadforge.operators.ordered import missing_slots, regular_calendar

START, STEP = dt.datetime(2024, 1, 1), dt.timedelta(minutes=30)


def series(seed):
    """Two series with holes, off-grid times, repeated rows, one long gap, a
    null time; a null key is a series."""
    rnd, out = random.Random(seed), []
    for z in ("a", "b", None):
        start = START + dt.timedelta(minutes=rnd.randrange(30))
        out += [(z, start + k * STEP, float(k)) for k in range(300) if rnd.random() < 0.6 or k == 0]
        out += [(z, start + 2000 * STEP, 1.0), (z, start + 7 * STEP + dt.timedelta(minutes=3), 2.0), (z, start, 9.0)]
    return out + [("c", START, 1.0), ("a", None, 5.0)]


def brute(rows):
    out = []
    for z in {r[0] for r in rows}:
        have = {r[1] for r in rows if r[0] == z and r[1]}
        k, end = min(have), max(have)
        while k <= end:
            if k not in have:
                out.append((z, k))
            k += STEP
    return sorted(out, key=str)


def test_gaps_across_chunks_and_series(spark):
    rows = series(2)
    df = spark.createDataFrame(rows, "zone string, at timestamp_ntz, x double")
    for chunk in (3, 64, 20_000):
        got = missing_slots(df, "at", "zone", chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert missing_slots(df.where("false"), "at", "zone").collect() == []
    one = df.where("zone = 'a'").drop("zone")
    assert sorted(r[0] for r in missing_slots(one, "at").collect()) == sorted(t for z, t in brute(rows) if z == "a")


def test_regular_calendar_has_every_slot_and_no_other_time(spark):
    rows = series(5)
    df = spark.createDataFrame(rows, "zone string, at timestamp_ntz, x double")
    got = regular_calendar(df, "at", "zone").collect()
    lo = {z: min(r[1] for r in rows if r[0] == z and r[1]) for z in {r[0] for r in rows}}
    want = [(z, t, x) for z, t, x in rows if t and (t - lo[z]) % STEP == dt.timedelta(0)] + [(z, t, None) for z, t in brute(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plan = regular_calendar(df, "at", "zone")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(__lo" not in plan
