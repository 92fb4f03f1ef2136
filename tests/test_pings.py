import math
import random

from pyspark.sql import functions as F

from tests.conftest import rows
from trackloom.functions.timeparse import epoch_seconds
from trackloom.operators import gridding, pings, sessions

SCHEMA = "ping_id bigint, agent_id string, time string, lng double, lat double, extra string"
T0 = 1_483_228_800


def raw(spark, data):
    return spark.createDataFrame([(i, a, None if t is None else str(t), x, y, "z") for i, (a, t, x, y) in enumerate(data)], SCHEMA)


def test_notations(spark):
    cases = {
        "2017-01-01 00:13:22": T0 + 802, "2017/01/01 00:13:22": T0 + 802, "2017-01-01T00:13:22Z": T0 + 802, "2017-01-01 00:13:22.900": T0 + 802,
        "2017-01-01T08:13:22+08:00": T0 + 802, "2016-12-31T19:13:22-0500": T0 + 802, "01.01.2017 00:13:22": T0 + 802, "20170101001322": T0 + 802,
        str(T0 + 802): T0 + 802, f"{T0 + 802}999": T0 + 802, f"{T0 + 802}000000": T0 + 802, f" {T0 + 802}\t": T0 + 802, f"{T0 + 802}.5": T0 + 802,
        "0000-00-00 00:00:00": None, "2017-02-30 00:00:00": None, "2022-01-": None, "N/A": None, "": None, "2O2l-0?-1? --:--": None, "20171301001322": None, "9" * 30: None,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", epoch_seconds(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases | {None: None}


def random_pings(seed=3, n=600):
    rng = random.Random(seed)
    out = []
    for a in ("a", " A ", "b", None, "", "c\t"):
        t = T0 - 3000
        for _ in range(n // 6):
            t += rng.choice([0, 1, 30, 300, 1799, 1800, 1801, 5000, 86400])
            lost = rng.random() < 0.15
            out.append((a, t if rng.random() > 0.05 else rng.choice([None, "?"]), None if lost else 98 + rng.choice([0, 1, 2, 50]) * 3e-5, 36.0))
    rng.shuffle(out)
    return out


def brute(data, gap=1800):
    ev = {}
    for a, t, x, y in data:
        a = (a or "").strip().lower()
        if a and isinstance(t, int):
            key = (a, t)
            ev[key] = max(filter(None, [ev.get(key), (x, y) if x is not None else None]), default=None)
    out = []
    for (a, t), p in sorted(ev.items()):
        if not out or out[-1][0] != a or t - out[-1][1][-1][0] > gap:
            out.append((a, []))
        out[-1][1].append((t, p))
    return out


def sweep(df):
    return sessions.sweep_sessions(pings.day_events(df, before_s=pings.SESSION_GAP_S))


def check_against_brute_force(spark, data):
    df = raw(spark, data)
    want = brute(data)
    assert rows(sweep(df)) == sorted(((a, e[0][0], e[-1][0], e[-1][0] - e[0][0], len(e)) for a, e in want), key=repr)
    ev = sessions.session_events(df)
    assert rows(ev.select("agent_id", "start_s", "s")) == sorted(((a, e[0][0], t) for a, e in want for t, _ in e), key=repr)
    cells = {(a, c, c in {t // 300 * 300 for t, p in e if p}) for a, e in want for c in range(e[0][0] // 300 * 300, e[-1][0] // 300 * 300 + 1, 300)}
    assert rows(gridding.session_grid(df).select("agent_id", "period_s", "covered")) == sorted(cells, key=repr)


def test_sessions_and_grid_against_brute_force(spark):
    check_against_brute_force(spark, random_pings())


def test_session_of_many_days_delivered_again_and_again(spark):
    # one agent that never pauses for 30 days, every position delivered ten times
    rng = random.Random(1)
    day = [("a", T0 + 1500 * k, None if rng.random() < 0.2 else 98.0 + k * 1e-3, 36.0) for k in range(30 * 86_400 // 1500)]
    df = raw(spark, day * 10)
    assert [(r["duration_s"], r["n_events"]) for r in sweep(df).collect()] == [(1500 * (len(day) - 1), len(day))]
    check_against_brute_force(spark, day)
    # no group holds more than an agent's day and its halo
    assert pings.day_packs(df, 7200).selectExpr("max(size(array_distinct(s)))").first()[0] <= (86_400 + 2 * 7200) / 1500 + 1


def test_ticks_at_midnight(spark):
    data = [("a", T0 - 1800, 1.0, 1.0), ("a", T0, 1.0, 1.0), ("a", T0 + 1800, 1.0, 1.0), ("a", T0 + 3601, 1.0, 1.0), ("b", T0 - 1801, 1.0, 1.0), ("b", T0, None, 1.0)]
    check_against_brute_force(spark, data)


def test_filled_positions_lie_between_their_neighbours(spark):
    df = raw(spark, [("a", T0, 10.0, 0.0), ("a", T0 + 1500, 10.01, 0.0), ("b", T0, 179.995, 0.0), ("b", T0 + 1500, -179.995, 0.0)])
    got = {r["period_s"]: r for r in gridding.session_grid(df).where("agent_id = 'a'").collect()}
    assert [got[T0 + k]["covered"] for k in range(0, 1501, 300)] == [True, False, False, False, False, True]
    assert math.isclose(got[T0 + 300]["lng"], 10.003) and math.isclose(sum(r["moved_m"] or 0 for r in got.values()), 1111.95, abs_tol=0.1)
    # the shorter way around the globe
    assert all(abs(r["lng"]) > 179.99 for r in gridding.session_grid(df).where("agent_id = 'b'").collect())


def test_long_waits_are_marked_not_filled(spark):
    df = raw(spark, [("a", T0, 10.0, 0.0), *(("a", T0 + 1500 * k, None, None) for k in range(1, 6)), ("a", T0 + 9000, 10.01, 0.0)])
    got = {r["period_s"] - T0: (r["lng"], r["moved_m"], r["covered"]) for r in gridding.session_grid(df).collect()}
    assert len(got) == 31 and got[4500] == (None, None, False) and got[9000][2]
    assert {r["period_s"] - T0: r["lng"] for r in gridding.session_grid(df, bridge_s=9000).collect()}[4500] is not None


def test_counter_resets_and_overlaps(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 600, 60), ("a", 900, 10), ("a", 900, 9), ("a", None, 3), ("b", 5, 1)], "k string, t bigint, v bigint")
    got = {(r["k"], r["cell_s"]): r["increment"] for r in gridding.increments(df, ["k"], "t", "v", 300).collect()}
    assert got == {("a", 0): 30.0, ("a", 300): 30.0, ("a", 600): 10.0}


def test_a_session_s_counters_begin_anew(spark):
    df = raw(spark, [("a", T0 + s, x, 0.0) for s, x in ((0, 1.0), (100, 1.001), (200, 1.002), (5000, 1.003), (5100, 1.004))])
    got = gridding.counter_readings(pings.day_events(df)).orderBy("s").collect()
    assert [r["n"] for r in got] == [1, 2, 3, 1, 2] and [round(r["odo_m"]) for r in got] == [0, 111, 222, 0, 111]


def test_empty_and_all_null(spark):
    for data in ([], [(None, None, None, None)] * 3):
        df = raw(spark, data)
        assert not rows(sessions.session_events(df)) and not rows(gridding.session_grid(df)) and not rows(sweep(df))
