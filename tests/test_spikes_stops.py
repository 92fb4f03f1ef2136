import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trackloom.functions import paths
from trackloom.functions.forest import Forests
from trackloom.operators import spikes, stops, tracks
from trackloom.operators.spikes import false_readings, score_readings
from trackloom.operators.stops import stop_pings, stops_and_trips

T0 = 1_483_228_800
K = 111_194.93


def world(seed=0, agents=6):
    """Drives with a stop each, with displaced, impossible and stuck positions whose numbers are known."""
    rng = np.random.default_rng(seed)
    data, false, stopped = [], set(), set()
    n = 0
    for a in range(agents):
        x = y = 0.0
        t = T0 + a * 50
        direction = rng.uniform(0, 6.28)
        track = []
        for k in range(220):
            moving = not 100 <= k < 140
            t += int(rng.integers(12, 18))
            if moving:
                v = 10 + rng.normal(0, 0.7)
                x, y = x + 15 * v * np.cos(direction), y + 15 * v * np.sin(direction)
                if k % 40 == 0:
                    direction += rng.choice([-1.5, 1.5])
            track.append([t, x + rng.normal(0, 2), y + rng.normal(0, 2), not moving])
        bad = set()
        for k in rng.choice(np.arange(5, 95), 5, replace=False):
            track[k][1] += rng.choice([-1, 1]) * rng.uniform(3000, 20000)
            bad.add(int(k))
        for k in range(160, 172):
            if k > 160:
                track[k][1:3] = track[160][1:3]
                bad.add(k)
        for k, (s, px, py, at_stop) in enumerate(track):
            lng, lat = 98.4 + px / K / np.cos(np.radians(36.3)), 36.3 + py / K
            if k == 200:
                lng, lat = 0.0, 0.0
                bad.add(k)
            if k == 120:
                lng = lat = None
            data.append((n, f"agent-{a}", str(s), lng, lat))
            if k in bad:
                false.add(n)
            if at_stop:
                stopped.add(n)
            n += 1
    return data, false, stopped


SCHEMA = "ping_id bigint, agent_id string, time string, lng double, lat double"


def test_planted_cases_are_found(spark):
    data, false, stopped = world()
    df = spark.createDataFrame([tuple(None if v is None else float(v) if isinstance(v, (float, np.floating)) else v for v in r) for r in data], SCHEMA)
    found = {r[0] for r in false_readings(df).collect()}
    assert len(found & false) >= 0.9 * len(false) and len(found - false) <= 0.05 * len(false)
    at = {r[0] for r in stop_pings(df).collect()}
    assert len(at & stopped) >= 0.97 * len(stopped) and len(at - stopped) <= 0.05 * len(stopped)
    parts = stops_and_trips(df).where("agent_id = 'agent-0'").orderBy("start_s").collect()
    assert [p["kind"] for p in parts] == ["trip", "stop", "trip"] and parts[0]["end_s"] == parts[1]["start_s"]
    scored = score_readings(df).collect()
    assert all(0 < r["score"] < 1 for r in scored)
    # the forest calls few readings suspect, and nearly all of the planted ones
    ordinary, planted = [r for r in scored if r["ping_id"] not in false], [r for r in scored if r["ping_id"] in false]
    assert sum(r["suspect"] for r in ordinary) < 0.2 * len(ordinary) and sum(r["suspect"] for r in planted) >= 0.9 * len(planted)


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    lone = spark.createDataFrame([(1, "a", str(T0), 98.0, 36.0), (2, "b", str(T0), None, 36.0), (3, None, "x", 1.0, 1.0), (4, "a", str(T0), 98.0, 36.0), (5, "c", str(T0), 999.0, 36.0)], SCHEMA)
    assert not false_readings(empty).collect() and not stop_pings(empty).collect()
    assert [r[0] for r in false_readings(lone).collect()] == [5] and not stop_pings(lone).collect()


def test_one_coordinate_can_be_stuck():
    t = np.arange(40) * 15 + T0
    rng = np.random.default_rng(1)
    x, y = np.arange(40) * 100 + rng.normal(0, 2, 40), np.arange(40) * 90 + rng.normal(0, 2, 40)
    y[15:26] = y[15]
    h = paths.Habits(11.0, 2.0, 0.01)
    lng, lat = 98.4 + x / K / np.cos(np.radians(36.3)), 36.3 + y / K
    off, stale = paths.false_positions(np.zeros(40, int), t, lng, lat, h)
    assert not off.any() and np.flatnonzero(stale).tolist() == list(range(16, 26))


def test_forest_isolates_outliers():
    x = np.random.default_rng(0).normal(0, 1, (300, 3))
    x[0] = 9
    both = Forests.grown(np.concatenate([x, x[:1]]), np.array([0, 300, 301, 301]), np.array([1, 2, 3]))
    s = both.score(x, np.zeros(300, int))
    assert s.argmax() == 0 and 0.3 < np.median(s) < 0.6
    assert ((both.score(x, np.full(300, 1)) > 0) & (both.score(x, np.full(300, 2)) > 0)).all()
    # a source's forest doesn't depend on the others grown with it
    alone = Forests.grown(x, np.array([0, 300]), np.array([1]))
    assert (alone.score(x, np.zeros(300, int)) == s).all()
    assert (Forests.unpacked(both.packed()).score(x, np.zeros(300, int)) == s).all()


def one(t, x, y, h, **more):
    n = len(t)
    return paths.stays(np.zeros(n, int), t, x, y, np.full(n, h.jitter), **more)


def test_waits_and_slow_progress_are_no_stays():
    rng = np.random.default_rng(4)
    h = paths.Habits(12.0, 3.0, 0.01)
    t = np.arange(200) * 10
    x = np.concatenate([np.arange(50) * 100, np.full(25, 4900), 4900 + np.arange(125) * 8.0]) + rng.normal(0, 2, 200)
    assert one(t, x, rng.normal(0, 2, 200), h) == []
    x[50:90] = 4900 + rng.normal(0, 2, 40)
    (a, b), = one(t, x, rng.normal(0, 2, 200), h)
    assert 48 <= a <= 51 and 88 <= b <= 92


def test_stop_whose_seeds_lie_at_its_edge():
    # every 100 s an event at one side of the place, two neighbours each way at the other side
    k = np.arange(31) % 10
    x = np.where(k == 0, 6.0, np.where((k < 3) | (k > 7), -6.0, 0.0))
    assert one(np.arange(31) * 10, x, np.zeros(31), paths.Habits(20.0, 0.0, 0.05)) == [(0, 30)]


def test_density_clusters_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = 60
        seg = np.sort(rng.integers(0, 3, n))
        t = np.cumsum(rng.integers(1, 90, n))
        x, y = np.cumsum(rng.normal(0, 6, n)), np.cumsum(rng.normal(0, 6, n))
        got = paths.dense_clusters(seg, t, x, y, np.full(n, 12.0), 200, 4)
        rank = np.arange(n)
        near = (seg == seg[:, None]) & (np.hypot(x - x[:, None], y - y[:, None]) <= 12) & ((np.abs(t - t[:, None]) <= 200) | (np.abs(rank - rank[:, None]) == 1) | (rank == rank[:, None]))
        core = near.sum(1) >= 4
        link = near & core & core[:, None]
        reach = link | np.eye(n, dtype=bool)
        for _ in range(6):
            reach = reach.astype(int) @ reach.astype(int) > 0
        want = np.where(core, [np.flatnonzero(r)[0] for r in reach], -1)
        for i in np.flatnonzero(~core):
            c = np.flatnonzero(near[i] & core)
            if len(c):
                want[i] = want[c[0]]
        assert (got == want).all()


def test_chains_are_sought_among_all_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 40
        t = np.arange(n) * 10
        lng, lat = 98 + rng.choice([0, 0.01, 0.5], n) + np.arange(n) * 1e-4, np.full(n, 36.0)
        h = paths.Habits(12.0, 2.0, 0.01)
        want = paths.false_positions(np.zeros(n, int), t, lng, lat, h)
        monkeypatch.setattr(paths, "BLOCK", 3)
        got = paths.false_positions(np.zeros(n, int), t, lng, lat, h)
        monkeypatch.undo()
        assert (~want[0]).sum() == (~got[0]).sum()


def test_stop_over_midnight(spark):
    # a device parked for three days between two drives, one ping in ten minutes
    rng = np.random.default_rng(2)
    t = [T0 - 900 + 30 * k for k in range(20)] + [T0 + 600 * k for k in range(3 * 144)] + [T0 + 600 * 3 * 144 + 30 * k for k in range(20)]
    x = [*(np.arange(20) * 300.0), *(6000 + rng.normal(0, 2, 3 * 144)), *(6300 + np.arange(20) * 300.0)]
    df = spark.createDataFrame([(k, "a", str(s), float(98.4 + v / K / np.cos(np.radians(36.3))), 36.3) for k, (s, v) in enumerate(zip(t, x))], SCHEMA)
    got = stops_and_trips(df).orderBy("start_s").collect()
    assert [r["kind"] for r in got] == ["trip", "stop", "trip"] and len({r["session_s"] for r in got}) == 1
    assert abs(got[1]["duration_s"] - 3 * 86_400) < 1300 and abs(sum(r["n_events"] for r in got) - len(t)) == 0
    assert stop_pings(df).count() == got[1]["n_events"]


def test_longest_neighbourhood_is_that_of_all_events():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(2, 150))
        s = np.cumsum(rng.integers(1, 60, n))
        x, y = np.cumsum(rng.normal(0, rng.choice([1, 5, 20]), n)) * rng.choice([0, 0.3, 1]) + rng.normal(0, 6, n), rng.normal(0, 6, n)
        away = np.hypot(x - x[:, None], y - y[:, None]) > 15
        first = [max(np.flatnonzero(away[k, :k]), default=-1) + 1 for k in range(n)]
        last = [k + min(np.flatnonzero(away[k, k:]), default=n - k) - 1 for k in range(n)]
        a, z = paths._densest(s, x, y, 15.0, 100)
        assert s[z] - s[a] == max(s[j] - s[i] for i, j in zip(first, last))


def day_batch(days, events, agents):
    """One Arrow batch of packed days with their agents' habits; every 50th event is far off."""
    rng = np.random.default_rng(5)
    t = (T0 + np.sort(rng.choice(86_400, (days, events)), axis=1)).ravel()
    lng, lat = (c + np.cumsum(rng.normal(0, 0.002, (days, events)), axis=1).ravel() for c in (98.4, 36.3))
    lng[::50] += 0.5
    lists = lambda v, n: pa.ListArray.from_arrays(pa.array(np.arange(days + 1, dtype=np.int32) * n), pa.array(v))
    cols = {"agent_id": pa.array([f"a{k % agents}" for k in range(days)]), "day": pa.array(np.full(days, T0 // 86_400))}
    cols |= {"s": lists(t, events), "lng": lists(lng, events), "lat": lists(lat, events), "ping_ids": lists(np.arange(days * events), events)}
    cols |= {c: pa.array(np.full(days, v)) for c, v in (("top", 20.0), ("jitter", 2.0), ("lines", 0.01), ("readings", 1000))}
    return pa.RecordBatch.from_pydict(cols | {"usual": lists(np.ones(days * 24, np.float32), 24)})


@pytest.mark.parametrize("kernel", [spikes._flags, tracks._profile], ids=["flags", "profile"])
def test_memory_does_not_grow_with_the_days_of_a_batch(kernel):
    b = day_batch(1500, 200, 1500)
    tracemalloc.start()
    try:
        for _ in tracks.over_batches(kernel)(iter([b])):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50 << 20


def test_pieces_of_a_batch_are_the_whole_batch(monkeypatch):
    b = day_batch(60, 100, 7)
    whole = {f: f(b) for f in (spikes._flags, stops._stopped(300, 60.0), stops._parts(300, 60.0), tracks._profile)}
    monkeypatch.setattr(tracks, "PIECE_BYTES", b.nbytes // 9)
    empty, lone = b.slice(0, 0), b.slice(3, 1)
    assert [p.num_rows for x in (empty, lone) for p in tracks._pieces(x)] == [1]
    for f, want in whole.items():
        got = list(tracks.over_batches(f)(iter([b])))
        assert len(got) > 9
        if f is tracks._profile:
            total = lambda t: {(r["agent_id"], r["k"]): r["n_sum"] for r in t.group_by(["agent_id", "k"]).aggregate([("n", "sum")]).to_pylist()}
            assert total(pa.Table.from_batches(got)) == pytest.approx(total(pa.Table.from_batches([want])))
        else:
            assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches([want]).to_pylist()
