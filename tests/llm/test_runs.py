import math
import random

import pytest

from tests.conftest import rows
from tests.test_pings import T0, brute, random_pings, raw

runs = pytest.importorskip("trackloom.llm.runs")


def near(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(h)) <= 5


def expected(data, least=3):
    found = []
    for a, e in brute(data):
        run = []
        for t, p in [x for x in e if x[1]] + [(None, None)]:
            if run and (p is None or not near(run[-1][1], p)):
                if len(run) >= least:
                    found.append((a, run[0][0], run[-1][0], len(run), run[-1][0] - run[0][0]))
                run = []
            run.append((t, p))
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, seed):
    data = random_pings(seed)
    assert rows(runs.position_runs(raw(spark, data))) == expected(data) != []


def test_runs_over_midnight(spark):
    rng = random.Random(5)
    data = []
    for a in range(40):
        t = T0 + 86_400 - 4000
        for _ in range(60):
            t += rng.choice([10, 100, 900, 1800, 1801])
            data.append((f"a{a}", t, None if rng.random() < 0.4 else 98 + rng.choice([0, 0, 0, 1]) * 1e-3, 36.0))
    assert rows(runs.position_runs(raw(spark, data))) == expected(data) != []


def test_parked_for_a_month(spark):
    day = [("a", T0 + 1700 * k, 98.0, 36.0) for k in range(30 * 86_400 // 1700)]
    (got,) = runs.position_runs(raw(spark, day * 3)).collect()
    assert (got["start_s"], got["n_events"]) == (T0, len(day))


def test_more_groups_than_symbols(spark, monkeypatch):
    monkeypatch.setattr(runs, "SYMBOLS", 3)
    data = random_pings(6)
    assert rows(runs.position_runs(raw(spark, data))) == expected(data)


def test_empty_and_all_null(spark):
    for data in ([], [(None, None, None, None)] * 3, [("a", T0, None, None)]):
        assert not rows(runs.position_runs(raw(spark, data)))
