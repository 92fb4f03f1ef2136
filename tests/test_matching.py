import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, two_way_lattice
from trackloom.operators import matching

POINTS = "agent_id bigint, seq bigint, t_s bigint, x_m double, y_m double"


def drives(spark, agents=3, n=25, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for a in range(agents):
        x, y = rng.uniform(100, 400, 2)
        for k in range(n):
            x, y = x + rng.normal(0, 60), y + rng.normal(0, 60)
            out.append((a, k, 15 * k, float(abs(x)), float(abs(y))))
    return spark.createDataFrame(out, POINTS)


@pytest.mark.parametrize("speed", [False, True])
def test_shared_and_joined_decoding_agree(spark, monkeypatch, speed):
    l = two_way_lattice(spark).where("from_node <= 700 and to_node <= 700").withColumn("speed", F.when(F.col("link") % 5 > 0, (F.col("link") % 7 * 5 + 10).cast("double")))
    m = matching.Model(buffer_m=90.0, top_k=6, cutoff_m=500.0, use_speed=speed)
    p = drives(spark)
    near = rows(matching.match(p, l, m))
    monkeypatch.setattr(matching, "GRAPH_ROWS", 10)
    assert rows(matching.match(p, l, m)) == near and len(near) > 60


def test_speed_counts(spark):
    assert [r[0] for r in spark.createDataFrame([(60.0, 40.0, True), (600.0, 40.0, True), (30.0, 40.0, False), (9.0, None, True), (9.0, None, False)], "v double, r double, ok boolean").select(matching.speed_factor(F.col("v"), F.col("r"), F.col("ok"))).collect()] == [0.5, 0.1, 1.0, 1.0, 0.1]


def cross(spark):
    """A road east, one north from its middle, and one apart."""
    ends = [(0, 1, 2, (0, 0), (100, 0)), (1, 2, 3, (100, 0), (200, 0)), (2, 2, 4, (100, 0), (100, 100)), (3, 8, 9, (0, 60), (80, 60))]
    return spark.createDataFrame([(k, f, t, [tuple(map(float, a)), tuple(map(float, b))]) for k, f, t, a, b in ends], "link bigint, from_node bigint, to_node bigint, pts array<struct<x: double, y: double>>")


def points(spark, data):
    return spark.createDataFrame([(a, k, 10 * k, float(x), float(y)) for a, xy in data.items() for k, (x, y) in enumerate(xy)], POINTS)


def test_nodes_restrict_candidates(spark):
    p = points(spark, {1: [(20, 3), (98, 40), (190, 2)]}).withColumn("node_id", F.when(F.col("seq") == 1, 3))
    got = matching.match(p, cross(spark), matching.Model(buffer_m=30.0), nodes=True)
    assert rows(got.select("seq", "link")) == [(0, 0), (1, 1), (2, 1)]
    assert rows(matching.match(p, cross(spark), matching.Model(buffer_m=30.0)).select("seq", "link"))[1] == (1, 2)


def test_batch_gives_warnings_and_errors(spark):
    p = points(spark, {1: [(20, 3), (60, 2), (60, 58), (150, 2)], 2: [(900, 900)], 3: [(10, 1)], 4: [(10, 1), (190, 1)]})
    got = matching.match_batch(p, cross(spark), matching.Model(buffer_m=15.0))
    assert rows(got["errors"]) == [(2, "no point near a link"), (3, "a single point near a link")]
    assert rows(got["warnings"].select("agent_id", "seq", "next_seq", "link", "next_link")) == [(1, 1, 2, 0, 3), (1, 2, 3, 3, 1)]
    lines = matching.warning_lines(got["warnings"], cross(spark))
    assert lines.count() == 4 and {r["part"] for r in lines.collect()} == {"from", "to"}
    # the first model without warnings is taken for each agent, else the last one
    models = [matching.Model(buffer_m=15.0), matching.Model(buffer_m=15.0, top_k=1), matching.Model(buffer_m=70.0, not_connected=9000.0)]
    best = matching.best_of(p, cross(spark), models)
    assert rows(best.groupBy("agent_id").agg(F.min("model"), F.max("model"))) == [(1, 2, 2), (3, 0, 0), (4, 0, 0)]
    cleaned = matching.match_batch(p, cross(spark), matching.Model(buffer_m=15.0), matching.Cleaning(5.0, 2, 1, 1, 40.0))["matched"]
    assert cleaned.where("agent_id = 4").count() == 6


def test_results_made_dense(spark):
    l = spark.createDataFrame([(0, 1, 2, [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0)]), (1, 2, 3, [(100.0, 100.0), (200.0, 100.0), (200.0, 0.0)])], "link bigint, from_node bigint, to_node bigint, pts array<struct<x: double, y: double>>")
    p = points(spark, {1: [(0, 50), (50, 100), (200, 50)]})
    m = matching.match(p, l, matching.Model(buffer_m=20.0))
    got = matching.dense_result(m, p, l).orderBy("k").collect()
    assert [(r["x_m"], r["y_m"]) for r in got] == [(0, 50), (0, 100), (50, 100), (100, 100), (200, 100), (200, 50)]
    assert [r["t_s"] for r in got] == [0, 5, 10, pytest.approx(13 + 1 / 3), pytest.approx(16 + 2 / 3), 20]


EDGES = "f bigint, t bigint, length double"


def test_k_shortest_against_all_paths(spark):
    rng = np.random.default_rng(5)
    e = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 7, 26), rng.integers(0, 7, 26), rng.integers(1, 9, 26)) if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], EDGES)
    got = matching.k_shortest_paths(df, spark.createDataFrame([(0, 6), (3, 2), (5, 5)], "o bigint, d bigint"), 4).collect()
    for o, d in ((0, 6), (3, 2)):
        costs = []
        for r in range(7):
            for mid in itertools.permutations([x for x in range(7) if x not in (o, d)], r):
                path = (o, *mid, d)
                if all(s in e for s in zip(path, path[1:])):
                    costs.append(sum(e[s] for s in zip(path, path[1:])))
        mine = sorted((r["rank"], r["cost"]) for r in got if (r["o"], r["d"]) == (o, d))
        assert [c for _, c in mine] == sorted(costs)[:4]


def test_paths_of_pairs_and_their_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (4, 1, 700.0)], EDGES)
    pairs = spark.createDataFrame([(1, 3), (3, 1), (2, 2), (4, 3)], "o bigint, d bigint")
    assert rows(matching.od_paths(df, pairs, 1000.0)) == [(1, 3, 10.0, [1, 2, 3]), (2, 2, 0.0, [2]), (3, 1, 1000.0, []), (4, 3, 710.0, [4, 1, 2, 3])]
    at = f"file://{tmp_path}/paths"
    one = matching.path_table(df, 100.0, at, spark.createDataFrame([(1,)], "o bigint"))
    assert rows(one.select("o", "d", "cost", "second", "last_but_one")) == [(1, 2, 5.0, 2, 1), (1, 3, 10.0, 2, 2)]
    all_ = matching.path_table(df, 100.0, at)
    assert rows(all_.select("o", "d", "cost")) == [(1, 2, 5.0), (1, 3, 10.0), (2, 3, 5.0), (4, 1, 700.0)] and matching.path_table(df, 100.0, at).count() == 4
    assert matching.random_paths(df, 2, 1).count() <= 2 and rows(matching.random_paths(df, 2, 1)) == rows(matching.random_paths(df, 2, 1))


def test_long_sequences_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        p, l = drives(spark, 2, 40, 3), two_way_lattice(spark).where("from_node <= 700 and to_node <= 700")
        small = rows(matching.match(p, l, matching.Model(buffer_m=90.0, top_k=6, cutoff_m=500.0)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == rows(matching.match(p, l, matching.Model(buffer_m=90.0, top_k=6, cutoff_m=500.0))) and math.isfinite(small[0][5])


def test_candidates_never_become_rows(spark, monkeypatch):
    staged, held = matching.staged, []

    def counted(df):
        held.append((t := staged(df)).count())
        return t

    monkeypatch.setattr(matching, "staged", counted)
    l = two_way_lattice(spark).where("from_node <= 300 and to_node <= 300")
    m, p = matching.Model(buffer_m=90.0, top_k=6, cutoff_m=500.0), drives(spark, 4, 400, 2)
    got = rows(matching.match(p, l, m))
    assert len(got) > 200 and held == [l.count()]  # the links alone are staged, no candidates
    steps = rows(matching.gaps(p, l, m))
    monkeypatch.setattr(matching, "SEGMENTS", 0)
    assert rows(matching.match(p, l, m)) == got and rows(matching.gaps(p, l, m)) == steps and steps


def test_sequences_matched_in_pieces(spark, monkeypatch):
    from trackloom.functions import roads

    rng = np.random.default_rng(4)
    ends = [(a, b) for r in range(8) for c in range(8) for a, b in ((r * 8 + c, r * 8 + c + 1), (r * 8 + c, r * 8 + c + 8)) if (b - a == 8 or c < 7) and b < 64]
    ends += [(b, a) for a, b in ends]
    f, t = np.array(ends).T
    xy = lambda n: (n % 8 * 100.0, n // 8 * 100.0)
    (x1, y1), (x2, y2) = xy(f), xy(t)
    r = roads.Roads({"link": np.arange(len(f)), "part": np.zeros(len(f), int), "from_node": f, "to_node": t, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "before": np.zeros(len(f)), "length": np.full(len(f), 100.0), "heading": np.zeros(len(f))}, f)
    m = matching.Model(buffer_m=90.0, top_k=5, cutoff_m=400.0)
    x, y = (np.abs(np.cumsum(rng.normal(0, 40, 500))) % 900 for _ in range(2))
    x[7] = np.nan

    def run(seq, x, y):
        return roads.Matcher(r, matching.Moves(matching.Graph(f, t, np.full(len(f), 100.0)), m).search, m).match(seq, x, y)

    whole = run(np.zeros(500, int), x, y)
    # a part of a longer table is matched as if it were alone
    both = run(np.repeat([0, 1], 500), np.tile(x, 2), np.tile(y, 2))
    assert all(np.array_equal(np.concatenate([whole[k], whole[k] + 500 * (k == "row")]), both[k], equal_nan=k != "valid") for k in whole)
    for name, v in (("POINTS", 16), ("MOVES", 7), ("NEAR", 50), ("SLOTS", 300)):
        monkeypatch.setattr(roads, name, v)
    pieces = run(np.zeros(500, int), x, y)
    assert all(np.array_equal(whole[k], pieces[k], equal_nan=k != "valid") for k in whole) and 300 < len(whole["row"]) < 500
    assert not len(run(np.zeros(2, int), np.full(2, 9e6), np.full(2, np.nan))["row"])


def test_only_wanted_paths_are_made(spark):
    rng = np.random.default_rng(6)
    f, t = rng.integers(0, 30, (2, 120))
    g = matching.Graph(f, t, rng.integers(1, 5, 120).astype(float))
    for o in range(30):
        all_ = {d: (d, c, p) for d, c, p in matching._dijkstra(g, o, math.inf) if d != o}
        ends = {d for d in all_ if d % 3 == 0}
        assert sorted(matching._paths_to(g, o, ends, math.inf)) == sorted(all_[d] for d in ends)
        assert sorted(matching._paths_to(g, o, ends, 4.0)) == sorted(all_[d] for d in ends if all_[d][1] <= 4)
    # of a pair too long for its time no path is sought
    df = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0)], EDGES)
    pairs = spark.createDataFrame([(1, 3, 9.0), (2, 3, 9.0)], "o bigint, d bigint, most double")
    assert rows(matching.pair_paths(df, pairs)) == [(2, 3, 5.0, [2, 3])]
