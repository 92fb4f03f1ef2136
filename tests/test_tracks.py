import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import rows, two_way_lattice
from trackloom.functions import projection
from trackloom.operators import cleaning, grids, matching, network, simulation, trips


def line(spark, xs, dt=10, agent=1, times=None):
    return spark.createDataFrame([(agent, i, (times or [k * dt for k in range(len(xs))])[i], float(x), 0.0) for i, x in enumerate(xs)], "agent_id bigint, seq bigint, t_s bigint, x_m double, y_m double")


def xs(df):
    return [r["x_m"] for r in df.orderBy("agent_id", "seq").collect()]


def test_dwell(spark):
    assert xs(cleaning.remove_dwell(line(spark, [-100, 0, 1, 2, 3, 100]), 5, 2)) == [-100, 3, 100]
    # an agent's leading run has no moving point before it and is one short
    assert xs(cleaning.remove_dwell(line(spark, [0, 1, 2, 3, 100]), 5, 2)) == [0, 1, 2, 3, 100]


def test_densify_downsample_and_rolling(spark):
    d = cleaning.densify(line(spark, [0, 300], 30), 120).orderBy("seq").collect()
    assert [(r["x_m"], r["t_s"], r["loc_type"]) for r in d] == [(0, 0, "s"), (100, 10, "d"), (200, 20, "d"), (300, 30, "s")]
    assert len(cleaning.densify(line(spark, [0, 240], 30), 120).collect()) == 4
    assert xs(cleaning.lower_frequency(line(spark, [0, 1, 2, 3, 4]), 2)) == [0, 2, 4]
    assert xs(cleaning.rolling_average(line(spark, [0, 10, 20]), 2)) == [0, 5, 15]


def test_trips_and_waypoints(spark):
    assert [r["trip_no"] for r in trips.main_trips(line(spark, [0, 1, 2], times=[0, 1800, 3601])).orderBy("seq").collect()] == [1, 1, 2]
    od = trips.waypoint_od(line(spark, range(1, 13)), ["agent_id"]).collect()[0]
    assert (od["o_x"], od["d_x"], od["way_points"]) == (1.0, 12.0, ";".join(f"{k}.0,0.0" for k in (2, 4, 6, 8, 10)))
    assert trips.waypoint_od(line(spark, range(4)), ["agent_id"]).collect()[0]["way_points"] == "1.0,0.0;2.0,0.0"
    assert not trips.waypoint_od(line(spark, [1]), ["agent_id"]).collect()


def test_route_times(spark):
    seg = [(10.0, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (20.0, [(2.0, 0.0), (2.0, 4.0)])]
    r = spark.createDataFrame([(1, 100.0, seg)], "path_id bigint, o_time_s double, segments array<struct<time_cost: double, pts: array<struct<x: double, y: double>>>>")
    assert [(q["t_s"], q["x"], q["y"]) for q in trips.route_points(r).orderBy("seq").collect()] == [(100, 0, 0), (105, 1, 0), (110, 2, 0), (130, 2, 4)]


def test_kalman_and_simplify(spark):
    rng = np.random.default_rng(0)
    z = np.arange(60) * 5 + rng.normal(0, 4, 60)
    k = xs(cleaning.kalman_smooth(line(spark, z), 0.1, 4))
    dt = np.full(59, 10.0)
    f, q, p = np.array([z[0], 0.0]), 0.01 * np.eye(2), np.eye(2)
    want = [z[0]]
    for m, h in zip(z[1:], dt):
        a = np.array([[1, h], [0, 1]])
        f, p = a @ f, a @ p @ a.T + q
        g = p[:, 0] / (p[0, 0] + 16)
        f, p = f + g * (m - f[0]), p - np.outer(g, p[0])
        want.append(f[0])
    assert np.allclose(k, want)
    assert len(xs(cleaning.simplify(line(spark, [3.0]), 5))) == 1 and len(xs(cleaning.simplify(line(spark, z), 5))) == 60
    assert cleaning.simplify_line(np.array([0, 1, 2, 3.0]), np.array([0, 0.1, 5, 0]), 1).tolist() == [0, 2, 3]


def test_run_ids(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, "a")], "k int, t int, v string")
    assert rows(cleaning.run_ids(df, ["k"], ["t"], ["v"]).select("k", "t", "run")) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (2, 1, 1)]


def test_gap_fill(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "k int, t int, v double")
    assert [r["v"] for r in cleaning.gap_fill(df, ["k"], "t", "v").orderBy("t").collect()] == [1, 1, 2, 3, 4, 4]


def test_projections_round_trip(spark):
    p = spark.createDataFrame([(98.4, 36.3), (-70.2, -33.4), (3.1, 71.0), (108.97, 34.2), (179.99, 0.1)], "lng double, lat double")
    z = projection.utm_zone(F.col("lng"))
    x, y = projection.to_utm(F.col("lng"), F.col("lat"), z)
    p = p.withColumn("z", z).withColumn("x", x).withColumn("y", y)
    u, v = projection.from_utm(F.col("x"), F.col("y"), F.col("z"), F.col("lat") < 0)
    for r in p.withColumn("u", u).withColumn("v", v).withColumn("e", projection.utm_epsg(F.col("lng"), F.col("lat"))).collect():
        assert abs(r["u"] - r["lng"]) < 1e-9 and abs(r["v"] - r["lat"]) < 1e-9
        if r["lng"] == 108.97:
            assert r["e"] == 32649
    # a meridian arc is exact on the central meridian: 0.9996 times the quarter's 5,540,847.042 m at 50 degrees
    x, y = projection.to_utm(F.lit(9.0), F.lit(50.0), F.lit(32))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r["x"] - 500_000) < 1e-6 and abs(r["y"] - 0.9996 * 5_540_847.042) < 0.01
    for there, back, tol in (("84-gc", "gc-84", 5e-5), ("gc-bd", "bd-gc", 1e-5), ("84-bd", "bd-84", 6e-5)):
        a = projection.convert_datum(F.lit(108.9), F.lit(34.2), there)
        b = projection.convert_datum(*a, back)
        r = spark.range(1).select(a[0].alias("ax"), b[0].alias("bx"), b[1].alias("by")).first()
        assert abs(r["bx"] - 108.9) < tol and abs(r["by"] - 34.2) < tol and abs(r["ax"] - 108.9) > 1e-3


def test_registration(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (8, 2))
    m = np.array([[2, 1, 0], [-1, 2, 0], [7, -3, 1]])
    a = np.column_stack([p, np.ones(8)]) @ m
    df = spark.createDataFrame([tuple(map(float, (*u, *v[:2]))) for u, v in zip(p, a)], "px double, py double, ax double, ay double")
    for method in ("affine", "helmert"):
        assert np.allclose(grids.fit(df, method), m)
    assert np.allclose([[r["gx"], r["gy"]] for r in grids.apply_matrix(df, m).collect()], a[:, :2])
    with pytest.raises(ValueError):
        grids.fit(df.limit(2))


def test_fishnet_and_curves(spark):
    assert [r["grid_id"] for r in grids.fishnet(spark, 0, 0, 5000, 3000, 2000).orderBy("grid_id").collect()] == [1, 2, 3, 5, 6, 7]
    a, b = (f(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)) for f in (grids.bezier, grids.arc))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    for pts in (r["a"], r["b"]):
        assert len(pts) == 20 and math.isclose(pts[0]["x"], 0, abs_tol=1e-9) and math.isclose(pts[-1]["x"], 10) and math.isclose(pts[-1]["y"], 0, abs_tol=1e-9)


def test_viterbi():
    a = np.array([[1, 1.2, 1.3], [1.2, 1.3, 1.4], [1.5, 1.4, 1.3]])
    states, score = matching.viterbi([np.array([0.5, 0.2, 0.3]), np.array([0.5, 0.5, 0.1])], [a])
    assert states == [2, 0] and math.isclose(score, 2.3 - math.log(3))
    rng = np.random.default_rng(0)
    e, m = [rng.normal(size=3) for _ in range(5)], [rng.normal(size=(3, 3)) for _ in range(4)]
    best = max(itertools.product(range(3), repeat=5), key=lambda s: sum(e[i][k] for i, k in enumerate(s)) + sum(m[i][s[i], s[i + 1]] for i in range(4)))
    assert matching.viterbi(e, m)[0] == list(best)


def graph(spark, seed=0, n=40, edges=90):
    rng = np.random.default_rng(seed)
    e = {(int(a), int(b)): int(w) for a, b, w in zip(rng.integers(0, n, edges), rng.integers(0, n, edges), rng.integers(1, 9, edges)) if a != b}
    return e, spark.createDataFrame([(a, b, float(w)) for (a, b), w in e.items()], "f bigint, t bigint, length double")


def test_bounded_paths(spark):
    e, df = graph(spark)
    n = 40
    d = np.full((n, n), np.inf)
    for (a, b), w in e.items():
        d[a, b] = w
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    want = sorted((i, j, d[i, j]) for i in range(n) for j in range(n) if i != j and d[i, j] <= 12)
    got = matching.bounded_paths(df, 12.0).collect()
    assert sorted((r["o"], r["d"], r["cost"]) for r in got) == want
    for r in got:
        assert math.isclose(sum(e[p] for p in zip(r["path"], r["path"][1:])), r["cost"]) and (r["path"][0], r["path"][-1]) == (r["o"], r["d"])
    assert sorted(map(tuple, matching.relaxed_costs(df, 12.0).collect())) == want


def test_large_graphs_give_the_same(spark, monkeypatch):
    _, df = graph(spark, 1, 30, 90)
    # equal costs over differently many links, a link without length, a repeated one and a loop
    more = df.unionByName(spark.createDataFrame([(50, 51, 2.0), (51, 53, 2.0), (50, 52, 4.0), (50, 53, 4.0), (52, 53, 0.0), (53, 52, 0.0), (50, 51, 3.0), (51, 51, 0.0)], df.schema))
    p = line(spark, [10, 120, 230, 340, 430], dt=20)
    l = two_way_lattice(spark).where("from_node <= 60 and to_node <= 60")
    m = matching.Model(buffer_m=60.0, top_k=4, cutoff_m=250.0)
    e = l.select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.lit(100.0).alias("length"))

    def results():
        got = matching.match(p, l, m)
        ends = got.where("seq in (0, 4)")
        return rows(matching.bounded_paths(more, 12.0)), rows(got), rows(matching.completed(ends, p, matching.bounded_paths(e, 600.0), l))

    small = results()
    monkeypatch.setattr(matching, "GRAPH_ROWS", 10)
    assert results() == small and len(small[1]) == 5 and len(small[2]) >= 2


@pytest.mark.parametrize("graph_rows", [2_000_000, 1])
def test_beyond_the_cutoff(spark, monkeypatch, graph_rows):
    monkeypatch.setattr(matching, "GRAPH_ROWS", graph_rows)
    ends = [0.0, 500.0, 600.0, 700.0, 800.0, 900.0]
    l = spark.createDataFrame([(k, k, k + 1, a, 0.0, b, 0.0) for k, (a, b) in enumerate(zip(ends, ends[1:]))], "link bigint, from_node bigint, to_node bigint, x1 double, y1 double, x2 double, y2 double")
    p = line(spark, [450, 550, 850], dt=60)
    m = matching.Model(buffer_m=20.0, cutoff_m=150.0)
    got = matching.match(p, l, m)
    # the first link is longer than the cutoff, but leads to the second one
    assert [(r["link"], r["route_m"]) for r in got.orderBy("seq").collect()] == [(0, 100.0), (1, 1000.0), (4, None)]
    paths = matching.bounded_paths(matching.link_edges(l), m.cutoff_m)
    # from the second to the fifth link it is 200 m
    assert rows(matching.completed(got, p, paths, l).select("seq", "sub_seq", "link")) == [(1, 1, 2), (1, 2, 3)]


def test_links_that_bend(spark):
    # 100 m north, then 100 m east; its chord is far from its corner and shorter than its course
    l = spark.createDataFrame([(0, 1, 2, [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0)]), (1, 2, 3, [(100.0, 100.0), (200.0, 100.0)])], "link bigint, from_node bigint, to_node bigint, pts array<struct<x: double, y: double>>")
    p = spark.createDataFrame([(1, 0, 0, 3.0, 50.0), (1, 1, 10, 60.0, 104.0), (1, 2, 20, 150.0, 100.0)], "agent_id bigint, seq bigint, t_s bigint, x_m double, y_m double")
    c = matching.candidates(p, l, matching.Model(buffer_m=20.0))
    assert rows(c.select("seq", "link", "dist_m", "along_m", "length", "dx", "dy")) == [(0, 0, 3.0, 50.0, 200.0, 0.0, 100.0), (1, 0, 4.0, 160.0, 200.0, 100.0, 0.0), (2, 1, 0.0, 50.0, 100.0, 100.0, 0.0)]
    got = matching.match(p, l, matching.Model(buffer_m=20.0)).orderBy("seq").collect()
    assert [(r["link"], r["route_m"]) for r in got] == [(0, 110.0), (0, 90.0), (1, None)]
    assert rows(matching._middles(l).select("link", "x_m", "y_m", "along_m")) == [(0, 0.0, 100.0, 100.0), (1, 150.0, 100.0, 50.0)]


@pytest.mark.parametrize("one_task", [1_000_000, 5])
def test_components_and_chains(spark, monkeypatch, one_task):
    monkeypatch.setattr(network, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 260)] + [(500, 500)]
    root = {v: v for p in e for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = network.components(spark.createDataFrame(e, "a bigint, b bigint"))
    assert rows(got) == sorted(((v, find(v)) for v in root), key=repr)
    links = spark.createDataFrame([(1, 1, 2, 0, 5.0), (2, 2, 3, 0, 5.0), (3, 3, 4, 0, 5.0), (4, 3, 5, 0, 5.0), (5, 9, 9, 0, 1.0), (6, None, 1, 0, 1.0)], "link_id bigint, from_node bigint, to_node bigint, dir int, length double")
    assert rows(network.chains(links)) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_components_of_all_links(spark, tmp_path):
    # nodes 1 to 4 hang together by links 1, 2, 3 only if no link is left out; 8 and 9 are a second component
    links = [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 8, 9), (5, None, 7)]
    spark.createDataFrame(links, "link_id bigint, from_node bigint, to_node bigint").write.parquet(f"{tmp_path}/link_layer.parquet")
    assert rows(entry.queries()["network_components"](spark, str(tmp_path))) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]


def test_directions(spark):
    links = spark.createDataFrame([(1, 1, 2, 1, 5.0), (2, 1, 3, -1, 5.0), (3, 4, 5, 0, 5.0), (4, 4, 5, 1, 6.0), (5, 7, 7, 0, 1.0)], "link_id bigint, from_node bigint, to_node bigint, dir int, length double")
    assert rows(network.directed_links(links).select("link_id", "from_node", "to_node")) == [(1, 1, 2), (2, 3, 1), (3, 4, 5), (3, 5, 4)]
    assert [r["single_link_id"] for r in network.with_single_ids(network.directed_links(links)).orderBy("single_link_id").collect()] == [0, 1, 2, 3]
    assert rows(network.forward_only(links).where("link_id = 2").select("from_node", "to_node", "dir")) == [(3, 1, 1)]
    pair = spark.createDataFrame([(1, 1, 2, 1, 5.0), (2, 2, 1, 1, 5.4), (3, 1, 2, 1, 9.0)], "link_id bigint, from_node bigint, to_node bigint, dir int, length double")
    assert rows(network.merge_double(pair).select("link_id", "dir")) == [(1, 0), (3, 1)]
    two = pair.withColumn("v_ab", F.lit(1)).withColumn("v_ba", F.lit(2)).withColumn("dir", F.lit(0)).where("link_id = 1")
    assert rows(network.fold_two_way(two, ["v"]).select("from_node", "to_node", "v")) == [(1, 2, 1), (2, 1, 2)]


def test_lines_to_network(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 4.0)]), (2, [(3.0, 4.0), (3.0, 5.0), (9.0, 5.0)]), (3, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (4, [(1.0, 1.0)])], "link_id bigint, pts array<struct<x: double, y: double>>")
    nodes, links = network.nodes_from_ends(df)
    assert rows(nodes.select("node_id", "x", "y")) == [(1, 0, 0), (2, 3, 4), (3, 9, 5)]
    assert rows(links.select("link_id", "from_node", "to_node", "length")) == [(1, 1, 2, 5.0), (2, 2, 3, 7.0)]
    near = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 9.0, 5.0), (4, 3.5, 4.0)], "node_id bigint, x double, y double")
    kept, out = network.merge_near_nodes(near, links.drop("pts"), 1.0)
    assert dict(rows(kept)) == {1: 1, 2: 2, 3: 3, 4: 2} and len(rows(out)) == 2


def test_simulated_drive_is_matched(spark):
    roads = two_way_lattice(spark)
    nodes = [1 + k for k in range(6)] + [6 + 50 * k for k in range(1, 5)]
    at = lambda n: ((n - 1) % 50 * 100.0, (n - 1) // 50 * 100.0)
    route = spark.createDataFrame([("a", 0.0, [at(n) for n in nodes])], "agent_id string, o_time_s double, pts array<struct<x: double, y: double>>")
    drive = simulation.simulate(route, 10.0, 0.5, 1.0, seed=3)
    kept = simulation.record(drive, 5.0, 0.0, 4.0, seed=3)
    assert rows(simulation.simulate(route, 10.0, 0.5, 1.0, seed=3)) == rows(drive) and simulation.mixed(drive, kept).select("type").distinct().count() == 2
    p = kept.withColumn("seq", (F.row_number().over(__import__("pyspark").sql.Window.partitionBy("agent_id").orderBy("t_s")) - 1).cast("bigint"))
    m = matching.match(p, roads, matching.Model(buffer_m=80.0, top_k=8, cutoff_m=500.0)).orderBy("seq").collect()
    on = {frozenset(e) for e in zip(nodes, nodes[1:])}
    assert len(m) == p.count() and sum(frozenset((r["from_node"], r["to_node"])) in on for r in m) >= 0.9 * len(m)
