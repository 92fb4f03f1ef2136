import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trackloom.operators import lines, network, topology

LINKS = "link_id bigint, from_node bigint, to_node bigint, dir int, length double, road_name string, pts array<struct<x: double, y: double>>"


def links_of(spark, data):
    """(link_id, from, to, dir, name, [(x, y), ...]) as a layer with measured lengths."""
    out = []
    for i, f, t, d, name, pts in data:
        m = sum(math.dist(p, q) for p, q in zip(pts, pts[1:]))
        out.append((i, f, t, d, m, name, [(float(x), float(y)) for x, y in pts]))
    return spark.createDataFrame(out, LINKS)


def nodes_of(spark, data):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in data.items()], "node_id bigint, x double, y double")


def pts(r, name="pts"):
    return [(p["x"], p["y"]) for p in r[name]]


def total(df):
    return df.agg(F.sum("length")).first()[0]


@pytest.fixture(scope="module")
def bent(spark):
    return links_of(spark, [(1, 1, 2, 1, "a", [(0, 0), (100, 0), (100, 50)]), (2, 2, 3, 0, "a", [(100, 50), (100, 250)])]), nodes_of(spark, {1: (0, 0), 2: (100, 50), 3: (100, 250)})


def test_pieces_of_a_line(spark, bent):
    cut = spark.createDataFrame([(1, 0, 0.0, 40.0), (1, 1, 40.0, 120.0), (1, 2, 120.0, 999.0), (9, 0, 0.0, 1.0)], "link_id bigint, piece int, from_m double, to_m double")
    got = {r["piece"]: pts(r) for r in lines.line_pieces(bent[0], cut).collect()}
    assert got == {0: [(0, 0), (40, 0)], 1: [(40, 0), (100, 0), (100, 20)], 2: [(100, 20), (100, 50)]}


def test_division_keeps_lengths_and_connects(spark, bent):
    l, n = topology.divide(*bent, 60.0, 20.0)
    got = {r["link_id"]: r for r in l.collect()}
    assert sorted((r["from_node"], r["to_node"], round(r["length"])) for r in got.values()) == [(1, 4, 60), (2, 5, 60), (4, 2, 90), (5, 6, 60), (6, 3, 80)] or len(got) == 6
    assert math.isclose(total(l), 350) and not topology.checked_layers(l, n).collect() and {r["parent_link"] for r in got.values()} == {1, 2}
    assert len({r["link_id"] for r in got.values()}) == len(got) == l.count() and got[1]["from_node"] == 1 and got[2]["from_node"] == 2
    where = {r["node_id"]: (r["x"], r["y"]) for r in n.collect()}
    assert all(pts(r)[0] == where[r["from_node"]] and pts(r)[-1] == where[r["to_node"]] for r in got.values())


def test_breaks_at_points_and_free_ends(spark, bent):
    p = spark.createDataFrame([(1, 50.0, 3.0), (2, 99.0, 150.0), (3, 0.2, 0.0), (4, 500.0, 500.0), (5, 50.0, -3.0)], "point_id bigint, x double, y double")
    l, n = topology.split_at_points(*bent, p, 10.0)
    assert l.count() == 4 and n.count() == 5 and math.isclose(total(l), 350)
    # a node beside a link breaks it; one beside its end is joined to that end
    more = bent[0].unionByName(links_of(spark, [(3, 4, 5, 0, "b", [(50, -80), (50, -1)]), (4, 6, 7, 0, "b", [(100.2, 250), (300, 250)])]))
    at = bent[1].unionByName(nodes_of(spark, {4: (50, -80), 5: (50, -1), 6: (100.2, 250), 7: (300, 250)}))
    l, n = topology.repair_connections(more, at, 2.0)
    got = {(r["from_node"], r["to_node"]) for r in l.collect()}
    assert got == {(1, 5), (5, 2), (2, 3), (4, 5), (3, 7)} and 6 not in {r["node_id"] for r in n.collect()}


def test_loops_and_doubles(spark):
    l = links_of(spark, [(1, 1, 1, 0, "a", [(0, 0), (30, 0), (30, 30), (0, 0)]), (2, 1, 2, 0, "a", [(0, 0), (9, 0)]), (3, 1, 2, 0, "a", [(0, 0), (5, 5), (9, 0)])])
    got, n = topology.split_loops(l, nodes_of(spark, {1: (0, 0), 2: (9, 0)}))
    ends = [(r["from_node"], r["to_node"]) for r in got.collect()]
    assert len(ends) == len(set(ends)) == 6 and all(a != b for a, b in ends) and n.count() == 5


def chain(spark):
    """Three links in a row with one name, one with another, and a one-way part; turned about at random."""
    return links_of(spark, [(5, 1, 2, 0, "a", [(0, 0), (100, 0)]), (3, 3, 2, 0, "a", [(200, 5), (100, 0)]), (4, 3, 4, 0, "a", [(200, 5), (300, 0)]), (6, 4, 5, 0, "b", [(300, 0), (400, 0)]), (7, 5, 6, 1, "b", [(400, 0), (500, 0)]), (8, 6, 7, 1, "b", [(500, 0), (500, 90)])])


def test_chains_are_merged_within_limits(spark):
    got = {r["link_id"]: r for r in topology.merge_chains(chain(spark)).collect()}
    assert set(got) == {3, 6, 7, 8}  # names, directions and the turn part the rest
    assert pts(got[3]) in ([(0, 0), (100, 0), (200, 5), (300, 0)], [(300, 0), (200, 5), (100, 0), (0, 0)]) and {got[3]["from_node"], got[3]["to_node"]} == {1, 4}
    assert pts(topology.merge_chains(chain(spark), limits=topology.Limits((), 100.0)).where("link_id = 7").first()) == [(400, 0), (500, 0), (500, 90)]
    assert math.isclose(total(topology.merge_chains(chain(spark), limits=topology.Limits((), 100.0, 250.0, 0.0))), total(chain(spark)))
    assert topology.merge_chains(chain(spark), limits=topology.Limits((), 100.0, 250.0, 0.0)).agg(F.max("length")).first()[0] <= 250
    assert not topology.merge_chains(chain(spark).limit(0)).collect()


def test_ring_and_clash(spark):
    ring = links_of(spark, [(1, 1, 2, 1, "a", [(0, 0), (9, 0)]), (2, 2, 3, 1, "a", [(9, 0), (9, 9)]), (3, 3, 1, 1, "a", [(9, 9), (0, 0)])])
    assert topology.merge_chains(ring, limits=topology.Limits((), 180.0)).count() == 3  # it would become a loop
    two = links_of(spark, [(1, 1, 2, 0, "a", [(0, 0), (5, 0)]), (2, 2, 3, 0, "a", [(5, 0), (10, 0)]), (3, 1, 3, 0, "a", [(0, 0), (5, 9), (10, 0)]), (4, 3, 4, 0, "a", [(10, 0), (20, 0)]), (5, 0, 1, 0, "a", [(-9, 0), (0, 0)])])
    assert topology.merge_chains(two).count() == 5  # its ends are those of another link


def test_short_links_join_their_neighbours(spark):
    l = links_of(spark, [(1, 1, 2, 0, "a", [(0, 0), (100, 0)]), (2, 2, 3, 0, "a", [(100, 0), (110, 0)]), (3, 3, 4, 0, "b", [(110, 0), (300, 0)])])
    assert rows(topology.merge_short(l).select("link_id", "from_node", "to_node", "length")) == [(1, 1, 3, 110.0), (3, 3, 4, 190.0)]


def test_overlaps(spark):
    l = links_of(spark, [(1, 1, 2, 1, "a", [(0, 0), (100, 0)]), (2, 3, 4, 1, "a", [(95, 3), (2, 3)]), (3, 5, 6, 1, "a", [(0, 60), (100, 60)]), (4, 2, 7, 1, "a", [(100, 0), (100, 80)])])
    assert rows(topology.drop_overlaps(l).select("link_id", "dir")) == [(1, 0), (3, 1), (4, 1)]
    c = {(r[0], r[1]): r for r in lines.coverage(l, l.select(F.col("link_id").alias("other"), "pts"), 8.0, 1.0).collect()}
    assert c[2, 1]["share"] == 1 and c[2, 1]["cosine"] < -0.99 and abs(c[4, 1]["share"] - 0.1) < 0.02 and (1, 3) not in c


def test_double_links(spark):
    l = links_of(spark, [(1, 1, 2, 1, "a", [(0, 0), (10, 0)]), (2, 2, 1, 1, "a", [(10, 0), (5, 4), (0, 0)]), (3, 1, 2, 1, "a", [(0, 0), (10, 0)]), (4, 2, 3, 1, "a", [(10, 0), (20, 0)])])
    assert rows(network.merge_double(l, by_length=False).select("link_id", "dir")) == [(1, 0), (4, 1)]
    assert rows(network.merge_double(l).select("link_id", "dir")) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_lines_that_meet_themselves(spark):
    l = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 10.0), (5.0, -5.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (3, [(0.0, 0.0), (0.0, 0.0), (3.0, 0.0)]), (4, [(1.0, 1.0), (1.0, 1.0)])], "link_id bigint, pts array<struct<x: double, y: double>>")
    got = {(r["link_id"], r["piece"]): pts(r) for r in lines.simple_lines(l).collect()}
    assert got[1, 0] == [(0, 0), (5, 0)] and got[1, 2] == [(5, 0), (5, -5)] and len([k for k in got if k[0] == 1]) == 3
    assert len([k for k in got if k[0] == 2]) == 2 and got[3, 0] == [(0, 0), (3, 0)] and not [k for k in got if k[0] == 4]


def test_network_from_driven_lines(spark):
    road = [(x, 0) for x in range(0, 501, 50)]
    paths = spark.createDataFrame(
        [(1, "main", [(float(x), float(y)) for x, y in road]), (2, "main", [(float(x), float(y)) for x, y in road[::-1]]), (3, "side", [(250.0, 0.0), (250.0, 200.0)]), (4, "main", [(300.5, 0.8), (350.0, 0.5), (350.0, 0.5)])],
        "path_id bigint, road_name string, pts array<struct<x: double, y: double>>",
    )
    l, n = topology.network_from_paths(paths, topology.Build(gap_m=2.0))
    got = [(r["road_name"], r["dir"], round(r["length"])) for r in l.collect()]
    assert sorted(got) == [("main", 0, 250), ("main", 0, 250), ("side", 1, 200)] and n.count() == 4 and not topology.checked_layers(l, n).collect()
    # a new road is added, one that is there already isn't
    more = spark.createDataFrame([(1, "main", [(0.0, 1.0), (240.0, 1.0)]), (2, "new", [(500.0, 0.0), (500.0, 300.0)])], "path_id bigint, road_name string, pts array<struct<x: double, y: double>>")
    l2, n2 = topology.incremented(l, n, more, p=topology.Build(gap_m=2.0))
    assert sorted((r["road_name"], round(r["length"])) for r in l2.collect()) == [("main", 250), ("main", 250), ("new", 300), ("side", 200)] and n2.count() == 5 and not topology.checked_layers(l2, n2).collect()


def test_edits_and_numbers(spark, bent):
    l, n = topology.renumber(*bent, 11, 101)
    assert rows(l.select("link_id", "from_node", "to_node")) == [(11, 101, 102), (12, 102, 103)]
    both = topology.merged_networks(bent, bent)
    assert both[0].count() == 4 and both[1].count() == 6 and not topology.checked_layers(*both).collect()
    changed = topology.modified(bent[0], spark.createDataFrame([(2, None)], "link_id bigint, road_name string"), "link_id")
    assert rows(changed.select("link_id", "road_name")) == [(1, "a"), (2, None)] and changed.columns == bent[0].columns
    assert rows(topology.appended(bent[1], bent[1], "node_id").select("node_id")) == [(k,) for k in range(1, 7)]
    assert topology.removed(bent[0], bent[0].where("link_id = 1"), "link_id").count() == 1 and topology.without_short(bent[0], 160.0).count() == 1
    assert rows(topology.links_at(bent[0], bent[1].where("node_id = 2")).select("link_id")) == [(2,)]
    regions = spark.createDataFrame([(k,) for k in (1, 1, 1, 2, 2, 3, 4)], "region_id int")
    assert rows(topology.packed_regions(regions, "region_id", 3).groupBy("region_id", "bin").count()) == [(1, 0, 3), (2, 1, 2), (3, 1, 1), (4, 2, 1)]


def test_links_beside_a_way(spark, bent):
    way = spark.createDataFrame([("a", 0, -50.0, 5.0), ("a", 1, 60.0, 5.0), ("b", 0, 90.0, 200.0), ("b", 1, 120.0, 201.0), ("c", 0, 400.0, 0.0)], "agent_id string, seq bigint, x_m double, y_m double")
    assert rows(lines.within_route(bent[0], way, 6.0)) == [("a", 1), ("b", 2)]


def test_near_groups_against_pairs(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 60, (150, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id bigint, x double, y double")
    loops = df.select(F.col("id").alias("a"), F.col("id").alias("b"))
    want = rows(network.components(network.near_pairs(df, 4.0).select("a", "b").unionByName(loops)))
    assert rows(network.near_groups(df, 4.0)) == want


def test_lines_are_spread_along_their_course(spark):
    rng = np.random.default_rng(1)
    ends = rng.uniform(0, 300, (40, 4))
    ends[0], ends[1], ends[2] = (0, 0, 300, 300), (90, 0, 90, 300), (60, 30, 60, 30)
    l = spark.createDataFrame([(i, [(float(a), float(b)), (float(c), float(d))]) for i, (a, b, c, d) in enumerate(ends)], "link_id bigint, pts array<struct<x: double, y: double>>")
    xy = rng.uniform(-5, 305, (400, 2))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id bigint, x double, y double")
    a, u = ends[:, :2], ends[:, 2:] - ends[:, :2]
    n = (u * u).sum(axis=1)
    f = np.clip(((xy[:, None] - a) * u).sum(axis=2) / np.where(n > 0, n, 1), 0, 1)
    d = np.hypot(*(a + f[..., None] * u - xy[:, None]).transpose(2, 0, 1))
    assert rows(lines.nearest_on_lines(p, l, 3.0).select("point_id", "link_id")) == sorted(((int(i), int(k)) for i, k in zip(*np.nonzero(d <= 3))), key=repr)
    # a diagonal of 424 m goes through some 100 columns of 3 m, not over their square
    assert network.along_cells(network.segments(l.where("link_id = 0")), 3.0, 3.0).count() < 1000


def test_exploded_sides_are_not_broadcast(spark):
    from trackloom.plans.joins import cell_join

    left = spark.range(1000).select(F.col("id").alias("k"))
    right = spark.range(2).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"), "id")
    assert cell_join(left, right, ["k"]).count() == 200
    over = cell_join(left, right, ["k"], 150)
    assert over.count() == 200 and "Broadcast" not in over._jdf.queryExecution().executedPlan().toString()
