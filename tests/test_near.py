import math

import numpy as np

from tests.conftest import rows
from trackloom.operators.near import containing_regions, within_distance
from trackloom.plans import joins

R = 6_371_008.8


def far(x1, y1, x2, y2):
    a, b, c, d = (np.radians(v) for v in (x1, y1, x2, y2))
    h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def points(spark, xy, name):
    return spark.createDataFrame([(i, float(x) if x is not None else None, float(y) if y is not None else None) for i, (x, y) in enumerate(xy)], f"{name} bigint, lng double, lat double")


def test_pairs_everywhere_on_the_globe(spark):
    rng = np.random.default_rng(1)
    places = [(98.4, 36.3), (180, 0), (-179.9995, -45), (0, 89.9999), (30, -89.9995), (12, 78)]
    p = [(x + rng.normal(0, 3e-4) / max(math.cos(math.radians(y)), 1e-3), y + rng.normal(0, 3e-4)) for x, y in places for _ in range(60)]
    q = [(x + rng.normal(0, 3e-4) / max(math.cos(math.radians(y)), 1e-3), y + rng.normal(0, 3e-4)) for x, y in places for _ in range(40)]
    want = {(i, j) for i, a in enumerate(p) for j, b in enumerate(q) if far(*a, *b) <= 40}
    left, right = points(spark, [*p, (None, 1), (float("inf"), 1), (999, 999)], "ping_id"), points(spark, q, "target_id")
    assert {(r[0], r[1]) for r in within_distance(left, right, 40.0).select("ping_id", "target_id").collect()} == want and len(want) > 100


def test_no_distance_to_nowhere(spark):
    from pyspark.sql import functions as F

    from trackloom.functions.geo import great_circle_m

    df = spark.createDataFrame([(1.0, 2.0, None, 3.0), (1.0, 2.0, 1.0, 2.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(great_circle_m(*map(F.col, "abcd"))).collect()] == [None, 0.0]


def test_hot_cells_are_salted(spark, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)], "cell bigint, v bigint")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(1, 30)] + [(1, "again")], "cell bigint, w string")
    want = rows(left.join(right, ["cell"]))
    monkeypatch.setattr(joins, "HOT_ROWS", 30)
    assert rows(joins.cell_join(left, right, ["cell"], broadcast_rows=5).select("cell", "v", "w")) == want


def test_wide_rows_are_not_broadcast(spark):
    few = spark.createDataFrame([(1, ["x" * 1000] * 50, [1.0] * 100)], "cell bigint, w array<string>, v array<double>")
    assert joins.small(few) and not joins.small(few, size=50_000) and joins.small(few.select("v", "cell"), size=50_000)


def test_regions_with_holes_pieces_and_no_geometry(spark):
    shapes = {
        1: "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))",
        2: "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 9 5, 7 9, 5 5), (6.5 6, 7.5 6, 7 7, 6.5 6)))",
        3: "POLYGON EMPTY", 4: None, 5: "", 6: "POLYGON ((3 3, 3.0001 3, 3.0001 3.0001, 3 3.0001))", 7: "POINT (1 1)",
    }
    regions = spark.createDataFrame(list(shapes.items()), "region_id bigint, geometry string")
    rng = np.random.default_rng(2)
    xy = [*rng.uniform(-1, 11, (800, 2)), (3.00005, 3.00005), (5, 5.5), (7, 6.2)]
    p = points(spark, [*xy, (None, 1)], "ping_id")

    def inside(ring, x, y):
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    rings = {1: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]], 2: [[(0, 0), (2, 0), (2, 2), (0, 2)], [(5, 5), (9, 5), (7, 9)], [(6.5, 6), (7.5, 6), (7, 7)]], 6: [[(3, 3), (3.0001, 3), (3.0001, 3.0001), (3, 3.0001)]]}
    want = {(i, k) for i, (x, y) in enumerate(xy) for k, rs in rings.items() if sum(inside(r, x, y) for r in rs) % 2 == 1}
    assert {(r[0], r[1]) for r in containing_regions(p, regions).collect()} == want
    assert not containing_regions(p, regions.where("region_id in (3, 4, 5)")).collect() and not containing_regions(p.limit(0), regions).collect()
    assert not within_distance(p.limit(0), p.withColumnRenamed("ping_id", "target_id"), 5.0).collect()
