import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_matching import POINTS, cross, points
from trackloom.functions import sql
from trackloom.operators import grids, matching, simulation, trips
from trackloom.sources import formats


def test_sql_functions(spark):
    assert set(sql.register(spark)) == {*sql.SCALARS, *sql.TABLES}
    r = spark.sql("SELECT great_circle_m(0D, 0D, 1D, 0D) a, plane_distance_m(0D, 0D, 3D, 4D) b, north_angle_deg(0D, 0D, 1D, 0D) c, vector_angle_deg(1D, 0D, 0D, 2D) d, utm_zone(108.97D) e, grid_cell_s(-1, 300) f, line_length_m(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D))) g, vector_angle_deg(0D, 0D, 1D, 1D) h").first()
    assert (round(r["a"]), r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == (111195, 5, 90, 90, 49, -300, 5, 0)
    got = spark.sql("SELECT k, t_s, x_m FROM VALUES (0D, 0D, 0D, 30D, 300D, 0D) v(a, b, c, d, e, f), LATERAL densified(a, b, c, d, e, f, 120D)")
    assert rows(got) == [(0, 0.0, 0.0), (1, 10.0, 100.0), (2, 20.0, 200.0)]
    assert rows(spark.sql("SELECT * FROM fishnet(0D, 0D, 5000D, 3000D, 2000D)")) == rows(grids.fishnet(spark, 0.0, 0.0, 5000.0, 3000.0, 2000.0))
    want = spark.range(1).select(F.posexplode(grids.bezier(F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(0.0), 0.25, 5))).select("pos", "col.x", "col.y")
    assert rows(spark.sql("SELECT * FROM curve(0D, 0D, 8D, 0D, 0.25D, 5)")) == rows(want)


def shp(shapes):
    """A shape file of points (tuples) and lines or polygons (lists of parts)."""
    body = b""
    for k, s in enumerate(shapes, 1):
        if s is None:
            rec = struct.pack("<i", 0)
        elif isinstance(s, tuple):
            rec = struct.pack("<idd", 1, *s)
        else:
            flat = [p for part in s for p in part]
            first = np.cumsum([0, *map(len, s)])[:-1]
            rec = struct.pack("<i4d", 3, 0, 0, 0, 0) + struct.pack("<ii", len(s), len(flat)) + struct.pack(f"<{len(s)}i", *first) + b"".join(struct.pack("<dd", *p) for p in flat)
        body += struct.pack(">ii", k, len(rec) // 2) + rec
    return b"\0" * 100 + body


def test_shape_files(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp([(1.0, 2.0), None, [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0), (7.0, 5.0)]]]))
    got = formats.read_shapes(spark, str(tmp_path)).orderBy("record").collect()
    assert [(r["kind"], [[(p["x"], p["y"]) for p in part] for part in r["parts"]]) for r in got] == [(1, [[(1, 2)]]), (0, []), (3, [[(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 5)]])]


def test_routes_keep_their_loops(spark, tmp_path):
    step = lambda line, name, t: {"polyline": line, "road_name": name, "cost": {"duration": t, "tolls": "0"}}
    route = {"od_id": 1, "route": {"paths": [{"steps": [step("1,1;1,1", "", "1"), step("0,0;0.01,0;0,0", "a", "9"), step("0,0;0,0.01", "b", "5"), step("0,0.02;0,0.03", "", "4")]}]}}
    (tmp_path / "r.json").write_text(json.dumps(route) + "\nnot json\n")
    steps = formats.route_paths(formats.read_routes(spark, str(tmp_path / "r.json")))
    assert [len(r["pts"]) for r in steps.orderBy("seq").collect()] == [3, 2, 2]
    got = formats.joined_steps(steps).orderBy("seq").collect()
    assert [(r["seq"], r["kind"], r["road_name"]) for r in got] == [(0, "step", "a"), (1, "step", "b"), (2, "turn", ""), (3, "step", "")]
    assert [r["road_name"] for r in formats.joined_steps(steps, trim=True).orderBy("seq").collect()] == ["a", "b"]
    (tmp_path / "t.json").write_text('{"request_time": "2024-01-01T00:00:00Z", "roads": [{"name": "a", "speed": 30.5, "status": 2, "polyline": "1,2;3,4"}]}\nbad\n')
    assert [(r["name"], r["speed"], len(r["pts"])) for r in formats.read_traffic(spark, str(tmp_path / "t.json")).collect()] == [("a", 30.5, 2)]
    assert rows(formats.answered(spark.createDataFrame([(1,), (2,)], "od_id bigint"), steps)) == [(2,)]


def test_plain_files_and_lanes(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<nodes><node id="a" x="500000.0" y="4000000.0"/><node id="b" x="500100.0" y="4000000.0" type="priority"/></nodes>')
    (tmp_path / "e.xml").write_text('<edges><edge id="1" from="a" to="b" numLanes="2" speed="13.9"/><edge id="2" from="b" to="a" shape="500100,4000000 500050,4000050 500000,4000000"/></edges>')
    plain = formats.read_plain(spark, str(tmp_path / "n.xml"), str(tmp_path / "e.xml"))
    assert [(r["edge_id"], r["lanes"], len(r["pts"])) for r in plain["edges"].orderBy("edge_id").collect()] == [("1", 2, 2), ("2", 1, 3)]
    moved = formats.moved_plain(plain, (0.0, 0.0), 49)
    assert math.isclose(moved["nodes"].where("node_id = 'a'").first()["x"], 111.0, abs_tol=1e-9) and moved["edges"].count() == 2
    lanes = spark.createDataFrame([("e", "e_0", 0, 4.0, [(0.0, 0.0), (10.0, 0.0)]), ("f", "f_0", 0, 4.0, [(12.0, 1.0), (20.0, 1.0)])], "edge_id string, lane_id string, lane_index int, width double, pts array<struct<x: double, y: double>>")
    ring = [(p["x"], p["y"]) for p in formats.lane_polygons(lanes).where("lane_id = 'e_0'").first()["pts"]]
    assert ring == [(0, -2), (10, -2), (10, 2), (0, 2), (0, -2)]
    net = {"lanes": lanes, "connections": spark.createDataFrame([("e", "f", 0, 0, None), ("e", "gone", 0, 0, None)], "from_edge string, to_edge string, from_lane int, to_lane int, via string")}
    (c,) = formats.connectors(net).collect()
    assert [(p["x"], p["y"]) for p in c["pts"]] == [(10, 0), (12, 1)]
    assert formats.connection_xml(net["connections"]).first()["value"] == '<connection from="e" to="f" fromLane="0" toLane="0"/>'


def test_layers_maps_and_bookmarks(spark, tmp_path):
    p = points(spark, {1: [(20, 3), (60, 2), (150, 2)], 2: [(10, 1), (190, 1)]})
    m = matching.match(p, cross(spark), matching.Model(buffer_m=15.0))
    layers = formats.match_layers(m, p, cross(spark))
    assert {k: v.count() for k, v in layers.items()} == dict.fromkeys(("gps", "prj_p", "prj_l", "match_link", "heading_vec"), 5)
    assert [(round(q["x"], 6), round(q["y"], 6)) for q in layers["heading_vec"].where("agent_id = 1 and seq = 0").first()["pts"]] == [(20, 0), (30, 0)]
    formats.write_layers(layers, f"file://{tmp_path}/layers")
    assert json.loads(spark.read.text(f"file://{tmp_path}/layers/prj_l").first()["value"])["geometry"]["type"] == "LineString"
    formats.write_by_agent(m, f"file://{tmp_path}/by_agent")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/by_agent").where("agent_id = 1").count() == 3
    dots = formats.point_features(p, ["agent_id"], "x_m", "y_m", start=0, end=5)
    formats.write_map(str(tmp_path / "m.html"), {"dots": dots, "lines": formats.geojson_lines(layers["prj_l"], "pts", ["agent_id"])}, "a <b>")
    page = (tmp_path / "m.html").read_text()
    assert dots.count() == 2 and page.count('"Feature"') == 7 and "a &lt;b&gt;" in page
    with pytest.raises(ValueError):
        formats.write_map(str(tmp_path / "n.html"), {"dots": dots}, most_bytes=10)
    places = spark.createDataFrame([(f"p{k}", 1.0, 2.0) for k in range(20)], "name string, lng double, lat double")
    assert formats.write_bookmarks(str(tmp_path / "b.xml"), places, "g") == 20 and formats.write_bookmarks(str(tmp_path / "b.xml"), places, "g", append=True) == 20
    assert (tmp_path / "b.xml").read_text().count("<Bookmark ") == 40
    df, seen = formats.observed(p, "load")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 5


def test_grid_cells_in_polygons(spark):
    g = grids.fishnet(spark, 0.0, 0.0, 10.0, 10.0, 1.0)
    shapes = spark.createDataFrame([("POLYGON ((2.2 2.2, 7.8 2.2, 7.8 7.8, 2.2 7.8, 2.2 2.2), (3.9 3.9, 6.1 3.9, 6.1 6.1, 3.9 6.1, 3.9 3.9))",), (None,)], "geometry string")
    got = {(round(r["xmin"]), round(r["ymin"])) for r in grids.cells_in(g, shapes).collect()}
    assert got == {(x, y) for x in range(2, 8) for y in range(2, 8)} - {(x, y) for x in (4, 5) for y in (4, 5)}
    tri = spark.createDataFrame([("POLYGON ((0.5 0.5, 9.5 0.5, 9.5 9.5, 0.5 0.5))",)], "geometry string")
    assert {(round(r["xmin"]), round(r["ymin"])) for r in grids.cells_in(g, tri).collect()} == {(x, y) for x in range(10) for y in range(10) if y <= x}


def test_trips_and_od_in_one_call(spark):
    p = spark.createDataFrame([("a", k, k * 60 + (4000 if k > 9 else 0), 100.0 * k, 0.0) for k in range(20)], "agent_id string, seq bigint, t_s bigint, x_m double, y_m double")
    got = trips.od_by_gps(p).orderBy("od_id").collect()
    assert [(r["od_id"], r["trip_no"], r["o_x"], r["d_x"], r["hh"]) for r in got] == [(1, 1, 0, 900, 0), (2, 2, 1000, 1900, 1)]
    assert got[0]["way_points"].count(";") >= 3
    regions = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), (2, None)], "region_id bigint, geometry string")
    od = trips.random_od(spark, regions, 30, 20_000.0, seed=3).collect()
    assert len(od) == 30 and all(0 <= r["o_y"] <= r["o_x"] + 1e-9 <= 1.001 for r in od) and [tuple(r) for r in od] == [tuple(r) for r in trips.random_od(spark, regions, 30, 20_000.0, seed=3).collect()]
    assert not trips.random_od(spark, regions.where("region_id = 2"), 5, 1.0).collect()
    b = grids.bounds(spark.createDataFrame([([(0.0, 1.0), (4.0, 3.0)],)], "pts array<struct<x: double, y: double>>")).first()
    assert (b["min_x"], b["max_y"], b["mid_x"], b["mean_y"]) == (0, 3, 2, 2)


def test_routes_are_driven(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 100.0)], "f bigint, t bigint, length double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0, 100.0)], "node_id bigint, x double, y double")
    r = simulation.od_routes(edges, nodes, spark.createDataFrame([("v", 5.0, 1, 3), ("w", 0.0, 3, 1)], "agent_id string, o_time_s double, o bigint, d bigint")).collect()
    assert [(x["agent_id"], [(p["x"], p["y"]) for p in x["pts"]]) for x in r] == [("v", [(0, 0), (100, 0), (100, 100)])]
    drive = simulation.simulate(simulation.od_routes(edges, nodes, spark.createDataFrame([("v", 5.0, 1, 3)], "agent_id string, o_time_s double, o bigint, d bigint")))
    assert drive.count() > 10 and POINTS and simulation.random_routes(edges, nodes, 3, 2).count() <= 3
