import json

import numpy as np

from tests.conftest import two_way_lattice
from trackloom.functions.wkt import line_points, point_xy
from trackloom.operators import cleaning
from trackloom.sources import formats
from trackloom.streaming.kalman import smooth_stream, stream_sessions
from trackloom.streaming.matching import match_stream


def test_csv_with_mark_and_geojson(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffagent_id,lng\na,1.5\n")
    assert formats.read_csv(spark, str(tmp_path / "a.csv")).columns == ["agent_id", "lng"]
    lines = spark.createDataFrame([(1, "x", [(0.0, 0.0), (1.0, 2.0)]), (2, 'q"', [(3.0, 3.0)])], "link_id bigint, name string, pts array<struct<x: double, y: double>>")
    made = [json.loads(r["value"]) for r in formats.geojson_lines(lines, "pts", ["link_id", "name"]).collect()]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    got = formats.read_geojson(spark, str(tmp_path / "b.json"), "link_id bigint, name string").where("kind = 'LineString'")
    r = got.select("link_id", "name", formats.geojson_points(got["coordinates"]).alias("p")).first()
    assert (r["link_id"], r["name"], [tuple(p) for p in r["p"]]) == (1, "x", [(0.0, 0.0), (1.0, 2.0)])


def test_wkt_and_way_points(spark):
    df = spark.createDataFrame([("POINT (1.5 -2e1)",), ("LINESTRING (0 0, 1 2 7, 3 4)",), ("",), (None,), ("POINT EMPTY",)], "g string")
    got = df.select(point_xy(df["g"]).alias("p"), line_points(df["g"]).alias("l")).collect()
    assert tuple(got[0]["p"]) == (1.5, -20.0) and [tuple(p) for p in got[1]["l"]] == [(0, 0), (1, 2), (3, 4)] and all(r["p"] is None and r["l"] is None for r in got[2:])
    w = spark.createDataFrame([("1,2; 3 , 4;;x,1",), (None,)], "t string")
    assert [None if r[0] is None else [tuple(p) for p in r[0]] for r in w.select(formats.way_points(w["t"])).collect()] == [[(1, 2), (3, 4)], None]


def test_routes(spark, tmp_path):
    step = {"polyline": "1,2;1,2;3,4", "road_name": "r", "cost": {"duration": "5", "tolls": "0"}}
    (tmp_path / "r.json").write_text(json.dumps({"od_id": 1, "route": {"paths": [{"steps": [step, step | {"polyline": "9,9"}]}]}}) + "\n{broken\n")
    got = formats.route_paths(formats.read_routes(spark, str(tmp_path / "r.json"))).collect()
    assert len(got) == 1 and got[0]["duration"] == 5.0 and [tuple(p) for p in got[0]["pts"]] == [(1, 2), (3, 4)]


NET = """<net><location netOffset="1,2" origBoundary="" projParameter="+proj=utm"/>
<edge id="e" from="a" to="b" priority="1"><lane id="e_0" index="0" speed="13.9" length="10" shape="0,0 10,0"/><lane id="e_1" index="1" speed="13.9" length="10" shape="0,3 10,3"/></edge>
<edge id=":j" function="internal"><lane id=":j_0" index="0" speed="5" length="1" shape="0,0 1,1"/></edge>
<junction id="a" type="priority" x="0" y="0" shape="0,0 1,1 1,0"/><connection from="e" to="f" fromLane="0" toLane="0" via=":j_0" dir="s"/></net>"""


def test_network_files(spark, tmp_path):
    (tmp_path / "n.net.xml").write_text(NET)
    net = formats.read_net(spark, str(tmp_path / "n.net.xml"))
    assert net["lanes"].count() == 3 and net["junctions"].count() == 1 and net["connections"].first()["via"] == ":j_0" and net["location"].first()["net_offset"] == "1,2"
    mid = formats.centre_lines(net["lanes"].where("function = 'normal'")).collect()
    assert [tuple(p) for p in mid[0]["pts"]] == [(0, 3), (10, 3)]
    m = spark.createDataFrame([("a&", 0, 5.0, 7, 1, 2), ("a&", 1, 6.0, 7, 1, 2), ("a&", 2, 7.0, 8, 2, 3), ("b", 0, 4.0, 9, 3, 4)], "agent_id string, seq bigint, t_s double, link bigint, from_node bigint, to_node bigint")
    assert [r["value"] for r in formats.route_xml(formats.flows(m)).collect()] == ['<vehicle id="b" depart="0.0"><route edges="9"/></vehicle>', '<vehicle id="a&amp;" depart="1.0"><route edges="7 8"/></vehicle>']
    assert formats.write_bookmarks(str(tmp_path / "b.xml"), spark.createDataFrame([("p", 1.0, 2.0)], "name string, lng double, lat double"), "g") == 1 and "p" in (tmp_path / "b.xml").read_text()


def run(stream, folder):
    """One batch of all that is there; state goes on from the batch before. Time-outs would keep other triggers busy."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(once=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return str(folder / "out")


def test_streamed_filter_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(a, i, float(i * 10), float(i * 5 + rng.normal()), float(rng.normal())) for a in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(data, "agent_id string, seq bigint, t_s double, x_m double, y_m double")
    for k in range(2):
        df.where(f"seq >= {k * 20} and seq < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run(smooth_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 0.5, 3.0), tmp_path)
    got = {(r["agent_id"], r["t_s"]): (r["x_m"], r["y_m"]) for r in spark.read.parquet(out).collect()}
    want = {(r["agent_id"], r["t_s"]): (r["x_m"], r["y_m"]) for r in cleaning.kalman_smooth(df, 0.5, 3.0).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_streamed_sessions(spark, tmp_path):
    df = spark.sql("select 'a' agent_id, timestamp_seconds(t) ts from values (0), (1800), (3601), (90000), (990000) as v(t)")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    last = spark.sql("select 'a' agent_id, timestamp_seconds(2000000) ts")
    out = run(stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))), tmp_path)
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    out = run(stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))), tmp_path)
    assert sorted(r["n_events"] for r in spark.read.parquet(out).collect())[-1] == 2


def test_streamed_matching(spark, tmp_path):
    from trackloom.operators.matching import Model, match

    df = spark.createDataFrame([("a", k, float(k * 10), 30.0 * k, 103.0 if k < 8 else 103.0 + 30 * (k - 7)) for k in range(12)], "agent_id string, seq bigint, t_s double, x_m double, y_m double")
    m = Model(buffer_m=60.0, top_k=6, cutoff_m=400.0)
    roads = two_way_lattice(spark).where("from_node <= 400 and to_node <= 400")
    for k in range(2):
        df.where(f"seq >= {k * 6} and seq < {k * 6 + 6}").drop("seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
        run(match_stream(spark.readStream.schema(df.drop("seq").schema).parquet(str(tmp_path / "m")), roads, m), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["t_s"] for r in got if not r["revised"]) == [10.0 * k for k in range(12)] and sorted(r["t_s"] for r in got if r["revised"]) == [30.0, 40.0, 50.0]
    last = {r["t_s"]: r["link"] for r in sorted(got, key=lambda r: r["revised"])}
    assert last == {r["seq"] * 10.0: r["link"] for r in match(df, roads, m).collect()}
