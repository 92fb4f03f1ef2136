"""Layers, routes and simulator networks as DataFrames, and back to files."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import great_circle_m
from trackloom.functions.projection import from_utm
from trackloom.functions.wkt import line_points, point_xy
from trackloom.operators.cleaning import plane_distance
from trackloom.operators.lines import clean_points
from trackloom.operators.matching import link_parts


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is taken off."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row a feature: the named properties (a DDL schema), kind and coordinates (JSON text)."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def geojson_points(coordinates: Column) -> Column:
    """array<struct<x,y>> of the JSON coordinates of a line."""
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def links_from_wkt(df: DataFrame) -> DataFrame:
    return df.withColumn("pts", line_points(F.col("geometry")))


def nodes_from_wkt(df: DataFrame) -> DataFrame:
    return df.withColumn("p", point_xy(F.col("geometry"))).withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y")).drop("p")


def geojson_lines(df: DataFrame, pts: str, properties: list[str]) -> DataFrame:
    """value: one GeoJSON feature a row for ``write.text``; points are points, more are lines."""
    xy = F.transform(pts, lambda p: F.array(p["x"], p["y"]))
    text = F.when(F.size(pts) == 1, F.to_json(F.struct(F.lit("Point").alias("type"), xy[0].alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates"))))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), text, F.lit("}")).alias("value"))


ROUTE = "od_id bigint, route struct<paths: array<struct<steps: array<struct<polyline: string, road_name: string, cost: struct<duration: string, tolls: string>>>>>>"


def read_routes(spark: SparkSession, path: str, text: bool = True) -> DataFrame:
    """Answers of a route service, one JSON object a line; unreadable lines are left out."""
    raw = spark.read.text(path) if text else spark.read.parquet(path)
    return raw.select(F.from_json("value", ROUTE).alias("r")).where("r.od_id is not null").select("r.*")


def route_paths(routes: DataFrame, least_m: float = 0.1) -> DataFrame:
    """od_id, path_no, seq, road_name, duration, tolls, pts of every step; steps without two different points are left out.

    Only points that repeat the one before are taken off, so loops and ways there and back stay.
    """
    step = routes.select("od_id", F.posexplode("route.paths").alias("path_no", "p")).select("od_id", "path_no", F.posexplode("p.steps").alias("seq", "s"))
    pts = F.transform(F.split("s.polyline", ";"), lambda q: F.struct(F.split(q, ",")[0].try_cast("double").alias("x"), F.try_element_at(F.split(q, ","), F.lit(2)).try_cast("double").alias("y")))
    return step.select("od_id", "path_no", "seq", F.coalesce("s.road_name", F.lit("")).alias("road_name"), F.col("s.cost.duration").try_cast("double").alias("duration"), F.col("s.cost.tolls").try_cast("double").alias("tolls"), clean_points(pts).alias("pts")).where(F.size("pts") >= 2)


def joined_steps(steps: DataFrame, turn_m: float = 0.5, least_m: float = 0.1, trim: bool = False) -> DataFrame:
    """Steps of ``route_paths`` with what lies between them, in order: adds kind, 'step' or 'turn', and numbers seq anew.

    Steps of at most ``least_m`` are dropped; where a step begins ``turn_m`` or more
    from the end of the one before, a straight turn of no duration joins them.
    With ``trim`` unnamed steps before the first and behind the last named one are
    left out.  Coordinates are degrees, distances great circles.
    """
    step = lambda p, q: great_circle_m(p["x"], p["y"], q["x"], q["y"])
    n = F.size("pts") - 1
    length = F.aggregate(F.zip_with(F.slice("pts", 1, n), F.slice("pts", 2, n), step), F.lit(0.0), lambda a, d: a + d)
    w = Window.partitionBy("od_id", "path_no").orderBy("seq")
    s = steps.where(length > least_m)
    if trim:
        named = F.when(F.col("road_name") != "", F.col("seq"))
        whole = Window.partitionBy("od_id", "path_no")
        s = s.withColumn("_a", F.min(named).over(whole)).withColumn("_z", F.max(named).over(whole)).where("_a is null or seq between _a and _z").drop("_a", "_z")
    s = s.withColumn("_end", F.lag(F.element_at("pts", -1)).over(w)).withColumn("kind", F.lit("step"))
    gap = great_circle_m(F.col("_end.x"), F.col("_end.y"), F.col("pts")[0]["x"], F.col("pts")[0]["y"])
    turns = s.where(gap >= turn_m).select("od_id", "path_no", (F.col("seq") - 0.5).alias("seq"), F.col("road_name"), F.lit(0.0).alias("duration"), F.lit(0.0).alias("tolls"), F.array(F.col("_end"), F.col("pts")[0]).alias("pts"), F.lit("turn").alias("kind"))
    both = s.select("od_id", "path_no", F.col("seq").cast("double").alias("seq"), "road_name", "duration", "tolls", "pts", "kind").unionByName(turns)
    return both.withColumn("seq", F.row_number().over(w) - 1)


#: One observation of a traffic service a line, as it is kept: where and when, and its roads.
TRAFFIC = "request_time timestamp, x1 double, y1 double, x2 double, y2 double, roads array<struct<name: string, speed: double, status: int, polyline: string>>"


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """request_time, name, speed, status, pts of every road in answers of a traffic service, one JSON object a line; unreadable lines are left out.

    Requests themselves aren't made here: this is the contract of the lines they are kept in.
    """
    r = spark.read.text(path).select(F.from_json("value", TRAFFIC).alias("r")).where("r.request_time is not null").select("r.request_time", F.explode("r.roads").alias("d"))
    return r.select("request_time", "d.name", "d.speed", "d.status", way_points(F.col("d.polyline")).alias("pts"))


def answered(requests: DataFrame, answers: DataFrame, key: str = "od_id") -> DataFrame:
    """Requests that have no answer yet, so that a stopped collection can go on."""
    return requests.join(answers.select(key).distinct(), key, "left_anti")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """path, record, kind (1 point, 3 line, 5 polygon), parts array<array<struct<x,y>>> of shape files.

    Files are read whole by executors, one file a row; Z and M values are left
    out; records without a shape have no parts.
    """

    def shapes(content: bytes) -> list[tuple]:
        out, at = [], 100
        while at + 12 <= len(content):
            number, words = struct.unpack(">ii", content[at : at + 8])
            body = content[at + 8 : at + 8 + 2 * words]
            kind = struct.unpack("<i", body[:4])[0]
            parts: list = []
            if kind % 10 == 1 and kind:
                parts = [[struct.unpack("<dd", body[4:20])]]
            elif kind % 10 in (3, 5):
                n, m = struct.unpack("<ii", body[36:44])
                first = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), m]
                flat = struct.unpack(f"<{2 * m}d", body[44 + 4 * n : 44 + 4 * n + 16 * m])
                pts = list(zip(flat[::2], flat[1::2]))
                parts = [pts[i:j] for i, j in zip(first, first[1:])]
            out.append((number, kind % 10, [[{"x": x, "y": y} for x, y in p] for p in parts]))
            at += 8 + 2 * words
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p, *r) for r in shapes(content)], columns=["path", "record", "kind", "parts"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, record int, kind int, parts array<array<struct<x: double, y: double>>>")


def read_plain(spark: SparkSession, nodes: str, edges: str) -> dict[str, DataFrame]:
    """nodes (node_id, x, y, kind) and edges (edge_id, from_node, to_node, lanes, speed, pts) of a simulator's plain files; edges without a shape run straight."""
    read = lambda path, tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    n = read(nodes, "node", "_id string, _x double, _y double, _type string").select(F.col("_id").alias("node_id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_type").alias("kind"))
    e = read(edges, "edge", "_id string, _from string, _to string, _numLanes int, _speed double, _shape string")
    at = lambda side: n.select(F.col("node_id").alias(f"_{side}"), F.struct("x", "y").alias(f"p_{side}"))
    e = e.join(at("from"), "_from", "left").join(at("to"), "_to", "left")
    pts = F.when(F.length("_shape") > 0, _shape(F.col("_shape"))).otherwise(F.array("p_from", "p_to"))
    return {"nodes": n, "edges": e.select(F.col("_id").alias("edge_id"), F.col("_from").alias("from_node"), F.col("_to").alias("to_node"), F.coalesce("_numLanes", F.lit(1)).alias("lanes"), F.col("_speed").alias("speed"), pts.alias("pts"))}


def moved_plain(layers: dict[str, DataFrame], offset: tuple[float, float], zone: int, south: bool = False) -> dict[str, DataFrame]:
    """The layers of ``read_plain`` in degrees: the net's offset is taken off, UTM coordinates of ``zone`` are turned back."""
    geo = lambda x, y: from_utm(x - offset[0], y - offset[1], F.lit(zone), F.lit(south))

    def point(p: Column) -> Column:
        x, y = geo(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    x, y = geo(F.col("x"), F.col("y"))
    n = layers["nodes"].withColumn("_x", x).withColumn("_y", y).drop("x", "y").withColumnRenamed("_x", "x").withColumnRenamed("_y", "y")
    return {"nodes": n, "edges": layers["edges"].withColumn("pts", F.transform("pts", point))}


def lane_polygons(lanes: DataFrame) -> DataFrame:
    """edge_id, lane_id, pts: each lane's outline, its middle line moved aside by half its width and back again."""
    n = F.size("pts")

    def aside(sign: int) -> Column:
        def at(p: Column, i: Column) -> Column:
            a, b = F.get("pts", F.greatest(i - 1, F.lit(0))), F.get("pts", F.least(i + 1, n - 1))
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            m = F.sqrt(dx * dx + dy * dy)
            f = F.coalesce(F.try_divide(F.col("width") * (0.5 * sign), m), F.lit(0.0))
            return F.struct((p["x"] + dy * f).alias("x"), (p["y"] - dx * f).alias("y"))

        return F.transform("pts", at)

    ring = F.concat(aside(1), F.reverse(aside(-1)))
    return lanes.where(n >= 2).select("edge_id", "lane_id", F.concat(ring, F.slice(ring, 1, 1)).alias("pts"))


def connectors(net: dict[str, DataFrame]) -> DataFrame:
    """from_edge, to_edge, from_lane, to_lane, pts: each connection as the lane it leads over inside a junction, or the straight line between its lanes."""
    lane = net["lanes"].select("lane_id", "edge_id", "lane_index", "pts")
    side = lambda s: lane.select(F.col("edge_id").alias(f"{s}_edge"), F.col("lane_index").alias(f"{s}_lane"), F.col("pts").alias(f"{s}_pts"))
    j = net["connections"].join(side("from"), ["from_edge", "from_lane"], "left").join(side("to"), ["to_edge", "to_lane"], "left")
    j = j.join(lane.select(F.col("lane_id").alias("via"), F.col("pts").alias("via_pts")), "via", "left")
    straight = F.when(F.col("from_pts").isNotNull() & F.col("to_pts").isNotNull(), F.array(F.element_at("from_pts", -1), F.col("to_pts")[0]))
    return j.select("from_edge", "to_edge", "from_lane", "to_lane", F.coalesce("via_pts", straight).alias("pts")).where("pts is not null")


def connection_xml(connections: DataFrame) -> DataFrame:
    """value: one <connection> element a row."""
    x = lambda c: _xml(F.col(c).cast("string"))
    return connections.select(F.concat(F.lit('<connection from="'), x("from_edge"), F.lit('" to="'), x("to_edge"), F.lit('" fromLane="'), x("from_lane"), F.lit('" toLane="'), x("to_lane"), F.lit('"/>')).alias("value"))


def _xml(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")


def write_by_agent(matched: DataFrame, path: str) -> None:
    """One folder of CSV files an agent, with a header."""
    matched.repartition("agent_id").write.partitionBy("agent_id").option("header", True).mode("overwrite").csv(path)


def match_layers(matched: DataFrame, points: DataFrame, directed: DataFrame) -> dict[str, DataFrame]:
    """The layers of a match result, each agent_id, seq, pts: gps, prj_p (places on links), prj_l (lines between both), match_link, heading_vec (10 m along)."""
    parts = link_parts(directed)
    own = plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    f = F.coalesce(F.try_divide(F.col("along_m") - F.col("before"), own), F.lit(0.0))
    first = Window.partitionBy("agent_id", "seq").orderBy("part")
    m = matched.select("agent_id", "seq", "link", "along_m", "heading").join(parts.select("link", "part", "x1", "y1", "x2", "y2", "before"), "link")
    m = m.where((F.col("along_m") >= F.col("before") - 1e-6) & (F.col("along_m") <= F.col("before") + own + 1e-6)).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    m = m.join(points.select("agent_id", "seq", F.col("x_m").cast("double").alias("x"), F.col("y_m").cast("double").alias("y")), ["agent_id", "seq"])
    at = F.struct((F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y"))
    m = m.select("agent_id", "seq", "link", "heading", F.struct("x", "y").alias("g"), at.alias("p"))
    a = F.radians("heading")
    tip = F.struct((F.col("p.x") + 10 * F.sin(a)).alias("x"), (F.col("p.y") + 10 * F.cos(a)).alias("y"))
    shape = parts.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("part", "x1", "y1", "x2", "y2"))).alias("s")).select("link", F.concat(F.array(F.struct(F.col("s")[0]["x1"].cast("double").alias("x"), F.col("s")[0]["y1"].cast("double").alias("y"))), F.transform("s", lambda s: F.struct(s["x2"].cast("double").alias("x"), s["y2"].cast("double").alias("y")))).alias("pts"))
    line = lambda *c: m.select("agent_id", "seq", F.array(*c).alias("pts"))
    return {"gps": line("g"), "prj_p": line("p"), "prj_l": line("g", "p"), "match_link": m.select("agent_id", "seq", "link").join(shape, "link").select("agent_id", "seq", "pts"), "heading_vec": line("p", tip)}


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Each layer as GeoJSON lines in a folder of its name."""
    for name, df in layers.items():
        geojson_lines(df, "pts", [c for c in df.columns if c != "pts"]).write.mode("overwrite").text(f"{path}/{name}")


def point_features(points: DataFrame, properties: list[str], x: str = "x", y: str = "y", start: str | None = None, end: str | None = None, time: str = "t_s") -> DataFrame:
    """value: one GeoJSON point a row, of those between ``start`` and ``end`` of ``time`` if they are given."""
    p = points
    if start is not None:
        p = p.where(F.col(time) >= F.lit(start))
    if end is not None:
        p = p.where(F.col(time) <= F.lit(end))
    return geojson_lines(p.withColumn("_pts", F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))), "_pts", properties)


#: A page that draws features on a plain canvas, without anything from elsewhere.
_PAGE = """<!doctype html><meta charset="utf-8"><title>%s</title><canvas id="c" width="1200" height="800"></canvas><script>
const layers = %s, all = [];
const walk = c => typeof c[0] === "number" ? all.push(c) : c.forEach(walk);
for (const l of Object.values(layers)) for (const f of l) walk(f.geometry.coordinates);
const xs = all.map(p => p[0]), ys = all.map(p => p[1]);
const x0 = xs.reduce((a, b) => Math.min(a, b), Infinity), x1 = xs.reduce((a, b) => Math.max(a, b), -Infinity), y0 = ys.reduce((a, b) => Math.min(a, b), Infinity), y1 = ys.reduce((a, b) => Math.max(a, b), -Infinity);
const k = Math.min(1160 / (x1 - x0 || 1), 760 / (y1 - y0 || 1)), at = p => [20 + (p[0] - x0) * k, 780 - (p[1] - y0) * k];
const g = document.getElementById("c").getContext("2d"), colours = ["#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e"];
Object.values(layers).forEach((l, i) => { g.strokeStyle = g.fillStyle = colours[i %% 5]; for (const f of l) { const c = f.geometry.coordinates;
  if (f.geometry.type === "Point") { const [x, y] = at(c); g.fillRect(x - 1, y - 1, 3, 3); } else { g.beginPath(); c.forEach((p, j) => g[j ? "lineTo" : "moveTo"](...at(p))); g.stroke(); } } });
</script>"""


def write_map(path: str, layers: dict[str, DataFrame], title: str = "map", most_bytes: int = 64 << 20) -> None:
    """A page with layers of GeoJSON lines (column value) drawn on it.

    A page is for people: if the layers hold more than ``most_bytes`` nothing is
    written and ValueError raised, so that nothing is left out silently.
    """
    size = sum(df.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n")).first()["n"] for df in layers.values())
    if size > most_bytes:
        raise ValueError(f"{size} bytes are too many for a page; write the layers with write_layers or choose an area")
    body = ",".join(json.dumps(n) + ":[" + ",".join(r["value"] for r in df.collect()) + "]" for n, df in layers.items())
    Path(path).write_text(_PAGE % (escape(title), "{" + body.replace("</", "<\\/") + "}"), encoding="utf-8")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has their number and first and last load time once they were written."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.min(F.current_timestamp()).alias("began")), o


def way_points(text: Column) -> Column:
    """array<struct<x,y>> of 'x,y;x,y'; blank parts and parts without two numbers are left out."""
    parts = F.transform(F.split(text, r"\s*;\s*"), lambda q: F.struct(F.split(F.trim(q), r"\s*,\s*")[0].try_cast("double").alias("x"), F.try_element_at(F.split(F.trim(q), r"\s*,\s*"), F.lit(2)).try_cast("double").alias("y")))
    return F.filter(parts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _shape(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda q: F.struct(F.split(q, ",")[0].cast("double").alias("x"), F.split(q, ",")[1].cast("double").alias("y")))


def read_net(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """lanes, junctions, connections and the location of a traffic simulator's network file."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    lane = "struct<_id: string, _index: int, _speed: double, _length: double, _width: double, _shape: string>"
    edges = read("edge", f"_id string, _from string, _to string, _function string, _priority int, lane array<{lane}>")
    lanes = edges.select(F.col("_id").alias("edge_id"), F.col("_from").alias("from_node"), F.col("_to").alias("to_node"), F.coalesce("_function", F.lit("normal")).alias("function"), F.explode("lane").alias("l"))
    lanes = lanes.select("edge_id", "from_node", "to_node", "function", F.col("l._id").alias("lane_id"), F.col("l._index").alias("lane_index"), F.col("l._speed").alias("speed"), F.col("l._length").alias("length"), F.coalesce("l._width", F.lit(3.2)).alias("width"), _shape(F.col("l._shape")).alias("pts"))
    junctions = read("junction", "_id string, _type string, _x double, _y double, _shape string").select(F.col("_id").alias("junction_id"), F.col("_type").alias("kind"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.when(F.length("_shape") > 0, _shape(F.col("_shape"))).alias("pts"))
    connections = read("connection", "_from string, _to string, _fromLane int, _toLane int, _via string, _dir string").select(F.col("_from").alias("from_edge"), F.col("_to").alias("to_edge"), F.col("_fromLane").alias("from_lane"), F.col("_toLane").alias("to_lane"), F.col("_via").alias("via"), F.col("_dir").alias("turn"))
    location = read("location", "_netOffset string, _projParameter string, _origBoundary string").select(F.col("_netOffset").alias("net_offset"), F.col("_projParameter").alias("projection"))
    return {"lanes": lanes, "junctions": junctions, "connections": connections, "location": location}


def centre_lines(lanes: DataFrame) -> DataFrame:
    """edge_id, from_node, to_node, pts: the middle lane of each edge."""
    g = lanes.groupBy("edge_id", "from_node", "to_node").agg(F.sort_array(F.collect_list(F.struct("lane_index", "pts"))).alias("l"))
    return g.select("edge_id", "from_node", "to_node", F.get("l", F.floor(F.size("l") / 2).cast("int"))["pts"].alias("pts"))


def flows(matched: DataFrame) -> DataFrame:
    """agent_id, depart_s, edges (by blanks, in order): one vehicle an agent, runs on one link counted once."""
    from trackloom.operators.matching import link_runs

    runs = link_runs(matched)
    g = runs.groupBy("agent_id").agg(F.min("t_s").alias("_t"), F.sort_array(F.collect_list(F.struct("seq", F.col("link").cast("string").alias("e")))).alias("r"))
    first = runs.agg(F.min("t_s").alias("_all"))
    return g.join(F.broadcast(first)).select("agent_id", (F.col("_t") - F.col("_all")).alias("depart_s"), F.concat_ws(" ", F.col("r.e")).alias("edges"))


def route_xml(flow: DataFrame) -> DataFrame:
    """value: one <vehicle> element a row for ``write.text``, in order of departure."""
    x = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    return flow.orderBy("depart_s", "agent_id").select(F.concat(F.lit('<vehicle id="'), x("agent_id"), F.lit('" depart="'), F.round("depart_s", 2).cast("string"), F.lit('"><route edges="'), x("edges"), F.lit('"/></vehicle>')).alias("value"))


def plain_node_xml(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.format_string('<node id="%s" x="%.2f" y="%.2f"/>', F.col("node_id").cast("string"), "x", "y").alias("value"))


def plain_edge_xml(links: DataFrame) -> DataFrame:
    shape = F.concat_ws(" ", F.transform("pts", lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"])))
    return links.select(F.format_string('<edge id="%s" from="%s" to="%s" numLanes="%d" speed="%.2f" shape="%s"/>', F.col("link_id").cast("string"), F.col("from_node").cast("string"), F.col("to_node").cast("string"), F.coalesce("lane_num", F.lit(1)), F.coalesce("speed", F.lit(40.0)) / 3.6, shape).alias("value"))


def write_simulation_config(path: str, net: str, routes: str, end_s: int = 3600) -> None:
    Path(path).write_text(f"<configuration><input><net-file value={quoteattr(net)}/><route-files value={quoteattr(routes)}/></input><time><begin value=\"0\"/><end value=\"{int(end_s)}\"/></time></configuration>")


def write_bookmarks(path: str, places: DataFrame, group: str, append: bool = False) -> int:
    """Map bookmarks (name, lng, lat) for a desktop viewer: a box of 0.001 by 0.0008 degrees around each place.

    They are streamed to the file one partition after the other, all of them;
    with ``append`` those of an existing file stay before them.  Returns how many were written.
    """
    box = lambda r: f"Polygon (({r['lng'] - .001} {r['lat'] - .0008}, {r['lng'] + .001} {r['lat'] - .0008}, {r['lng'] + .001} {r['lat'] + .0008}, {r['lng'] - .001} {r['lat'] + .0008}, {r['lng'] - .001} {r['lat'] - .0008}))"
    file = Path(path)
    old = re.findall(r"<Bookmark .*?/>", file.read_text()) if append and file.exists() else []
    n = 0
    with file.open("w") as out:
        out.write(f"<!--{escape(group)}--><Bookmarks>" + "".join(old))
        for n, r in enumerate(places.select("name", "lng", "lat").orderBy("name").toLocalIterator(), 1):
            out.write(f"<Bookmark id={quoteattr(str(len(old) + n - 1))} name={quoteattr(str(r['name']))} group={quoteattr(group)} extent={quoteattr(box(r))}/>")
        out.write("</Bookmarks>")
    return n


def trip_features(points: DataFrame, time: str = "t_s") -> DataFrame:
    """value: one GeoJSON feature an agent with [x, y, 0, t] coordinates, as animated map layers read them."""
    g = points.groupBy("agent_id").agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), "x", "y"))).alias("p"))
    coords = F.transform("p", lambda p: F.array(p["x"], p["y"], F.lit(0.0), p["t"].cast("double")))
    return g.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("agent_id").alias("properties"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))).alias("value"))
