"""Queries that build, repair and search the road layers, and their SQL.

Degrees are taken as if on a plane, x = 90,000 lng and y = 111,000 lat, so that
any engine agrees on lengths; they come out as whole millimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.wkt import line_points, point_xy
from trackloom.operators import cleaning, grids, lines, matching, network, topology, trips
from trackloom.plans.stage import staged
from trackloom.plans.track_queries import LATTICE, _lattice, _milli, milli
from trackloom.plans.views import GPS_SQL, gps_view

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """The links without self-loops, with planar pts and their measured length."""
    flat = F.transform(line_points(F.col("geometry")), lambda p: lines.xy(p["x"] * 90000, p["y"] * 111000))
    l = network.checked(spark.read.parquet(f"{sf}/link_layer.parquet")).withColumn("pts", flat)
    return l.select("link_id", "from_node", "to_node", "dir", network.line_length(F.col("pts")).alias("length"), "speed", F.lower(F.trim("road_name")).alias("road_name"), "pts")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = point_xy(F.col("geometry"))
    return spark.read.parquet(f"{sf}/node_layer.parquet").select("node_id", (p["x"] * 90000).alias("x"), (p["y"] * 111000).alias("y"))


#: Points and segments of the links as common table expressions.
PARTS_SQL = r"""raw AS (SELECT link_id, from_node, to_node, dir, string_split(regexp_extract(geometry, '\((.*)\)', 1), ',') AS v FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1)),
vert AS (SELECT link_id, from_node, to_node, unnest(generate_series(1, len(v))) AS k, v FROM raw),
pt AS (SELECT link_id, k, CAST(split_part(trim(v[k]), ' ', 1) AS DOUBLE) * 90000 AS x, CAST(split_part(trim(v[k]), ' ', 2) AS DOUBLE) * 111000 AS y FROM vert),
seg AS (SELECT link_id, k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS m FROM pt WINDOW w AS (PARTITION BY link_id ORDER BY k)),
len AS (SELECT link_id, sum(m) AS length FROM seg WHERE x2 IS NOT NULL GROUP BY link_id)"""


@query(f"""WITH {PARTS_SQL},
n AS (SELECT link_id, length, CAST(floor(length / 100) AS BIGINT) AS k FROM len WHERE length > 0),
p AS (SELECT link_id, length, greatest(1, CASE WHEN length - k * 100 > 20 THEN k + 1 ELSE k END) AS parts FROM n),
c AS (SELECT link_id, length, parts, unnest(generate_series(0, parts - 1)) AS piece FROM p),
nodes AS (SELECT link_id, piece, (SELECT max(node_id) FROM node_layer) + row_number() OVER (ORDER BY link_id, piece) AS node_id FROM c WHERE piece > 0),
ids AS (SELECT link_id, piece, (SELECT max(link_id) FROM raw) + row_number() OVER (ORDER BY link_id, piece) AS id FROM c WHERE piece > 0)
SELECT coalesce(i.id, c.link_id) AS link_id, coalesce(a.node_id, r.from_node) AS from_node, coalesce(b.node_id, r.to_node) AS to_node, c.link_id AS parent_link,
  {_milli("CASE WHEN c.piece = c.parts - 1 THEN c.length ELSE (c.piece + 1) * 100.0 END - c.piece * 100.0")} AS length_mm
FROM c JOIN raw r USING (link_id) LEFT JOIN ids i ON i.link_id = c.link_id AND i.piece = c.piece
LEFT JOIN nodes a ON a.link_id = c.link_id AND a.piece = c.piece LEFT JOIN nodes b ON b.link_id = c.link_id AND b.piece = c.piece + 1""")
def divided_network(spark, sf):
    l, _ = topology.divide(_links(spark, sf), _nodes(spark, sf), 100.0, 20.0)
    return l.select("link_id", "from_node", "to_node", "parent_link", milli("length").alias("length_mm"))


@query(f"""WITH {PARTS_SQL} SELECT link_id, k - 1 AS topo_seq, {_milli('x1')} AS x1, {_milli('y1')} AS y1, {_milli('x2')} AS x2, {_milli('y2')} AS y2, {_milli('m')} AS seg_length,
  {_milli('sum(m) OVER (PARTITION BY link_id ORDER BY k)')} AS seg_acc, count(*) OVER (PARTITION BY link_id) AS seg_count FROM seg WHERE x2 IS NOT NULL""")
def planar_segments(spark, sf):
    s = network.segments(_links(spark, sf))
    return s.select("link_id", "topo_seq", *[milli(c).alias(c) for c in ("x1", "y1", "x2", "y2", "seg_length", "seg_acc")], "seg_count")


@query(f"""WITH {PARTS_SQL}, s AS (SELECT DISTINCT x1, y1, x2, y2, min(link_id) OVER (PARTITION BY x1, y1, x2, y2) AS path_id FROM seg WHERE x2 IS NOT NULL AND m > 0)
SELECT path_id, {_milli('x1')} AS x1, {_milli('y1')} AS y1, {_milli('x2')} AS x2, {_milli('y2')} AS y2, lower(trim(road_name)) AS road_name FROM s JOIN link_layer l ON l.link_id = s.path_id""")
def split_paths(spark, sf):
    s = network.split_at_vertices(_links(spark, sf).withColumnRenamed("link_id", "path_id"))
    return s.select("path_id", *[milli(c).alias(c) for c in ("x1", "y1", "x2", "y2")], "road_name")


@query(f"""WITH {PARTS_SQL},
pt2 AS (SELECT node_id, CAST(regexp_extract(geometry, '\\(\\s*(\\S+)\\s+(\\S+?)\\s*\\)', 1) AS DOUBLE) * 90000 AS x, CAST(regexp_extract(geometry, '\\(\\s*(\\S+)\\s+(\\S+?)\\s*\\)', 2) AS DOUBLE) * 111000 AS y FROM node_layer),
b AS (SELECT *, unnest(generate_series(CAST(floor((least(x1, x2) - 30) / 30) AS BIGINT), CAST(floor((greatest(x1, x2) + 30) / 30) AS BIGINT))) AS cx FROM seg WHERE x2 IS NOT NULL),
c AS (SELECT *, unnest(generate_series(CAST(floor((least(y1, y2) - 30) / 30) AS BIGINT), CAST(floor((greatest(y1, y2) + 30) / 30) AS BIGINT))) AS cy FROM b),
d AS (SELECT node_id, link_id, sqrt(pow(x1 + f * (x2 - x1) - x, 2) + pow(y1 + f * (y2 - y1) - y, 2)) AS d FROM (
  SELECT *, coalesce(greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))), 0) AS f
  FROM (SELECT *, CAST(floor(x / 30) AS BIGINT) AS cx, CAST(floor(y / 30) AS BIGINT) AS cy FROM pt2) p JOIN c USING (cx, cy)))
SELECT node_id, link_id, {_milli('min(d)')} AS dist_mm FROM d WHERE d <= 30 GROUP BY node_id, link_id""")
def links_near_nodes(spark, sf):
    at = _nodes(spark, sf).select(F.col("node_id").alias("point_id"), "x", "y")
    return lines.nearest_on_lines(at, _links(spark, sf), 30.0).select(F.col("point_id").alias("node_id"), "link_id", milli("dist_m").alias("dist_mm"))


@query(f"""WITH {PARTS_SQL},
p AS (SELECT ping_id, lng * 90000 AS x, lat * 111000 AS y FROM example_sparse_gps WHERE lng BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
acc AS (SELECT *, sum(m) OVER (PARTITION BY link_id ORDER BY k) - m AS before FROM seg WHERE x2 IS NOT NULL),
b AS (SELECT *, unnest(generate_series(CAST(floor((least(x1, x2) - 40) / 40) AS BIGINT), CAST(floor((greatest(x1, x2) + 40) / 40) AS BIGINT))) AS cx FROM acc),
c AS (SELECT *, unnest(generate_series(CAST(floor((least(y1, y2) - 40) / 40) AS BIGINT), CAST(floor((greatest(y1, y2) + 40) / 40) AS BIGINT))) AS cy FROM b),
f AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0))), 0) AS f
  FROM (SELECT *, CAST(floor(x / 40) AS BIGINT) AS cx, CAST(floor(y / 40) AS BIGINT) AS cy FROM p) q JOIN c USING (cx, cy)),
d AS (SELECT ping_id, link_id, k, before + f * m AS along, sqrt(pow(x1 + f * (x2 - x1) - x, 2) + pow(y1 + f * (y2 - y1) - y, 2)) AS d FROM f)
SELECT ping_id, link_id, {_milli('min(d)')} AS dist_mm, CAST(floor(arg_min(along, d) / 1 + 0.5) AS BIGINT) AS along_m FROM d WHERE d <= 40 GROUP BY ping_id, link_id""")
def road_candidates(spark, sf):
    p = spark.read.parquet(f"{sf}/example_sparse_gps.parquet").where("lng between -180 and 180 and lat between -90 and 90")
    p = p.select(F.col("ping_id").alias("agent_id"), F.lit(0).alias("seq"), (F.col("lng") * 90000).alias("x_m"), (F.col("lat") * 111000).alias("y_m"))
    l = _links(spark, sf).select(F.col("link_id").alias("link"), "from_node", "to_node", "pts")
    c = matching.candidates(p, l, matching.Model(buffer_m=40.0, top_k=1_000_000))
    return c.select(F.col("agent_id").alias("ping_id"), F.col("link").alias("link_id"), milli("dist_m").alias("dist_mm"), F.floor(F.col("along_m") + 0.5).cast("bigint").alias("along_m"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY from_node, to_node, dir = 1 ORDER BY link_id) AS k FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1)),
o AS (SELECT * FROM f WHERE dir <> 1 OR k = 1),
g AS (SELECT *, count(*) OVER w AS ways, row_number() OVER (w ORDER BY link_id) AS n FROM o WINDOW w AS (PARTITION BY least(from_node, to_node), greatest(from_node, to_node), dir = 1))
SELECT link_id, from_node, to_node, CASE WHEN dir = 1 AND ways = 2 THEN 0 ELSE dir END AS dir FROM g WHERE NOT (dir = 1 AND ways = 2) OR n = 1""".replace("(w ORDER BY link_id)", "(PARTITION BY least(from_node, to_node), greatest(from_node, to_node), dir = 1 ORDER BY link_id)"))
def merge_double_any_length(spark, sf):
    return network.merge_double(_links(spark, sf), by_length=False).select("link_id", "from_node", "to_node", "dir")


@query()
def merged_chains(spark, sf):
    return topology.merge_chains(_links(spark, sf)).select("link_id", "from_node", "to_node", "dir", milli("length").alias("length_mm"), "road_name")


@query()
def merged_short_links(spark, sf):
    return topology.merge_short(_links(spark, sf), 60.0).select("link_id", "from_node", "to_node", milli("length").alias("length_mm"))


@query()
def without_overlaps(spark, sf):
    return topology.drop_overlaps(_links(spark, sf)).select("link_id", "from_node", "to_node", "dir")


@query()
def repaired_connections(spark, sf):
    return topology.repair_connections(_links(spark, sf), _nodes(spark, sf), 6.0)[0].select("link_id", "from_node", "to_node", "parent_link", milli("length").alias("length_mm"))


@query()
def simple_links(spark, sf):
    return lines.simple_lines(_links(spark, sf)).select("link_id", "piece", milli(network.line_length(F.col("pts"))).alias("length_mm"))


@query()
def split_double_links(spark, sf):
    return topology.split_loops(_links(spark, sf), _nodes(spark, sf))[0].select("link_id", "from_node", "to_node", milli("length").alias("length_mm"))


@query()
def built_network(spark, sf):
    p = _links(spark, sf).select(F.col("link_id").alias("path_id"), "road_name", "pts")
    return topology.network_from_paths(p)[0].select("link_id", "from_node", "to_node", "dir", "road_name", milli("length").alias("length_mm"))


@query("""WITH e AS (SELECT link_id, unnest([from_node, to_node]) AS node_id FROM link_layer) SELECT link_id, e.node_id FROM e ANTI JOIN node_layer n USING (node_id)""")
def layer_check(spark, sf):
    return topology.checked_layers(spark.read.parquet(f"{sf}/link_layer.parquet"), _nodes(spark, sf))


@query("""WITH n AS (SELECT node_id, 1000 + row_number() OVER (ORDER BY node_id) - 1 AS id FROM node_layer), l AS (SELECT *, 500 + row_number() OVER (ORDER BY link_id) - 1 AS id FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1))
SELECT l.id AS link_id, a.id AS from_node, b.id AS to_node FROM l JOIN n a ON a.node_id = l.from_node JOIN n b ON b.node_id = l.to_node""")
def renumbered_network(spark, sf):
    return topology.renumber(_links(spark, sf), _nodes(spark, sf), 500, 1000)[0].select("link_id", "from_node", "to_node")


@query("""WITH n AS (SELECT lower(trim(road_name)) AS road_name, count(*) AS n FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1) AND road_name IS NOT NULL GROUP BY 1),
b AS (SELECT road_name, CAST(floor((sum(n) OVER (ORDER BY road_name) - n) / 500.0) AS BIGINT) AS bin FROM n) SELECT b.bin, count(*) AS links FROM b JOIN link_layer l ON lower(trim(l.road_name)) = b.road_name WHERE l.from_node <> l.to_node AND l.dir IN (0, 1, -1) GROUP BY b.bin""")
def region_bins(spark, sf):
    return topology.packed_regions(_links(spark, sf).where("road_name is not null"), "road_name", 500).groupBy("bin").agg(F.count(F.lit(1)).alias("links"))


@query(f"WITH {PARTS_SQL} SELECT {_milli('min(x)')} AS min_x, {_milli('min(y)')} AS min_y, {_milli('max(x)')} AS max_x, {_milli('max(y)')} AS max_y FROM pt")
def layer_bounds(spark, sf):
    b = grids.bounds(_links(spark, sf))
    return b.select(*[milli(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("""SELECT from_node AS node_id FROM link_layer EXCEPT SELECT to_node FROM link_layer""")
def only_sources(spark, sf):
    l = spark.read.parquet(f"{sf}/link_layer.parquet")
    return l.select(F.col("from_node").alias("node_id")).subtract(l.select("to_node"))


@query("""SELECT from_node AS node_id FROM link_layer WHERE dir = 1 INTERSECT SELECT to_node FROM link_layer WHERE dir = 0""")
def one_and_two_way_nodes(spark, sf):
    l = spark.read.parquet(f"{sf}/link_layer.parquet")
    return l.where("dir = 1").select(F.col("from_node").alias("node_id")).intersect(l.where("dir = 0").select("to_node"))


@query(f"""WITH RECURSIVE {LATTICE}, q AS (SELECT DISTINCT CAST(s_suppkey * 13 % 2500 + 1 AS BIGINT) AS o, CAST(s_suppkey * 7 % 2500 + 1 AS BIGINT) AS d FROM supplier), src AS (SELECT DISTINCT o FROM q),
walk(o, d, cost) USING KEY (o, d) AS (
  SELECT o, o, CAST(0 AS DOUBLE) FROM src GROUP BY o
  UNION SELECT w.o, e.t, min(w.cost + e.length) FROM walk w JOIN edges e ON w.d = e.f LEFT JOIN recurring.walk k ON k.o = w.o AND k.d = e.t
  WHERE k.cost IS NULL OR w.cost + e.length < k.cost GROUP BY w.o, e.t)
SELECT q.o, q.d, {_milli('coalesce(w.cost, -1)')} AS cost_mm FROM q LEFT JOIN walk w ON w.o = q.o AND w.d = q.d""")
def od_shortest_paths(spark, sf):
    c = spark.read.parquet(f"{sf}/supplier.parquet")
    q = c.select((F.col("s_suppkey") * 13 % 2500 + 1).alias("o"), (F.col("s_suppkey") * 7 % 2500 + 1).alias("d"))
    e = _lattice(spark).select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.lit(100.0).alias("length"))
    return matching.od_paths(e, q, -1.0).select("o", "d", milli("cost").alias("cost_mm"))


@query()
def k_shortest_paths(spark, sf):
    c = spark.read.parquet(f"{sf}/supplier.parquet")
    q = c.select((F.col("s_suppkey") % 200 + 1).alias("o"), (F.col("s_suppkey") * 3 % 200 + 1).alias("d"))
    e = _lattice(spark).select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.lit(100.0).alias("length"))
    return matching.k_shortest_paths(e, q, 3).select("o", "d", "rank", milli("cost").alias("cost_mm"))


@query()
def road_path_table(spark, sf):
    from trackloom.plans.stage import shared_folder

    d = network.directed_links(_links(spark, sf))
    e = d.select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), "length")
    import uuid

    t = matching.path_table(e, 1200.0, f"{shared_folder(spark)}/paths-{uuid.uuid4().hex}.parquet")
    return t.select("o", "d", milli("cost").alias("cost_mm"), "second", "last_but_one")


@query(f"""WITH gps AS ({GPS_SQL}), c AS (SELECT agent_id, seq, CAST(floor(x_m / 100.0) AS BIGINT) AS cell, CASE WHEN lag(floor(x_m / 100.0)) OVER w = floor(x_m / 100.0) THEN 0 ELSE 1 END AS new FROM gps WINDOW w AS (PARTITION BY agent_id ORDER BY seq))
SELECT agent_id, seq, CAST(sum(new) OVER (PARTITION BY agent_id ORDER BY seq) AS BIGINT) AS run FROM c""")
def run_labels(spark, sf):
    g = gps_view(spark, sf).withColumn("cell", F.floor(F.col("x_m") / 100.0))
    return cleaning.run_ids(g, ["agent_id"], ["seq"], ["cell"]).select("agent_id", "seq", "run")


@query()
def dense_match_result(spark, sf):
    from trackloom.plans.track_queries import MODEL, _some_points

    p, l = _some_points(spark, sf), _lattice(spark)
    return matching.dense_result(staged(matching.match(p, l, MODEL)), p, l).select("agent_id", "k", milli("t_s").alias("t_ms"), "link", milli("x_m").alias("x_mm"), milli("y_m").alias("y_mm"))


@query("""WITH r AS (SELECT region_id, regexp_extract_all(geometry, '(-?[0-9.]+(?:[eE][-+]?[0-9]+)?) (-?[0-9.]+(?:[eE][-+]?[0-9]+)?)', 0) AS v FROM region_layer WHERE geometry LIKE '%((%'),
c AS (SELECT region_id, avg(CAST(split_part(p, ' ', 1) AS DOUBLE)) AS x, avg(CAST(split_part(p, ' ', 2) AS DOUBLE)) AS y FROM (SELECT region_id, unnest(v) AS p FROM r) GROUP BY region_id),
m AS (SELECT region_id, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS x, CAST(floor(y * 1e6 + 0.5) AS BIGINT) AS y FROM c)
SELECT a.region_id AS o, b.region_id AS d, a.x AS o_x, a.y AS o_y, b.x AS d_x, b.y AS d_y FROM m a JOIN m b ON a.region_id <> b.region_id""")
def region_layer_od(spark, sf):
    c = trips.region_centres(spark.read.parquet(f"{sf}/region_layer.parquet"))
    u = lambda k: F.floor(F.col(k) * 1e6 + 0.5).cast("bigint").alias(k)
    return trips.region_od(c.select("region_id", u("x"), u("y")))


@query()
def random_region_od(spark, sf):
    return trips.random_od(spark, spark.read.parquet(f"{sf}/region_layer.parquet"), 200, 300.0, seed=1)


@query()
def od_by_gps(spark, sf):
    return trips.od_by_gps(gps_view(spark, sf), 1800, 10.0, 3, 60.0)


QUERIES = Q
ORACLE = SQL
