"""Queries over the planar views and the road layers, and their SQL.

Lengths and coordinates come out as whole thousandths, so that the last digit of
a double doesn't decide whether two engines agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import projection
from trackloom.functions.geo import great_circle_m
from trackloom.functions.wkt import line_points, point_xy
from trackloom.operators import cleaning, grids, matching, network, trips
from trackloom.operators.sessions import session_events
from trackloom.plans.stage import staged
from trackloom.plans.views import GPS_SQL, LINK_SQL, gps_view, link_view
from trackloom.sources.formats import way_points


def milli(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000 + 0.5).cast("bigint")


def _milli(e: str) -> str:
    return f"CAST(floor(({e}) * 1000 + 0.5) AS BIGINT)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/link_layer.parquet")


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


D = "sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
NEXT = D.format(x1="x_m", y1="y_m", x2="lead(x_m) OVER w", y2="lead(y_m) OVER w")
PREV = D.format(x1="lag(x_m) OVER w", y1="lag(y_m) OVER w", x2="x_m", y2="y_m")
W = "WINDOW w AS (PARTITION BY agent_id ORDER BY seq)"
GPS = f"WITH gps AS ({GPS_SQL})"


@query(f"{GPS} SELECT agent_id, seq, {_milli(f'coalesce({NEXT}, 0)')} AS dis_mm, coalesce(lead(t_s) OVER w - t_s, 0) AS dt_s FROM gps {W}")
def gps_adjacent_gap(spark, sf):
    return cleaning.adjacent_gaps(gps_view(spark, sf)).select("agent_id", "seq", milli("dis_m").alias("dis_mm"), "dt_s")


@query(
    f"""{GPS}, m AS (SELECT *, CASE WHEN lead(seq) OVER w IS NULL OR {NEXT} > 5 THEN 1 ELSE 0 END AS moves FROM gps {W}),
i AS (SELECT *, sum(moves) OVER (PARTITION BY agent_id ORDER BY seq) AS island FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY agent_id, island) AS n FROM i)
SELECT agent_id, seq, x_m, y_m FROM c WHERE NOT (moves = 0 AND n > 3)"""
)
def dwell_removal(spark, sf):
    return cleaning.remove_dwell(gps_view(spark, sf), 5.0, 2).select("agent_id", "seq", "x_m", "y_m")


@query(f"{GPS} SELECT agent_id, seq FROM (SELECT agent_id, seq, row_number() OVER (PARTITION BY agent_id ORDER BY seq) AS k FROM gps) WHERE (k - 1) % 3 = 0")
def downsample(spark, sf):
    return cleaning.lower_frequency(gps_view(spark, sf), 3).select("agent_id", "seq")


@query(f"{GPS} SELECT agent_id, seq, {_milli('avg(t_s) OVER w')} AS t_ms, {_milli('avg(x_m) OVER w')} AS x_mm, {_milli('avg(y_m) OVER w')} AS y_mm FROM gps WINDOW w AS (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def rolling_smooth(spark, sf):
    return cleaning.rolling_average(gps_view(spark, sf), 2).select("agent_id", "seq", milli("t_s").alias("t_ms"), milli("x_m").alias("x_mm"), milli("y_m").alias("y_mm"))


@query(
    f"""{GPS}, n AS (SELECT *, lead(t_s) OVER w AS t2, lead(x_m) OVER w AS x2, lead(y_m) OVER w AS y2, {NEXT} AS d FROM gps {W}),
p AS (SELECT *, CASE WHEN d > 20 THEN CAST(floor(d / 20 + 0.001) AS BIGINT) + 1 ELSE 1 END AS parts FROM n),
e AS (SELECT *, unnest(generate_series(0, parts - 1)) AS k FROM p)
SELECT agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY seq, k) - 1 AS seq, CASE WHEN k = 0 THEN 's' ELSE 'd' END AS loc_type,
  {_milli('CASE WHEN k = 0 THEN t_s ELSE t_s + (t2 - t_s) * k / CAST(parts AS DOUBLE) END')} AS t_ms,
  {_milli('CASE WHEN k = 0 THEN x_m ELSE x_m + (x2 - x_m) * k / CAST(parts AS DOUBLE) END')} AS x_mm,
  {_milli('CASE WHEN k = 0 THEN y_m ELSE y_m + (y2 - y_m) * k / CAST(parts AS DOUBLE) END')} AS y_mm FROM e"""
)
def densify(spark, sf):
    return cleaning.densify(gps_view(spark, sf), 20.0).select("agent_id", "seq", "loc_type", milli("t_s").alias("t_ms"), milli("x_m").alias("x_mm"), milli("y_m").alias("y_mm"))


@query(f"""{GPS}, d AS (SELECT agent_id, seq, coalesce(lead(x_m) OVER w, x_m) - coalesce(lag(x_m) OVER w, x_m) AS dx, coalesce(lead(y_m) OVER w, y_m) - coalesce(lag(y_m) OVER w, y_m) AS dy FROM gps {W})
SELECT agent_id, seq, dx, dy, {_milli('sqrt(dx * dx + dy * dy)')} AS len_mm FROM d""")
def heading_difference(spark, sf):
    return cleaning.difference_heading(gps_view(spark, sf)).select("agent_id", "seq", "dx", "dy", milli("vec_len").alias("len_mm"))


_FILTER = """WITH RECURSIVE gps AS ({gps}), k(agent_id, seq, t_s, x, vx, y, vy, a, b, d) AS (
  SELECT agent_id, seq, t_s, CAST(x_m AS DOUBLE), CAST(0 AS DOUBLE), CAST(y_m AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM gps WHERE seq = 0
  UNION ALL
  SELECT agent_id, seq, t_s, px + a / (a + 25) * (zx - px), vx + b / (a + 25) * (zx - px), py + a / (a + 25) * (zy - py), vy + b / (a + 25) * (zy - py), (1 - a / (a + 25)) * a, (1 - a / (a + 25)) * b, d - b / (a + 25) * b
  FROM (SELECT g.agent_id, g.seq, g.t_s, g.x_m AS zx, g.y_m AS zy, k.vx, k.vy, k.x + (g.t_s - k.t_s) * k.vx AS px, k.y + (g.t_s - k.t_s) * k.vy AS py,
      k.a + 2 * (g.t_s - k.t_s) * k.b + (g.t_s - k.t_s) * (g.t_s - k.t_s) * k.d + 0.25 AS a, k.b + (g.t_s - k.t_s) * k.d AS b, k.d + 0.25 AS d
    FROM k JOIN gps g ON g.agent_id = k.agent_id AND g.seq = k.seq + 1) s)
SELECT agent_id, seq, {x} AS x_mm, {y} AS y_mm FROM k"""


@query(_FILTER.format(gps=GPS_SQL, x=_milli("x"), y=_milli("y")))
def kalman_smooth(spark, sf):
    return cleaning.kalman_smooth(gps_view(spark, sf), 0.5, 5.0).select("agent_id", "seq", milli("x_m").alias("x_mm"), milli("y_m").alias("y_mm"))


@query()
def simplify_trajectory(spark, sf):
    return cleaning.simplify(gps_view(spark, sf), 8.0)


@query(f"""{GPS}, h AS (SELECT agent_id, seq, CASE WHEN seq % 3 <> 1 THEN x_m END AS x, x_m FROM gps),
n AS (SELECT *, row_number() OVER w AS k FROM h {W}),
a AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS xa, first_value(x IGNORE NULLS) OVER f AS xb,
  last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER b AS ka, first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER f AS kb FROM n
  WINDOW b AS (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT agent_id, seq, {_milli('coalesce(x, CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN xa + (xb - xa) * (k - ka) / CAST(kb - ka AS DOUBLE) END, xa, xb)')} AS x_mm FROM a""")
def time_gap_fill(spark, sf):
    g = gps_view(spark, sf).select("agent_id", "seq", F.when(F.col("seq") % 3 != 1, F.col("x_m").cast("double")).alias("x"))
    return cleaning.gap_fill(g, ["agent_id"], "seq", "x").select("agent_id", "seq", milli("x").alias("x_mm"))


TRIPS = f"""{GPS}, o AS (SELECT *, CASE WHEN t_s - lag(t_s) OVER w <= 1800 THEN 0 ELSE 1 END AS opens FROM gps {W}),
t AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY agent_id ORDER BY seq) AS BIGINT) AS trip_no FROM o)"""


@query(f"""{TRIPS}, d AS (SELECT *, {PREV} AS d FROM t WINDOW w AS (PARTITION BY agent_id, trip_no ORDER BY seq))
SELECT agent_id, trip_no, count(*) AS n_points, min(t_s) AS start_s, max(t_s) AS end_s, CAST(floor(coalesce(sum(d), 0) + 0.5) AS BIGINT) AS length_m FROM d GROUP BY ALL""")
def main_trips(spark, sf):
    t = trips.trip_summary(trips.main_trips(gps_view(spark, sf)))
    return t.withColumn("length_m", F.floor(F.col("length_m") + 0.5).cast("bigint"))


@query(f"""{TRIPS}, k AS (SELECT DISTINCT agent_id, trip_no FROM t) SELECT agent_id, trip_no, row_number() OVER (ORDER BY agent_id, trip_no) AS trip_id FROM k""")
def trip_numbers(spark, sf):
    t = trips.main_trips(gps_view(spark, sf)).select("agent_id", "trip_no").distinct()
    return trips.trip_ids(t, ["agent_id", "trip_no"])


@query(f"""{TRIPS}, m AS (SELECT *, CASE WHEN {PREV} < 10 THEN 0 ELSE 1 END AS moves, coalesce(t_s - lag(t_s) OVER w, 0) AS dt FROM t WINDOW w AS (PARTITION BY agent_id, trip_no ORDER BY seq)),
i AS (SELECT *, sum(moves) OVER (PARTITION BY agent_id, trip_no ORDER BY seq) AS island FROM m),
c AS (SELECT *, CASE WHEN moves = 0 AND count(*) OVER (PARTITION BY agent_id, trip_no, island) > 4 THEN 1 ELSE 0 END AS stay FROM i),
g AS (SELECT *, sum(1 - stay) OVER (PARTITION BY agent_id, trip_no ORDER BY seq) AS grp FROM c),
r AS (SELECT *, sum(dt * stay) OVER (PARTITION BY agent_id, trip_no, grp) AS rest, row_number() OVER (PARTITION BY agent_id, trip_no, grp ORDER BY seq DESC) AS k FROM g)
SELECT agent_id, trip_no, seq, CAST(sum(CASE WHEN stay = 1 AND rest > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id, trip_no ORDER BY seq) AS BIGINT) AS sub_no FROM r WHERE k = 1""")
def sub_trips(spark, sf):
    return trips.sub_trips(trips.main_trips(gps_view(spark, sf)), 10.0, 3, 60.0).select("agent_id", "trip_no", "seq", "sub_no")


@query(f"""{TRIPS}, n AS (SELECT *, count(*) OVER (PARTITION BY agent_id, trip_no) AS n, row_number() OVER (PARTITION BY agent_id, trip_no ORDER BY seq) AS k FROM t),
p AS (SELECT * FROM n WHERE n >= 2 AND (k = 1 OR k = n OR k % greatest(CAST(floor((n - 2) / 5.0) AS BIGINT), 1) = 0))
SELECT agent_id, trip_no, arg_min(x_m, k) AS o_x, arg_min(y_m, k) AS o_y, arg_max(x_m, k) AS d_x, arg_max(y_m, k) AS d_y,
  coalesce(string_agg(CASE WHEN k > 1 AND k < n THEN x_m || ',' || y_m END, ';' ORDER BY k), '') AS way_points FROM p GROUP BY agent_id, trip_no""")
def waypoint_od(spark, sf):
    return trips.waypoint_od(trips.main_trips(gps_view(spark, sf)), ["agent_id", "trip_no"])


@query("""WITH c AS (SELECT n_nationkey AS id, n_nationkey * 3 % 17 AS x, n_nationkey * 5 % 13 AS y FROM nation)
SELECT a.id AS o, b.id AS d, a.x AS o_x, a.y AS o_y, b.x AS d_x, b.y AS d_y FROM c a JOIN c b ON a.id <> b.id""")
def region_od(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("region_id"), (F.col("n_nationkey") * 3 % 17).alias("x"), (F.col("n_nationkey") * 5 % 13).alias("y"))
    return trips.region_od(n)


@query(f"""{GPS}, l AS (SELECT agent_id, seq, CAST(floor(x_m / 100.0) AS BIGINT) AS f, CAST(floor(y_m / 100.0) AS BIGINT) AS t FROM gps),
p AS (SELECT *, lag(f) OVER w AS pf, lag(t) OVER w AS pt FROM l {W}) SELECT agent_id, seq, f AS from_node, t AS to_node FROM p WHERE pf IS NULL OR pf <> f OR pt <> t""")
def link_dedup_runs(spark, sf):
    cell = lambda c: F.floor(F.col(c) / 100.0).cast("bigint")
    return matching.link_runs(gps_view(spark, sf).select("agent_id", "seq", cell("x_m").alias("from_node"), cell("y_m").alias("to_node")))


DIRECTED = """e AS (
  SELECT link_id, from_node, to_node, length, speed, false AS rev FROM link_layer WHERE dir IN (0, 1) AND from_node <> to_node
  UNION ALL SELECT link_id, to_node, from_node, length, speed, true FROM link_layer WHERE dir IN (0, -1) AND from_node <> to_node),
directed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_node, to_node ORDER BY rev, link_id) AS k FROM e) WHERE k = 1)"""


@query(f"WITH {DIRECTED} SELECT row_number() OVER (ORDER BY rev, link_id) - 1 AS single_link_id, link_id, from_node, to_node FROM directed")
def directed_links(spark, sf):
    return network.with_single_ids(network.directed_links(_links(spark, sf))).select("single_link_id", "link_id", "from_node", "to_node")


@query("""WITH p AS (SELECT *, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, floor(length) AS m, dir = 1 AS one FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1)),
q AS (SELECT *, row_number() OVER (PARTITION BY a, b, m, one ORDER BY link_id) AS k FROM p),
g AS (SELECT a, b, m, one, count(DISTINCT from_node) AS ways FROM p GROUP BY ALL)
SELECT q.link_id, q.from_node, q.to_node, CASE WHEN q.one AND g.ways = 2 THEN 0 ELSE q.dir END AS dir FROM q JOIN g ON q.a = g.a AND q.b = g.b AND q.m IS NOT DISTINCT FROM g.m AND q.one = g.one
WHERE NOT (q.one AND g.ways = 2) OR q.k = 1""")
def merge_double(spark, sf):
    return network.merge_double(network.checked(_links(spark, sf))).select("link_id", "from_node", "to_node", "dir")


@query("""WITH e AS (SELECT from_node AS n, to_node AS m, CAST(dir <> -1 AS INT) AS o, CAST(dir <> 1 AS INT) AS i FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1)
  UNION ALL SELECT to_node, from_node, CAST(dir <> 1 AS INT), CAST(dir <> -1 AS INT) FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1))
SELECT n AS node_id, count(DISTINCT m) AS degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM e GROUP BY n""")
def node_degree(spark, sf):
    return network.node_degrees(_links(spark, sf))


@query(f"""WITH n AS (SELECT link_id, length, CAST(floor(length / 100) AS BIGINT) AS k FROM link_layer WHERE length > 0),
p AS (SELECT *, greatest(1, CASE WHEN length - k * 100 > 20 THEN k + 1 ELSE k END) AS parts FROM n),
e AS (SELECT *, unnest(generate_series(0, parts - 1)) AS piece FROM p)
SELECT link_id, piece, {_milli('piece * 100.0')} AS from_mm, {_milli('CASE WHEN piece = parts - 1 THEN length ELSE (piece + 1) * 100.0 END')} AS to_mm FROM e""")
def divide_links(spark, sf):
    return network.divide_links(_links(spark, sf), 100.0, 20.0).select("link_id", "piece", milli("from_m").alias("from_mm"), milli("to_m").alias("to_mm"))


@query(f"""WITH r AS (SELECT lower(trim(road_name)) AS road, CAST(speed AS DOUBLE) AS v, length AS m FROM link_layer)
SELECT road, {_milli("coalesce(sum(v * m) / nullif(sum(CASE WHEN v IS NOT NULL THEN m END), 0), -1)")} AS mean_speed_m FROM r GROUP BY road""")
def weighted_speed(spark, sf):
    r = _links(spark, sf).select(F.lower(F.trim("road_name")).alias("road"), "speed", "length")
    return network.weighted_speed(r, ["road"]).select("road", milli(F.coalesce("mean_speed", F.lit(-1.0))).alias("mean_speed_m"))


@query(f"""{GPS}, l AS ({LINK_SQL}), c AS (
  SELECT agent_id, seq, link_id, x_m, y_m, x1, y1, x2 - x1 AS ux, y2 - y1 AS uy, greatest(0.0, least(1.0, ((x_m - x1) * (x2 - x1) + (y_m - y1) * (y2 - y1)) / 10000.0)) AS f
  FROM gps JOIN l ON x_m BETWEEN least(x1, x2) - 150 AND greatest(x1, x2) + 150 AND y_m BETWEEN least(y1, y2) - 150 AND greatest(y1, y2) + 150),
d AS (SELECT agent_id, seq, link_id, sqrt(pow(x1 + f * ux - x_m, 2) + pow(y1 + f * uy - y_m, 2)) AS dist, f * 100 AS along FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY agent_id, seq ORDER BY {_milli('dist')}, link_id) AS k FROM d WHERE dist <= 150)
SELECT agent_id, seq, link_id, {_milli('dist')} AS dist_mm, {_milli('along')} AS along_mm FROM k WHERE k <= 5""")
def candidate_topk(spark, sf):
    l = link_view(spark).withColumn("link", F.col("link_id"))
    c = matching.candidates(gps_view(spark, sf), l, matching.Model(buffer_m=150.0, top_k=5))
    return c.select("agent_id", "seq", F.col("link").alias("link_id"), milli("dist_m").alias("dist_mm"), milli("along_m").alias("along_mm"))


def _lattice(spark: SparkSession) -> DataFrame:
    d = network.directed_links(link_view(spark))
    turn = lambda a, b: F.when(F.col("reverse"), F.col(b)).otherwise(F.col(a))
    return d.select((F.col("link_id") * 2 + F.col("reverse").cast("int")).cast("bigint").alias("link"), F.col("from_node").cast("bigint").alias("from_node"), F.col("to_node").cast("bigint").alias("to_node"), turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))


LATTICE = f"""lv AS ({LINK_SQL}), edges AS (SELECT from_node AS f, to_node AS t, length FROM lv WHERE dir IN (0, 1) UNION SELECT to_node, from_node, length FROM lv WHERE dir IN (0, -1))"""


@query(f"""WITH RECURSIVE {LATTICE}, walk(o, d, cost) USING KEY (o, d) AS (
  SELECT f, f, CAST(0 AS DOUBLE) FROM edges GROUP BY f
  UNION SELECT w.o, e.t, min(w.cost + e.length) FROM walk w JOIN edges e ON w.d = e.f LEFT JOIN recurring.walk k ON k.o = w.o AND k.d = e.t
  WHERE w.cost + e.length <= 600 AND (k.cost IS NULL OR w.cost + e.length < k.cost) GROUP BY w.o, e.t)
SELECT o, d, {_milli('cost')} AS cost_mm FROM walk WHERE o <> d""")
def shortest_path_cost(spark, sf):
    e = _lattice(spark).select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.lit(100.0).alias("length"))
    return matching.bounded_paths(e, 600.0).select("o", "d", milli("cost").alias("cost_mm"))


@query(SQL["shortest_path_cost"].replace("<= 600", "<= 300"))
def relaxed_path_cost(spark, sf):
    e = _lattice(spark).select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.lit(100.0).alias("length"))
    return matching.relaxed_costs(e, 300.0).select("o", "d", milli("cost").alias("cost_mm"))


MODEL = matching.Model(buffer_m=120.0, top_k=6, cutoff_m=800.0)


def _some_points(spark: SparkSession, sf: str) -> DataFrame:
    return gps_view(spark, sf)


@query(f"""{GPS}, lv AS ({LINK_SQL}),
dl AS (SELECT link_id * 2 AS link, x1, y1, x2, y2 FROM lv WHERE dir IN (0, 1) UNION ALL SELECT link_id * 2 + 1, x2, y2, x1, y1 FROM lv WHERE dir IN (0, -1)),
v AS (SELECT agent_id, seq, x_m, y_m, coalesce(lead(x_m) OVER w, x_m) - coalesce(lag(x_m) OVER w, x_m) AS gx, coalesce(lead(y_m) OVER w, y_m) - coalesce(lag(y_m) OVER w, y_m) AS gy FROM gps {W}),
c AS (SELECT agent_id, seq, link, gx, gy, x2 - x1 AS dx, y2 - y1 AS dy, x_m, y_m, x1, y1, greatest(0.0, least(1.0, ((x_m - x1) * (x2 - x1) + (y_m - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) AS f
  FROM v JOIN dl ON x_m BETWEEN least(x1, x2) - 120 AND greatest(x1, x2) + 120 AND y_m BETWEEN least(y1, y2) - 120 AND greatest(y1, y2) + 120),
d AS (SELECT *, sqrt((x_m - (x1 + f * dx)) * (x_m - (x1 + f * dx)) + (y_m - (y1 + f * dy)) * (y_m - (y1 + f * dy))) AS dist FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY agent_id, seq ORDER BY dist, link) AS k FROM d WHERE dist <= 120),
a AS (SELECT *, CASE WHEN sqrt(gx * gx + gy * gy) > 6 THEN least(179.9, degrees(acos(greatest(-1.0, least(1.0, (gx * dx + gy * dy) / (sqrt(gx * gx + gy * gy) * sqrt(dx * dx + dy * dy))))))) ELSE 0 END AS off FROM k WHERE k <= 6)
SELECT agent_id, seq, CAST(row_number() OVER (PARTITION BY agent_id, seq ORDER BY link) - 1 AS INT) AS state, link, {_milli("ln([1.0, 1.0, 1.0, 0.9, 0.8, 0.7, 0.6, 0.6, 0.5][CAST(floor(off / 20) AS INT) + 1]) - 0.5 * pow(0.1 * dist / 30, 2)")} AS emission_m FROM a""")
def emission_logp(spark, sf):
    p = _some_points(spark, sf)
    c = matching.emission(matching.with_state(matching.candidates(p, _lattice(spark), MODEL)), p, MODEL)
    return c.select("agent_id", "seq", "state", "link", milli("emission").alias("emission_m"))


@query()
def match_links(spark, sf):
    return matching.match(_some_points(spark, sf), _lattice(spark), MODEL)


@query()
def match_completed(spark, sf):
    p, l = _some_points(spark, sf), _lattice(spark)
    m = staged(matching.match(p, l, MODEL))
    e = l.select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.lit(100.0).alias("length"))
    paths = matching.bounded_paths(e, MODEL.cutoff_m, m.select(F.col("to_node").alias("o")))
    return matching.completed(m, p, paths, l).select("agent_id", "seq", "sub_seq", "link", "from_node", "to_node", milli("t_s").alias("t_ms"), milli("along_m").alias("along_mm"))


def _zone(spark: SparkSession, sf: str) -> Column:
    """The zone of the middle of the road network; all of it is projected there."""
    xy = point_xy(F.col("geometry"))
    return F.lit(spark.read.parquet(f"{sf}/node_layer.parquet").select(projection.utm_zone(F.avg(xy["x"])).alias("z")).first()["z"])


def _roads(spark: SparkSession, sf: str) -> DataFrame:
    """link, from_node, to_node, pts in metres of every direction of link_layer that can be driven."""
    zone = _zone(spark, sf)

    def planar(p: Column) -> Column:
        x, y = projection.to_utm(p["x"], p["y"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    d = network.directed_links(_links(spark, sf).withColumn("pts", F.transform(line_points(F.col("geometry")), planar)), "pts")
    return staged(d.select((F.col("link_id") * 2 + F.col("reverse").cast("int")).alias("link"), "from_node", "to_node", "pts"))


def _road_points(spark: SparkSession, sf: str) -> DataFrame:
    """agent_id (agent and first second of the session), seq, t_s, x_m, y_m of the located events on the globe."""
    e = session_events(spark.read.parquet(f"{sf}/example_sparse_gps.parquet")).where("lng between -180 and 180 and lat between -80 and 84")
    x, y = projection.to_utm(F.col("lng"), F.col("lat"), _zone(spark, sf))
    e = e.select(F.concat_ws("/", "agent_id", "start_s").alias("agent_id"), F.col("s").alias("t_s"), x.alias("x_m"), y.alias("y_m"))
    # shuffled by what sequences are matched by
    seq = F.row_number().over(Window.partitionBy("agent_id").orderBy("t_s")) - 1
    return e.withColumn("seq", seq.cast("bigint")).select("agent_id", "seq", "t_s", "x_m", "y_m")


def _by_session(matched: DataFrame) -> DataFrame:
    at = r"^(.*)/(-?\d+)$"
    return matched.select(F.regexp_extract("agent_id", at, 1).alias("agent_id"), F.regexp_extract("agent_id", at, 2).cast("bigint").alias("start_s"), *[c for c in matched.columns if c != "agent_id"])


@query()
def road_path_cost(spark, sf):
    e = matching.link_edges(_roads(spark, sf))
    return matching.with_long_links(staged(matching.bounded_paths(e, matching.Model().cutoff_m)), e).select("o", "d", milli("cost").alias("cost_mm"))


@query()
def match_roads(spark, sf):
    return _by_session(matching.match(_road_points(spark, sf), _roads(spark, sf)))


@query()
def match_roads_completed(spark, sf):
    p, l = _road_points(spark, sf), _roads(spark, sf)
    g = staged(matching.gaps(p, l))
    paths = staged(matching.bounded_paths(matching.link_edges(l), matching.Model().cutoff_m, g.select(F.col("to_node").alias("o"))))
    return _by_session(matching.filled(g, paths, l).select("agent_id", "seq", "sub_seq", "link", "from_node", "to_node", "t_s", "x_m", "y_m", "along_m"))


@query("""WITH RECURSIVE e AS (SELECT from_node AS a, to_node AS b FROM link_layer WHERE from_node IS NOT NULL AND to_node IS NOT NULL UNION SELECT to_node, from_node FROM link_layer WHERE from_node IS NOT NULL AND to_node IS NOT NULL),
reach(node, c) USING KEY (node) AS (
  SELECT a, a FROM e GROUP BY a
  UNION SELECT e.b, min(r.c) FROM reach r JOIN e ON e.a = r.node LEFT JOIN recurring.reach k ON k.node = e.b WHERE r.c < k.c GROUP BY e.b)
SELECT node, c AS component FROM reach""")
def network_components(spark, sf):
    return network.components(_links(spark, sf).select(F.col("from_node").alias("a"), F.col("to_node").alias("b")))


@query(f"""WITH RECURSIVE n AS (SELECT node_id, CAST(regexp_extract(geometry, '\\(\\s*(\\S+)\\s+(\\S+?)\\s*\\)', 1) AS DOUBLE) * 90000 AS x, CAST(regexp_extract(geometry, '\\(\\s*(\\S+)\\s+(\\S+?)\\s*\\)', 2) AS DOUBLE) * 111000 AS y FROM node_layer),
near AS (SELECT a.node_id AS a, b.node_id AS b FROM n a JOIN n b ON a.node_id <> b.node_id AND b.x BETWEEN a.x - 40 AND a.x + 40 AND b.y BETWEEN a.y - 40 AND a.y + 40 WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1600),
reach(node, c) USING KEY (node) AS (
  SELECT node_id, node_id FROM n UNION SELECT e.b, min(r.c) FROM reach r JOIN near e ON e.a = r.node LEFT JOIN recurring.reach k ON k.node = e.b WHERE r.c < k.c GROUP BY e.b),
deg AS (SELECT n, count(DISTINCT m) AS d FROM (SELECT from_node AS n, to_node AS m FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1) UNION ALL SELECT to_node, from_node FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1)) GROUP BY n)
SELECT node AS node_id, first_value(node) OVER (PARTITION BY c ORDER BY coalesce(d, 0) DESC, node) AS kept_id FROM reach LEFT JOIN deg ON deg.n = node""")
def min_gap_merge(spark, sf):
    xy = point_xy(F.col("geometry"))
    nodes = spark.read.parquet(f"{sf}/node_layer.parquet").select("node_id", (xy["x"] * 90000).alias("x"), (xy["y"] * 111000).alias("y"))
    return network.merge_near_nodes(nodes, _links(spark, sf), 40.0)[0]


@query(f"WITH d AS ({SQL['node_degree']}) SELECT node_id FROM d WHERE degree = 2 AND out_degree = in_degree AND out_degree IN (1, 2)")
def chain_nodes(spark, sf):
    return network.chain_nodes(_links(spark, sf))


@query(f"""WITH RECURSIVE d AS ({SQL['node_degree']}), inn AS (SELECT node_id FROM d WHERE degree = 2 AND out_degree = in_degree AND out_degree IN (1, 2)),
l AS (SELECT link_id, from_node, to_node FROM link_layer WHERE from_node <> to_node AND dir IN (0, 1, -1)),
ends AS (SELECT link_id, from_node AS n FROM l UNION ALL SELECT link_id, to_node FROM l),
e AS (SELECT DISTINCT a.link_id AS a, b.link_id AS b FROM ends a JOIN ends b USING (n) JOIN inn ON inn.node_id = a.n),
reach(link_id, c) USING KEY (link_id) AS (
  SELECT link_id, link_id FROM l GROUP BY link_id
  UNION SELECT e.b, min(r.c) FROM reach r JOIN e ON e.a = r.link_id LEFT JOIN recurring.reach k ON k.link_id = e.b WHERE r.c < k.c GROUP BY e.b)
SELECT link_id, c AS chain FROM reach""")
def link_chains(spark, sf):
    return network.chains(_links(spark, sf))


@query("""WITH g AS (SELECT unnest(generate_series(0, 11)) AS id)
SELECT id + 1 AS grid_id, id // 4 AS dx, id % 4 AS dy, CAST(id % 4 * 2000 AS DOUBLE) AS xmin, CAST(3000 - id // 4 * 2000 - 2000 AS DOUBLE) AS ymin, CAST(id % 4 * 2000 + 2000 AS DOUBLE) AS xmax, CAST(3000 - id // 4 * 2000 AS DOUBLE) AS ymax
FROM g WHERE id % 4 * 2000 <= 5000 AND 3000 - id // 4 * 2000 >= 0""")
def fishnet_grid(spark, sf):
    return grids.fishnet(spark, 0.0, 0.0, 5000.0, 3000.0, 2000.0)


_SHIFT = """, x{n} AS (SELECT *, lng{n} - 105 AS x, lat{n} - 35 AS y, radians(lat{n}) AS phi, 20 * sin(6 * pi() * (lng{n} - 105)) + 20 * sin(2 * pi() * (lng{n} - 105)) AS w FROM {table}),
s{n} AS (SELECT *, 1 - 0.00669342162296594323 * sin(phi) * sin(phi) AS m,
  300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + (w + 20 * sin(pi() * x) + 40 * sin(pi() * x / 3) + 150 * sin(pi() * x / 12) + 300 * sin(pi() * x / 30)) * 2 / 3 AS u,
  -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + (w + 20 * sin(pi() * y) + 40 * sin(pi() * y / 3) + 160 * sin(pi() * y / 12) + 320 * sin(pi() * y / 30)) * 2 / 3 AS v FROM x{n}),
d{n} AS (SELECT ping_id, lng{n}, lat{n}, degrees(u * sqrt(m) / (6378245.0 * cos(phi))) AS dx{n}, degrees(v * m * sqrt(m) / (6378245.0 * (1 - 0.00669342162296594323))) AS dy{n} FROM s{n})"""


@query(
    """WITH p AS (SELECT ping_id, lng AS lng1, lat AS lat1, lng - 0.0065 AS bx, lat - 0.006 AS b_y FROM example_sparse_gps WHERE lng IS NOT NULL AND lat IS NOT NULL),
g AS (SELECT ping_id, sqrt(bx * bx + b_y * b_y) - 0.00002 * sin(b_y * pi() * 3000 / 180) AS z, atan2(b_y, bx) - 0.000003 * cos(bx * pi() * 3000 / 180) AS a FROM p),
q AS (SELECT ping_id, z * cos(a) AS lng2, z * sin(a) AS lat2 FROM g)"""
    + _SHIFT.format(n=1, table="p")
    + _SHIFT.format(n=2, table="q")
    + """ SELECT ping_id, CAST(floor((lng1 + dx1) * 1e6 + 0.5) AS BIGINT) AS lng_84_gc, CAST(floor((lat1 + dy1) * 1e6 + 0.5) AS BIGINT) AS lat_84_gc, CAST(floor((lng2 - dx2) * 1e6 + 0.5) AS BIGINT) AS lng_bd_84, CAST(floor((lat2 - dy2) * 1e6 + 0.5) AS BIGINT) AS lat_bd_84
FROM d1 JOIN d2 USING (ping_id)"""
)
def datum_transform(spark, sf):
    p = spark.read.parquet(f"{sf}/example_sparse_gps.parquet").where("lng is not null and lat is not null").select("ping_id", "lng", "lat")
    u = lambda c: F.floor(c * 1e6 + 0.5).cast("bigint")
    for kind in ("84-gc", "bd-84"):
        x, y = projection.convert_datum(F.col("lng"), F.col("lat"), kind)
        p = p.withColumn(f"lng_{kind.replace('-', '_')}", u(x)).withColumn(f"lat_{kind.replace('-', '_')}", u(y))
    return p.drop("lng", "lat")


@query("""WITH p AS (SELECT ping_id, lng, lat, sqrt(lng * lng + lat * lat) + 0.00002 * sin(lat * pi() * 3000 / 180) AS z, atan2(lat, lng) + 0.000003 * cos(lng * pi() * 3000 / 180) AS a
  FROM example_sparse_gps WHERE lng IS NOT NULL AND lat IS NOT NULL)
SELECT ping_id, CAST(floor((z * cos(a) + 0.0065) * 1e6 + 0.5) AS BIGINT) AS lng_u, CAST(floor((z * sin(a) + 0.006) * 1e6 + 0.5) AS BIGINT) AS lat_u FROM p""")
def datum_gc_bd(spark, sf):
    p = spark.read.parquet(f"{sf}/example_sparse_gps.parquet").where("lng is not null and lat is not null")
    x, y = projection.convert_datum(F.col("lng"), F.col("lat"), "gc-bd")
    return p.select("ping_id", F.floor(x * 1e6 + 0.5).cast("bigint").alias("lng_u"), F.floor(y * 1e6 + 0.5).cast("bigint").alias("lat_u"))


def _utm_sql() -> str:
    """The series of the projection spelt out for a table p with lng and lat."""
    e, scale, rect = projection._E, projection.SCALE, projection._RECT
    alpha = projection._ALPHA
    xs = " + ".join(f"{a!r} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(alpha, 1))
    ys = " + ".join(f"{a!r} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(alpha, 1))
    return f"""WITH p AS (SELECT ping_id, lng, lat, greatest(1, least(60, CAST(floor((lng + 180) / 6) AS INT) + 1)) AS zone FROM example_sparse_gps WHERE lng BETWEEN -180 AND 180 AND lat BETWEEN -80 AND 84),
a AS (SELECT *, radians(lng - (zone * 6 - 183)) AS lam, 0.5 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) - {e!r} * 0.5 * ln((1 + {e!r} * sin(radians(lat))) / (1 - {e!r} * sin(radians(lat)))) AS q FROM p),
t AS (SELECT *, (exp(q) - exp(-q)) / 2 AS t FROM a),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, sin(lam) / sqrt(cos(lam) * cos(lam) + t * t) AS w FROM t),
h AS (SELECT *, ln(w + sqrt(w * w + 1)) AS eta FROM x)
SELECT ping_id, CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + zone AS epsg, CAST(floor(((eta + {xs}) * {scale * rect!r} + 500000) * 100 + 0.5) AS BIGINT) AS x_cm,
  CAST(floor(((xi + {ys}) * {scale * rect!r} + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END) * 100 + 0.5) AS BIGINT) AS y_cm FROM h"""


@query(_utm_sql())
def utm_projection(spark, sf):
    p = spark.read.parquet(f"{sf}/example_sparse_gps.parquet").where("lng between -180 and 180 and lat between -80 and 84").select("ping_id", "lng", "lat")
    zone = projection.utm_zone(F.col("lng"))
    x, y = projection.to_utm(F.col("lng"), F.col("lat"), zone)
    cm = lambda c: F.floor(c * 100 + 0.5).cast("bigint")
    return p.select("ping_id", projection.utm_epsg(F.col("lng"), F.col("lat")).alias("epsg"), cm(x).alias("x_cm"), cm(y).alias("y_cm"))


@query("SELECT count(*) AS n, CAST(sum(x_m) AS BIGINT) AS px, CAST(sum(y_m) AS BIGINT) AS py, CAST(sum(x_m * x_m) AS BIGINT) AS pxx, CAST(sum(x_m * y_m) AS BIGINT) AS pxy, CAST(sum(x_m * (2 * x_m - y_m + 7)) AS BIGINT) AS pxax FROM (" + GPS_SQL + ") g")
def helmert_fit(spark, sf):
    g = gps_view(spark, sf).select(F.col("x_m").alias("px"), F.col("y_m").alias("py"), (2 * F.col("x_m") - F.col("y_m") + 7).alias("ax"), (F.col("x_m") + 2 * F.col("y_m") - 3).alias("ay"))
    return grids.control_sums(g).select(*[F.col(c).cast("bigint").alias(c) for c in ("n", "px", "py", "pxx", "pxy", "pxax")])


@query(f"""{GPS}, s AS (SELECT count(*) AS n, sum(CAST(x_m AS DOUBLE)) AS px, sum(CAST(y_m AS DOUBLE)) AS py, sum(2.0 * x_m - y_m + 7) AS ax, sum(1.0 * x_m + 2.0 * y_m - 3) AS ay, sum(1.0 * x_m * x_m + 1.0 * y_m * y_m) AS q,
  sum(x_m * (2.0 * x_m - y_m + 7) + y_m * (1.0 * x_m + 2.0 * y_m - 3)) AS u, sum(x_m * (1.0 * x_m + 2.0 * y_m - 3) - y_m * (2.0 * x_m - y_m + 7)) AS v FROM gps),
f AS (SELECT *, (u - (px * ax + py * ay) / n) / (q - (px * px + py * py) / n) AS a, (v - (px * ay - py * ax) / n) / (q - (px * px + py * py) / n) AS b FROM s)
SELECT CAST(floor(a * 1000 + 0.5) AS BIGINT) AS a_m, CAST(floor(b * 1000 + 0.5) AS BIGINT) AS b_m, CAST(floor((ax - a * px + b * py) / n * 1000 + 0.5) AS BIGINT) AS dx_m, CAST(floor((ay - b * px - a * py) / n * 1000 + 0.5) AS BIGINT) AS dy_m FROM f""")
def helmert_matrix(spark, sf):
    g = gps_view(spark, sf).select(F.col("x_m").alias("px"), F.col("y_m").alias("py"), (2 * F.col("x_m") - F.col("y_m") + 7).alias("ax"), (F.col("x_m") + 2 * F.col("y_m") - 3).alias("ay"))
    m = grids.fit(g, "helmert")
    whole = lambda v: int(math.floor(v * 1000 + 0.5))
    return spark.createDataFrame([(whole(m[0, 0]), whole(m[0, 1]), whole(m[2, 0]), whole(m[2, 1]))], "a_m bigint, b_m bigint, dx_m bigint, dy_m bigint")


@query()
def link_segments(spark, sf):
    return network.segments(_links(spark, sf).withColumn("pts", line_points(F.col("geometry"))))


@query(r"""WITH v AS (SELECT link_id, string_split(regexp_extract(geometry, '\((.*)\)', 1), ',') AS v FROM link_layer),
e AS (SELECT link_id, CAST(split_part(trim(v[1]), ' ', 1) AS DOUBLE) AS ax, CAST(split_part(trim(v[1]), ' ', 2) AS DOUBLE) AS ay, CAST(split_part(trim(v[-1]), ' ', 1) AS DOUBLE) AS bx, CAST(split_part(trim(v[-1]), ' ', 2) AS DOUBLE) AS b_y FROM v WHERE len(v) > 1),
n AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS id FROM (SELECT ax AS x, ay AS y FROM e UNION SELECT bx, b_y FROM e)),
l AS (SELECT link_id, a.id AS from_node, b.id AS to_node FROM e JOIN n a ON a.x = ax AND a.y = ay JOIN n b ON b.x = bx AND b.y = b_y WHERE a.id <> b.id)
SELECT link_id, from_node, to_node, 0 AS dir FROM (SELECT *, row_number() OVER (PARTITION BY from_node, to_node ORDER BY link_id) AS k FROM l) WHERE k = 1""")
def nodes_from_lines(spark, sf):
    # degrees have no length, so that of the lines is left out
    return network.nodes_from_ends(_links(spark, sf).select("link_id", line_points(F.col("geometry")).alias("pts")))[1].drop("pts", "length")


@query(r"""WITH p AS (SELECT od_id, unnest(string_split(way_points, ';')) AS q FROM od_table WHERE way_points IS NOT NULL)
SELECT od_id, count(*) AS n FROM p WHERE try_cast(trim(split_part(q, ',', 1)) AS DOUBLE) IS NOT NULL AND try_cast(trim(split_part(q, ',', 2)) AS DOUBLE) IS NOT NULL GROUP BY od_id""")
def od_way_points(spark, sf):
    od = spark.read.parquet(f"{sf}/od_table.parquet")
    return od.select("od_id", F.explode(way_points(F.col("way_points")))).groupBy("od_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT od_id, CAST(floor(2 * 6371008.8 * asin(sqrt(pow(sin(radians(d_y - o_y) / 2), 2) + cos(radians(o_y)) * cos(radians(d_y)) * pow(sin(radians(d_x - o_x) / 2), 2))) + 0.5) AS BIGINT) AS dist_m FROM od_table")
def od_distance(spark, sf):
    od = spark.read.parquet(f"{sf}/od_table.parquet")
    return od.select("od_id", F.floor(great_circle_m(F.col("o_x"), F.col("o_y"), F.col("d_x"), F.col("d_y")) + 0.5).cast("bigint").alias("dist_m"))


@query("""WITH c AS (SELECT *, (o_x + d_x) / 2 + (d_y - o_y) * 0.25 AS cx, (o_y + d_y) / 2 - (d_x - o_x) * 0.25 AS cy, unnest(generate_series(0, 19)) AS k FROM od_table),
t AS (SELECT *, k / 19.0 AS t, 1 - k / 19.0 AS u FROM c)
SELECT od_id, CAST(k AS INT) AS k, CAST(floor((u * u * o_x + 2 * u * t * cx + t * t * d_x) * 1e6 + 0.5) AS BIGINT) AS x_u, CAST(floor((u * u * o_y + 2 * u * t * cy + t * t * d_y) * 1e6 + 0.5) AS BIGINT) AS y_u FROM t""")
def od_curves(spark, sf):
    od = spark.read.parquet(f"{sf}/od_table.parquet")
    ends = [F.col(c) for c in ("o_x", "o_y", "d_x", "d_y")]
    u = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(f"{c[-1]}_u")
    return od.select("od_id", F.posexplode(grids.bezier(*ends)).alias("k", "p")).select("od_id", "k", u("p.x"), u("p.y"))


QUERIES = Q
ORACLE = SQL
