"""Queries over the location pings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.wkt import point_xy
from trackloom.operators import gridding, near, pings, sessions, spikes, stops


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/example_sparse_gps.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return pings.day_events(_raw(spark, sf), before_s=pings.SESSION_GAP_S)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return gridding.session_grid(_raw(spark, sf)).where("not covered").select("agent_id", "period_s")


def p1_series(spark: SparkSession, sf: str) -> DataFrame:
    # to a millionth of a degree and a millimetre, as the order of sums is left to the engine
    near = lambda c, k: (F.floor(F.col(c) * k + 0.5) / k).alias(c)
    g = gridding.session_grid(_raw(spark, sf))
    return g.select("agent_id", "period_s", near("lng", 1e6), near("lat", 1e6), near("moved_m", 1e3), "n_located", "covered")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sweep_sessions(_events(spark, sf)).select("agent_id", "start_s", "end_s")


def p2_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sweep_sessions(_events(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.false_readings(_raw(spark, sf))


def p3_scores(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.score_readings(_raw(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf).where("lng is not null and lat is not null").select("ping_id", "lng", "lat")
    xy = point_xy(F.col("geometry"))
    nodes = spark.read.parquet(f"{sf}/node_layer.parquet").select(F.col("node_id").alias("target_id"), xy.alias("p")).select("target_id", F.col("p.x").alias("lng"), F.col("p.y").alias("lat"))
    regions = spark.read.parquet(f"{sf}/region_layer.parquet").select("region_id", "geometry")
    by_node = near.within_distance(raw, nodes, 15.0).select("ping_id", F.lit("node").alias("layer"), "target_id")
    by_region = near.containing_regions(raw, regions).select("ping_id", F.lit("region").alias("layer"), F.col("region_id").alias("target_id"))
    return by_node.unionByName(by_region)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return stops.stop_pings(_raw(spark, sf))


def p6_stops_trips(spark: SparkSession, sf: str) -> DataFrame:
    return stops.stops_and_trips(_raw(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_series, p2_found, p2_sessions, p3_found, p3_scores, p5_found, p6_found, p6_stops_trips)}

#: Usable pings, events, numbered events and sessions as common table expressions.
EVENTS_SQL = r"""
read_pings AS (
  SELECT ping_id, nullif(lower(regexp_replace(agent_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '') AS agent_id, trim(time) AS t, lng, lat
  FROM example_sparse_gps),
usable AS (
  SELECT ping_id, agent_id, lng, lat, CASE
    WHEN regexp_full_match(t, '\d{4}[-/]\d\d[-/]\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?Z?') THEN CAST(epoch(try_strptime(replace(replace(t[1:19], '/', '-'), 'T', ' '), '%Y-%m-%d %H:%M:%S')) AS BIGINT)
    WHEN regexp_full_match(t, '\d{4}[-/]\d\d[-/]\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?[+-]\d\d:\d\d') THEN CAST(epoch(try_strptime(replace(replace(t[1:19], '/', '-'), 'T', ' '), '%Y-%m-%d %H:%M:%S')) AS BIGINT)
      - (CASE WHEN t[-6] = '-' THEN -1 ELSE 1 END) * (CAST(t[-5:-4] AS BIGINT) * 3600 + CAST(t[-2:] AS BIGINT) * 60)
    WHEN regexp_full_match(t, '\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d') THEN CAST(epoch(try_strptime(t, '%d.%m.%Y %H:%M:%S')) AS BIGINT)
    WHEN regexp_full_match(t, '\d{14}') THEN CAST(epoch(try_strptime(t, '%Y%m%d%H%M%S')) AS BIGINT)
    WHEN regexp_full_match(t, '\d{10}') THEN CAST(t AS BIGINT)
    WHEN regexp_full_match(t, '\d{13}') THEN CAST(t AS BIGINT) // 1000 END AS s
  FROM read_pings),
ev AS (
  SELECT agent_id, s, max(CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN lng END) AS lng, max(CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN lat END) AS lat
  FROM usable WHERE agent_id IS NOT NULL AND s IS NOT NULL GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY agent_id ORDER BY s) <= 1800 THEN 0 ELSE 1 END AS opens FROM ev),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY agent_id ORDER BY s) AS session_no FROM marked),
sess AS (
  SELECT agent_id, session_no, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events FROM numbered GROUP BY ALL)
"""

DISTANCE_SQL = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians({b2} - {b1}) / 2), 2) + cos(radians({b1})) * cos(radians({b2})) * pow(sin(radians({a2} - {a1}) / 2), 2))))"

ORACLE = {
    "p1_found": f"""WITH {EVENTS_SQL}
SELECT agent_id, period_s FROM (
  SELECT agent_id, unnest(generate_series(start_s // 300 * 300, end_s // 300 * 300, 300)) AS period_s FROM sess) c
WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.agent_id = c.agent_id AND e.s // 300 * 300 = c.period_s AND e.lng IS NOT NULL)""",
    "p1_series": f"""WITH {EVENTS_SQL},
loc AS (SELECT agent_id, session_no, s, lng, lat, lag(s) OVER w AS ps, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat, {DISTANCE_SQL.format(a1="lag(lng) OVER w", b1="lag(lat) OVER w", a2="lng", b2="lat")} AS m
  FROM numbered WHERE lng IS NOT NULL WINDOW w AS (PARTITION BY agent_id, session_no ORDER BY s)),
cells AS (SELECT agent_id, unnest(generate_series(start_s // 300 * 300, end_s // 300 * 300, 300)) AS period_s FROM sess),
own AS (SELECT agent_id, s // 300 * 300 AS period_s, count(*) AS n, avg(lng) AS lng, avg(lat) AS lat FROM loc GROUP BY ALL),
seg AS (SELECT *, CASE WHEN abs(lng) <= 180 AND abs(plng) <= 180 THEN lng - plng - 360 * round((lng - plng) / 360) ELSE lng - plng END AS turn FROM loc WHERE s - ps <= 3600),
parts AS (SELECT *, unnest(generate_series(ps // 300 * 300, s // 300 * 300, 300)) AS period_s FROM seg),
mid AS (SELECT *, greatest(0, least(period_s + 300, s) - greatest(period_s, ps)) / CAST(s - ps AS DOUBLE) AS part, (period_s + 150.0 - ps) / CAST(s - ps AS DOUBLE) AS f FROM parts),
at_mid AS (SELECT *, CASE WHEN f BETWEEN 0 AND 1 THEN plng + turn * f END AS x, CASE WHEN f BETWEEN 0 AND 1 THEN plat + (lat - plat) * f END AS y FROM mid),
way AS (SELECT agent_id, period_s, sum(m * part) AS moved_m, max(CASE WHEN abs(lng) <= 180 AND abs(plng) <= 180 THEN x - 360 * round(x / 360) ELSE x END) AS lng, max(y) AS lat FROM at_mid GROUP BY ALL)
SELECT agent_id, period_s, floor(coalesce(o.lng, w.lng) * 1e6 + 0.5) / 1e6 AS lng, floor(coalesce(o.lat, w.lat) * 1e6 + 0.5) / 1e6 AS lat, floor(moved_m * 1e3 + 0.5) / 1e3 AS moved_m, coalesce(n, 0) AS n_located, n IS NOT NULL AS covered
FROM cells LEFT JOIN own o USING (agent_id, period_s) LEFT JOIN way w USING (agent_id, period_s)""",
    "p2_found": f"WITH {EVENTS_SQL} SELECT agent_id, start_s, end_s FROM sess",
    "p2_sessions": f"WITH {EVENTS_SQL} SELECT agent_id, start_s, end_s, end_s - start_s AS duration_s, n_events FROM sess",
    "p5_found": rf"""WITH nodes AS (
  SELECT node_id, CAST(regexp_extract(geometry, '\(\s*(\S+)\s+(\S+?)\s*\)', 1) AS DOUBLE) AS x, CAST(regexp_extract(geometry, '\(\s*(\S+)\s+(\S+?)\s*\)', 2) AS DOUBLE) AS y FROM node_layer),
bands AS (SELECT node_id, x, y, unnest([CAST(floor(y * 2000) AS BIGINT) - 1, CAST(floor(y * 2000) AS BIGINT), CAST(floor(y * 2000) AS BIGINT) + 1]) AS band FROM nodes),
p AS (SELECT ping_id, lng, lat, CAST(floor(lat * 2000) AS BIGINT) AS band FROM example_sparse_gps WHERE lng IS NOT NULL AND lat IS NOT NULL),
rings AS (
  SELECT region_id, part_no, list_transform(string_split(ring, ','), lambda c: list_transform(string_split_regex(trim(c), '\s+'), lambda v: CAST(v AS DOUBLE))) AS pts
  FROM (SELECT region_id, part_no, unnest(regexp_extract_all(part, '[^(),]+(?:,[^(),]+)+')) AS ring
        FROM (SELECT region_id, generate_subscripts(parts, 1) AS part_no, unnest(parts) AS part
              FROM (SELECT region_id, string_split_regex(geometry, '\)\s*\)\s*,\s*\(\s*\(') AS parts FROM region_layer WHERE geometry LIKE '%POLYGON%((%')))),
edges AS (
  SELECT region_id, part_no, pts[i][1] AS x1, pts[i][2] AS y1, pts[i % len(pts) + 1][1] AS x2, pts[i % len(pts) + 1][2] AS y2
  FROM (SELECT *, unnest(generate_series(1, len(pts))) AS i FROM rings)),
strips AS (
  SELECT *, unnest(generate_series(CAST(floor(least(y1, y2) * 500) AS BIGINT), CAST(floor(greatest(y1, y2) * 500) AS BIGINT))) AS strip FROM edges WHERE y1 <> y2),
inside AS (
  SELECT DISTINCT ping_id, region_id FROM (
    SELECT ping_id, region_id, part_no FROM (SELECT *, CAST(floor(lat * 500) AS BIGINT) AS strip FROM p) q JOIN strips s USING (strip)
    WHERE (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    GROUP BY ping_id, region_id, part_no HAVING count(*) % 2 = 1))
SELECT ping_id, 'node' AS layer, node_id AS target_id FROM p JOIN bands USING (band)
WHERE {DISTANCE_SQL.format(a1="lng", b1="lat", a2="x", b2="y")} <= 15
UNION ALL SELECT ping_id, 'region', region_id FROM inside""",
}
