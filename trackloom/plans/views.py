"""Planar test views over the supplied tables, by integers, so that any engine agrees on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GPS_VIEW = """
WITH b AS (
  SELECT user_id AS agent_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM {events}),
s AS (
  SELECT agent_id, event_id, seq,
    15 + event_id % 7 + CASE WHEN event_id % 37 = 0 THEN 3600 ELSE 0 END AS dt,
    CASE WHEN CAST(floor(seq / 6.0) AS BIGINT) % 4 = 3 THEN 0 ELSE (event_id * 7919) % 41 - 10 END AS sx,
    CASE WHEN CAST(floor(seq / 6.0) AS BIGINT) % 4 = 3 THEN 0 ELSE (event_id * 104729) % 41 - 15 END AS sy
  FROM b)
SELECT agent_id, event_id, CAST(seq AS BIGINT) AS seq, CAST(sum(dt) OVER w AS BIGINT) AS t_s,
  CAST((agent_id % 40) * 100 + sum(sx) OVER w AS BIGINT) AS x_m, CAST((agent_id % 37) * 100 + sum(sy) OVER w AS BIGINT) AS y_m
FROM s WINDOW w AS (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

LINK_VIEW = """
SELECT link_id, from_node, to_node, CASE link_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS dir, CAST(100 AS DOUBLE) AS length, x1, y1, x2, y2
FROM (
  SELECT r * 49 + c + 1 AS link_id, r * 50 + c + 1 AS from_node, r * 50 + c + 2 AS to_node, c * 100 AS x1, r * 100 AS y1, c * 100 + 100 AS x2, r * 100 AS y2
  FROM {rr} CROSS JOIN {cc} WHERE c < 49
  UNION ALL
  SELECT 2450 + r * 50 + c + 1, r * 50 + c + 1, r * 50 + c + 51, c * 100, r * 100, c * 100, r * 100 + 100
  FROM {rr} CROSS JOIN {cc} WHERE r < 49) t
"""


def gps_view(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(GPS_VIEW, events=spark.read.parquet(f"{sf}/events.parquet"))


def link_view(spark: SparkSession) -> DataFrame:
    """A lattice of 4,900 links, whatever the scale."""
    return spark.sql(LINK_VIEW, rr=spark.range(50).toDF("r"), cc=spark.range(50).toDF("c"))


GPS_SQL = GPS_VIEW.format(events="events")
LINK_SQL = LINK_VIEW.format(rr="(SELECT range AS r FROM range(50))", cc="(SELECT range AS c FROM range(50))")
