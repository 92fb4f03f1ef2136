"""Queries on text corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import encode, mixing, runs, truncation
from trackloom.plans.pings_queries import DISTANCE_SQL, EVENTS_SQL
from trackloom.plans.registry import shipped


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.position_runs(spark.read.parquet(f"{sf}/example_sparse_gps.parquet"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_runs(spark, sf).select("agent_id", "start_s", "end_s")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.token_ids(_docs(spark, sf))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf), spark.read.parquet(f"{sf}/mix_targets.parquet"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet")
    return mixing.shares(mixing.mix(_docs(spark, sf), targets), targets)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_docs(spark, sf)).select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(_docs(spark, sf))


QUERIES = {f.__name__: shipped(f) for f in (p4_found, p4_runs, p7_ids, p8_mix, p8_shares, p9_found, p9_rates)}
_RUNS = f"""
steps AS (
  SELECT agent_id, session_no, s, CASE WHEN {DISTANCE_SQL.format(a1="lag(lng) OVER w", b1="lag(lat) OVER w", a2="lng", b2="lat")} <= 5 THEN 0 ELSE 1 END AS away
  FROM numbered WHERE lng IS NOT NULL WINDOW w AS (PARTITION BY agent_id, session_no ORDER BY s)),
islands AS (
  SELECT *, sum(away) OVER (PARTITION BY agent_id, session_no ORDER BY s) AS island FROM steps),
found AS (
  SELECT agent_id, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events FROM islands GROUP BY agent_id, session_no, island HAVING count(*) >= 3)
"""

ORACLE: dict[str, str] = {
    "p4_found": f"WITH {EVENTS_SQL}, {_RUNS} SELECT agent_id, start_s, end_s FROM found",
    "p4_runs": f"WITH {EVENTS_SQL}, {_RUNS} SELECT agent_id, start_s, end_s, end_s - start_s AS duration_s, n_events FROM found",
}
