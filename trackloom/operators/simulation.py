"""Drives along routes, and what a receiver records of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.matching import pair_paths, random_paths


def simulate(routes: DataFrame, speed_mean: float = 10.0, speed_sd: float = 1.0, step_s: float = 1.0, seed: int = 0) -> DataFrame:
    """agent_id, t_s, x_m, y_m, heading: positions every ``step_s`` seconds along each route.

    ``routes`` has agent_id (text), o_time_s and pts array<struct<x,y>>.  Every
    leg has its own mean speed |N(mean, sd)| and every step a deviation of
    N(0, 0.2 v).  The generator's seed is derived from agent and seed alone, so a
    repeated task gives the same drive.
    """

    def drive(agent: str, t0: float, pts: list) -> pd.DataFrame:
        import zlib

        rng = np.random.default_rng([seed, zlib.crc32(agent.encode())])
        rows = []
        t = float(t0)
        for p, q in zip(pts, pts[1:]):
            dx, dy = q["x"] - p["x"], q["y"] - p["y"]
            length = float(np.hypot(dx, dy))
            v = max(0.1, abs(rng.normal(speed_mean, speed_sd)))
            s = 0.0
            while s < length:
                rows.append((agent, t, p["x"] + dx * s / length, p["y"] + dy * s / length, float(np.degrees(np.arctan2(dx, dy)) % 360)))
                s += max(0.05, v + rng.normal(0, 0.2 * v)) * step_s
                t += step_s
        if len(pts):
            rows.append((agent, t, pts[-1]["x"], pts[-1]["y"], rows[-1][4] if rows else 0.0))
        return pd.DataFrame(rows, columns=["agent_id", "t_s", "x_m", "y_m", "heading"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield drive(r.agent_id, r.o_time_s, list(r.pts) if r.pts is not None else [])

    return routes.select("agent_id", "o_time_s", "pts").mapInPandas(run, "agent_id string, t_s double, x_m double, y_m double, heading double")


def path_routes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """agent_id, o_time_s, pts of routes over nodes: ``paths`` has agent_id, o_time_s and path, ``nodes`` node_id, x, y; routes over unknown nodes keep those that are known."""
    at = nodes.select(F.col("node_id").cast("bigint").alias("node"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    legs = paths.select("agent_id", "o_time_s", F.posexplode("path").alias("k", "node")).join(at, "node")
    g = legs.groupBy("agent_id", "o_time_s").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("e"))
    return g.select("agent_id", "o_time_s", F.transform("e", lambda e: e["p"]).alias("pts"))


def od_routes(edges: DataFrame, nodes: DataFrame, od: DataFrame) -> DataFrame:
    """Routes along the shortest paths of requests: ``od`` has agent_id, o_time_s, o, d (nodes); unreachable ones have none."""
    found = pair_paths(edges, od.select("o", "d"))
    return path_routes(od.join(found, ["o", "d"]).select(F.col("agent_id").cast("string").alias("agent_id"), "o_time_s", "path"), nodes)


def random_routes(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0, span_s: int = 3600) -> DataFrame:
    """Routes between ``n`` pairs of nodes drawn by a seeded hash, starting within ``span_s`` seconds (a sampling operator)."""
    p = random_paths(edges, n, seed).where(F.size("path") > 1)
    start = F.pmod(F.xxhash64("o", "d", F.lit(seed)), F.lit(span_s)).cast("double")
    return path_routes(p.select(F.concat_ws("-", "o", "d").alias("agent_id"), start.alias("o_time_s"), "path"), nodes)


def record(drive: DataFrame, every_s: float = 5.0, mean_m: float = 0.0, sd_m: float = 10.0, heading_sd: float = 5.0, seed: int = 0) -> DataFrame:
    """What a receiver keeps: about one position in ``every_s`` seconds, off by 0.707 N(mean, sd) on both axes.

    Deviations come from a hash of agent, time and seed (Box-Muller), so they
    don't depend on how rows are partitioned.
    """
    u = lambda k: (F.pmod(F.xxhash64("agent_id", "t_s", F.lit(seed * 10 + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    normal = lambda k: F.sqrt(-2 * F.log(u(k))) * F.cos(u(k + 1) * (2 * np.pi))
    slot = F.floor((F.col("t_s") + normal(0) * (0.06 * every_s)) / every_s)
    first = drive.withColumn("_slot", slot).groupBy("agent_id", "_slot").agg(F.min(F.struct("t_s", "x_m", "y_m", "heading")).alias("p")).select("agent_id", "p.*")
    off = lambda k: (normal(k) * sd_m + mean_m) * 0.707106
    return first.select("agent_id", "t_s", (F.col("x_m") + off(2)).alias("x_m"), (F.col("y_m") + off(4)).alias("y_m"), F.pmod(F.col("heading") + normal(6) * heading_sd, F.lit(360.0)).alias("heading"))


def mixed(drive: DataFrame, recorded: DataFrame) -> DataFrame:
    """Both, told apart by ``type``."""
    return drive.withColumn("type", F.lit("trajectory")).unionByName(recorded.withColumn("type", F.lit("gps")))
