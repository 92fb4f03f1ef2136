"""Cleaning of trajectories: windows over an agent's points in order.

Points have agent_id, seq, t_s (seconds), x_m and y_m (metres on a plane);
``seq`` orders an agent's points without ties.  Null coordinates give null gaps,
which count as no movement; empty tables give no rows; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_agent() -> Window:
    return Window.partitionBy("agent_id").orderBy("seq")


def plane_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def adjacent_gaps(points: DataFrame) -> DataFrame:
    """Adds dis_m and dt_s to the agent's next point; both 0 at its last one."""
    w = by_agent()
    dis = plane_distance(F.col("x_m"), F.col("y_m"), F.lead("x_m").over(w), F.lead("y_m").over(w))
    return points.withColumn("dis_m", F.coalesce(dis, F.lit(0.0))).withColumn("dt_s", F.coalesce(F.lead("t_s").over(w) - F.col("t_s"), F.lit(0)))


def remove_dwell(points: DataFrame, length_m: float = 5.0, n: int = 2) -> DataFrame:
    """Drops points that hardly move on, where there are more than ``n`` in a row.

    A point moves on if the next one is more than ``length_m`` away; an agent's
    last point always does.  A run of still points shares its island with the
    moving point before it; an island is dropped, but for that point, if it has
    more than n + 1 points.  Hence a run at an agent's very start needs one more.
    """
    w = by_agent()
    dis = plane_distance(F.col("x_m"), F.col("y_m"), F.lead("x_m").over(w), F.lead("y_m").over(w))
    moves = F.when(F.lead("seq").over(w).isNull() | (dis > length_m), 1).otherwise(0)
    island = F.sum("_moves").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = points.withColumn("_moves", moves).withColumn("_island", island)
    size = F.count(F.lit(1)).over(Window.partitionBy("agent_id", "_island"))
    return marked.withColumn("_size", size).where(~((F.col("_moves") == 0) & (F.col("_size") > n + 1))).drop("_moves", "_island", "_size")


def lower_frequency(points: DataFrame, n: int) -> DataFrame:
    """Keeps every n-th point of an agent, the first included."""
    return points.withColumn("_k", F.row_number().over(by_agent())).where((F.col("_k") - 1) % n == 0).drop("_k")


def rolling_average(points: DataFrame, window: int = 2) -> DataFrame:
    """x_m, y_m and t_s become means over the last ``window`` points, fewer at the start."""
    w = by_agent().rowsBetween(-(window - 1), 0)
    return points.select("agent_id", "seq", *[F.avg(c).over(w).alias(c) for c in ("t_s", "x_m", "y_m")])


def densify(points: DataFrame, interval_m: float = 120.0) -> DataFrame:
    """Adds evenly spaced points where the next one is farther than ``interval_m``.

    int(0.001 + d / interval) + 1 parts of equal length and time; seq is numbered
    anew; loc_type tells given points (s) from added ones (d).
    """
    w = by_agent()
    nxt = F.struct("t_s", "x_m", "y_m")
    p = points.withColumn("_n", F.lead(nxt).over(w))
    d = plane_distance(F.col("x_m"), F.col("y_m"), F.col("_n.x_m"), F.col("_n.y_m"))
    parts = F.when(d > interval_m, F.floor(d / interval_m + 0.001).cast("int") + 1).otherwise(1)
    p = p.withColumn("_parts", F.coalesce(parts, F.lit(1))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    along = lambda c: F.when(F.col("_k") == 0, F.col(c).cast("double")).otherwise(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * F.col("_k") / F.col("_parts")).alias(c)
    out = p.select("agent_id", F.col("seq").alias("_seq"), "_k", along("t_s"), along("x_m"), along("y_m"), F.when(F.col("_k") == 0, "s").otherwise("d").alias("loc_type"))
    number = F.row_number().over(Window.partitionBy("agent_id").orderBy("_seq", "_k")) - 1
    return out.withColumn("seq", number.cast("bigint")).drop("_seq", "_k")


def difference_heading(points: DataFrame) -> DataFrame:
    """Adds dx, dy and vec_len of the way from the previous to the next point; the ends stand for themselves."""
    w = by_agent()
    diff = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    p = points.withColumn("dx", diff("x_m")).withColumn("dy", diff("y_m"))
    return p.withColumn("vec_len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def trajectory_export(points: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Points with loc_type (given points, unless densified) and, joined on (agent_id, seq), the user's own columns."""
    p = points if "loc_type" in points.columns else points.withColumn("loc_type", F.lit("s"))
    if info is None:
        return p
    own = info.select("agent_id", "seq", *[F.col(c).alias(c if c not in p.columns else f"{c}_x") for c in info.columns if c not in ("agent_id", "seq")])
    return p.join(own, ["agent_id", "seq"], "left")


def run_ids(df: DataFrame, keys: list[str], order: list[str], value: list[str], name: str = "run") -> DataFrame:
    """Adds ``name``, from 1 in each of ``keys``: the number of the run of equal consecutive ``value``; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.struct(*value)
    new = F.when(F.lag(F.lit(1)).over(w).isNull() | ~F.lag(v).over(w).eqNullSafe(v), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _kernel(points: DataFrame, f, schema: str, buckets: int | None = None) -> DataFrame:
    """One call of ``f`` an agent, many agents a task; an agent's rows arrive sorted.

    Partitions are streamed, so a task holds one agent at a time and no pandas
    group is set up for every agent.
    """
    cols = ["agent_id", "seq", "t_s", "x_m", "y_m"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            a = b["agent_id"].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
            done: list[pd.DataFrame] = []
            for i, j in zip(edge, edge[1:]):
                if rest and rest[0]["agent_id"].iloc[0] != a[i]:
                    done.append(f(pd.concat(rest, ignore_index=True)))
                    rest = []
                rest.append(b.iloc[i:j])
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest:
            yield f(pd.concat(rest, ignore_index=True))

    return points.select(*cols).repartition("agent_id").sortWithinPartitions("agent_id", "seq").mapInPandas(run, schema)


def kalman_axis(z: np.ndarray, dt: np.ndarray, p: float, o: float) -> np.ndarray:
    """Forward filter of one axis with a state of position and velocity.

    Unit initial covariance, transition (1, dt), process noise p**2 I, observation
    noise o**2; the first observation passes through.
    """
    out = np.empty(len(z))
    if not len(z):
        return out
    x, v, a, b, d = float(z[0]), 0.0, 1.0, 0.0, 1.0
    out[0] = z[0]
    q, r = p * p, o * o
    for i in range(1, len(z)):
        h = dt[i - 1]
        x += h * v
        a, b, d = a + 2 * h * b + h * h * d + q, b + h * d, d + q
        gain_x, gain_v = a / (a + r), b / (a + r)
        e = z[i] - x
        x, v = x + gain_x * e, v + gain_v * e
        a, b, d = (1 - gain_x) * a, (1 - gain_x) * b, d - gain_v * b
        out[i] = x
    return out


def kalman_smooth(points: DataFrame, p: float = 0.01, o: float = 0.1) -> DataFrame:
    """agent_id, seq, t_s, x_m, y_m with filtered coordinates; the axes don't influence each other."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        dt = np.diff(g["t_s"].to_numpy(float))
        return g.assign(x_m=kalman_axis(g["x_m"].to_numpy(float), dt, p, o), y_m=kalman_axis(g["y_m"].to_numpy(float), dt, p, o), t_s=g["t_s"].astype(float))

    kind = dict(points.dtypes)["agent_id"]
    return _kernel(points, one, f"agent_id {kind}, seq bigint, t_s double, x_m double, y_m double")


def simplify_line(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places that the Douglas-Peucker rule keeps; an explicit stack instead of recursion."""
    keep = np.zeros(len(x), bool)
    if len(x):
        keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        ux, uy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        n = ux * ux + uy * uy
        f = np.clip((px * ux + py * uy) / n, 0, 1) if n else np.zeros(b - a - 1)
        d = np.hypot(px - f * ux, py - f * uy)
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def simplify(points: DataFrame, tolerance_m: float = 5.0) -> DataFrame:
    """Every point moved onto its agent's simplified line; as many rows as before.

    A point lies between two kept ones and is projected on their segment.  A
    single point stays where it is.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["x_m"].to_numpy(float), g["y_m"].to_numpy(float)
        kept = simplify_line(x, y, tolerance_m)
        if len(kept) > 1:
            k = np.clip(np.searchsorted(kept, np.arange(len(x)), side="right") - 1, 0, len(kept) - 2)
            a, b = kept[k], kept[k + 1]
            ux, uy = x[b] - x[a], y[b] - y[a]
            n = ux * ux + uy * uy
            f = np.clip(np.where(n > 0, ((x - x[a]) * ux + (y - y[a]) * uy) / np.where(n > 0, n, 1), 0), 0, 1)
            x, y = x[a] + f * ux, y[a] + f * uy
        return g.assign(x_m=x, y_m=y, t_s=g["t_s"].astype(float))

    kind = dict(points.dtypes)["agent_id"]
    return _kernel(points, one, f"agent_id {kind}, seq bigint, t_s double, x_m double, y_m double")


def gap_fill(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Nulls of ``value`` filled on the line by position between their neighbours; the ends take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(order)
    here = F.row_number().over(w)
    held = lambda c, back: (F.last if back else F.first)(c, ignorenulls=True).over(w.rowsBetween(*((Window.unboundedPreceding, 0) if back else (0, Window.unboundedFollowing))))
    d = df.withColumn("_k", here).withColumn("_at", F.when(F.col(value).isNotNull(), F.col("_k")))
    d = d.withColumn("_a", held(value, True)).withColumn("_b", held(value, False)).withColumn("_ka", held("_at", True)).withColumn("_kb", held("_at", False))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_k") - F.col("_ka")) / (F.col("_kb") - F.col("_ka"))
    filled = F.coalesce(F.col(value), F.when(F.col("_ka").isNotNull() & F.col("_kb").isNotNull(), line), F.col("_a"), F.col("_b"))
    return d.withColumn(value, filled).drop("_k", "_at", "_a", "_b", "_ka", "_kb")
