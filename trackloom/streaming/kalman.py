"""Incremental filtering and sessions over streams of points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: time, then position, velocity and the covariance (aa, ab, bb) of each axis.
STATE = "t double, x double, vx double, y double, vy double, aa double, ab double, bb double"
OUT = "agent_id string, t_s double, x_m double, y_m double"


def smooth_stream(points: DataFrame, p: float = 0.01, o: float = 0.1, gap_s: float = 1800.0) -> DataFrame:
    """agent_id, t_s, x_m, y_m filtered as the batches come in.

    ``points`` is a stream with agent_id (text), t_s, x_m, y_m.  An agent's state
    is its filter, eight numbers; a gap over ``gap_s`` starts it anew, silent
    agents are forgotten after as long.  Both axes share one covariance, as they
    have the same noise.  Rows at or before the state's time come out unfiltered.
    """
    q, r = p * p, o * o

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        g = pd.concat(list(frames)).sort_values("t_s", kind="stable")
        s = state.get if state.exists else None
        xs, ys = [], []
        for t, zx, zy in zip(g["t_s"], g["x_m"], g["y_m"]):
            if s is None or t - s[0] > gap_s:
                s = (float(t), float(zx), 0.0, float(zy), 0.0, 1.0, 0.0, 1.0)
            elif t > s[0]:
                t0, x, vx, y, vy, a, b, d = s
                h = t - t0
                x, y = x + h * vx, y + h * vy
                a, b, d = a + 2 * h * b + h * h * d + q, b + h * d, d + q
                k, kv = a / (a + r), b / (a + r)
                ex, ey = zx - x, zy - y
                s = (float(t), float(x + k * ex), float(vx + kv * ex), float(y + k * ey), float(vy + kv * ey), float((1 - k) * a), float((1 - k) * b), float(d - kv * b))
            else:
                xs.append(float(zx))
                ys.append(float(zy))
                continue
            xs.append(s[1])
            ys.append(s[3])
        state.update(s)
        state.setTimeoutDuration(int(gap_s * 1000))
        yield pd.DataFrame({"agent_id": key[0], "t_s": g["t_s"].astype(float).to_numpy(), "x_m": xs, "y_m": ys})

    return points.groupBy("agent_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_sessions(points: DataFrame, gap_s: int = 1800, late_s: int = 600) -> DataFrame:
    """agent_id, start, end, n_events of sessions, complete once the watermark has passed them; ``points`` has agent_id and a timestamp ts."""
    # a session window ends its gap after the last event; one microsecond more keeps a gap of exactly gap_s together
    window = F.session_window("ts", f"{gap_s * 1_000_000 + 1} microseconds")
    return points.withWatermark("ts", f"{late_s} seconds").groupBy("agent_id", window).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_events")).select("agent_id", "start", "end", "n_events")
