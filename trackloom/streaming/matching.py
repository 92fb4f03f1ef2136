"""Incremental map matching: the last points and their scores are carried from batch to batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.matching import GRAPH_ROWS, Graph, Model, Moves, link_edges, link_parts
from trackloom.plans.joins import fits

#: The overlapped points, and links and scores of the first one's candidates.
STATE = "t array<double>, x array<double>, y array<double>, links array<bigint>, zeta array<double>"
OUT = "agent_id string, t_s double, link bigint, dist_m double, revised boolean"


class Roads:
    """Segments of directed links with a cell index, for one worker."""

    def __init__(self, parts: dict[str, np.ndarray], m: Model) -> None:
        self.m, self.p = m, parts
        p, b = parts, m.buffer_m
        lo = [np.floor((np.minimum(p[f"{c}1"], p[f"{c}2"]) - b) / b).astype(int) for c in "xy"]
        hi = [np.floor((np.maximum(p[f"{c}1"], p[f"{c}2"]) + b) / b).astype(int) for c in "xy"]
        self.cells: dict[tuple[int, int], list[int]] = {}
        for i in range(len(p["link"])):
            for cx in range(lo[0][i], hi[0][i] + 1):
                for cy in range(lo[1][i], hi[1][i] + 1):
                    self.cells.setdefault((cx, cy), []).append(i)

    def near(self, x: float, y: float) -> dict[str, np.ndarray]:
        """The candidates of a place in order of link, each by its nearest segment."""
        p = self.p
        i = np.array(self.cells.get((int(x // self.m.buffer_m), int(y // self.m.buffer_m)), []), dtype=np.int64)
        ux, uy = p["x2"][i] - p["x1"][i], p["y2"][i] - p["y1"][i]
        n = ux * ux + uy * uy
        f = np.clip(((x - p["x1"][i]) * ux + (y - p["y1"][i]) * uy) / np.where(n > 0, n, 1), 0, 1)
        d = np.hypot(p["x1"][i] + f * ux - x, p["y1"][i] + f * uy - y)
        k = np.flatnonzero(d <= self.m.buffer_m)
        k = k[np.lexsort((p["part"][i][k], d[k], p["link"][i][k]))]
        k = k[np.concatenate([[True], np.diff(p["link"][i][k]) != 0])] if len(k) else k
        k = k[np.lexsort((p["link"][i][k], d[k]))][: self.m.top_k]
        k = k[np.argsort(p["link"][i][k])]
        at = i[k]
        return {"link": p["link"][at], "from_node": p["from_node"][at], "to_node": p["to_node"][at], "along_m": p["before"][at] + f[k] * np.sqrt(n[k]), "dist_m": d[k], "dx": ux[k], "dy": uy[k]}


def _emission(c: dict[str, np.ndarray], gx: float, gy: float, m: Model) -> np.ndarray:
    """As ``matching.emission``, the way from the point before to the one behind being (gx, gy)."""
    way = math.hypot(gx, gy)
    off = np.zeros(len(c["link"]))
    if m.use_heading and way > m.omitted_m:
        n = way * np.hypot(c["dx"], c["dy"])
        off = np.minimum(np.degrees(np.arccos(np.clip(np.where(n > 0, (gx * c["dx"] + gy * c["dy"]) / np.where(n > 0, n, 1), 1.0), -1, 1))), 179.9)
    factor = np.array(m.headings)[(off / (180.0 / len(m.headings))).astype(int)]
    return np.log(factor) - 0.5 * (m.dis_para * c["dist_m"] / m.sigma_m) ** 2


def match_stream(points: DataFrame, directed: DataFrame, m: Model = Model(), gap_s: float = 1800.0, gap_m: float = 600.0, overlap: int = 3) -> DataFrame:
    """agent_id, t_s, link, dist_m, revised for every point of a stream as soon as its batch is there.

    An agent's state is its last ``overlap`` matched points and the scores of the
    first one's candidates, at most ``top_k``.  A batch goes on from there unless
    the gap to its first point exceeds ``gap_s`` seconds or ``gap_m`` metres, else
    it begins anew: the overlapped points are matched again with what came after
    them and come out once more with ``revised`` true.  Silent agents are
    forgotten after ``gap_s``.  A batch's points not behind the state's last one
    are left out.  The links, straight or bent, are sent to the workers once; a
    network of more than GRAPH_ROWS links is matched in batches instead.
    """
    if not fits(directed, GRAPH_ROWS):
        raise ValueError(f"streams are matched on networks of at most {GRAPH_ROWS} directed links; use matching.match in foreachBatch beyond that")
    big = lambda c: F.col(c).cast("bigint").alias(c)
    table = link_parts(directed).select(big("link"), big("from_node"), big("to_node"), big("part"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "before")]).toArrow()
    parts = {c: table.column(c).to_numpy() for c in table.column_names}
    shared = directed.sparkSession.sparkContext.broadcast((parts, Graph.of(link_edges(directed))))
    made: list[tuple[Roads, Moves]] = []

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if not made:
            made.append((Roads(shared.value[0], m), Moves(shared.value[1], m)))
        roads, moves = made[0]
        g = pd.concat(list(frames)).sort_values("t_s", kind="stable")
        fresh = [(float(t), float(x), float(y)) for t, x, y in zip(g["t_s"], g["x_m"], g["y_m"])]
        old: list[tuple[float, float, float]] = []
        kept: tuple | None = None
        if state.exists:
            ts, xs, ys, links, zeta = state.get
            fresh = [p for p in fresh if p[0] > ts[-1]]
            if fresh and fresh[0][0] - ts[-1] <= gap_s and math.hypot(fresh[0][1] - xs[-1], fresh[0][2] - ys[-1]) <= gap_m:
                old, kept = list(zip(ts, xs, ys)), (links, zeta)
        rows: list[tuple] = []
        at = [(p, roads.near(p[1], p[2])) for p in [*old, *fresh]]
        at = [(p, c) for p, c in at if len(c["link"])]
        # runs of points without a break; the first may go on from the state
        run: list[tuple] = []

        def finish() -> None:
            j = int(run[-1][2].argmax())
            found = []
            for p, c, _, back in reversed(run):
                found.append((key[0], p[0], int(c["link"][j]), float(c["dist_m"][j]), p in old))
                j = int(back[j]) if back is not None else j
            rows.extend(found[::-1])

        for i, (p, c) in enumerate(at):
            joined = bool(run) and p[0] - run[-1][0][0] <= gap_s and math.hypot(p[1] - run[-1][0][1], p[2] - run[-1][0][2]) <= gap_m
            before = at[i - 1][0] if i and joined else p
            after = at[i + 1][0] if i + 1 < len(at) else p
            e = _emission(c, after[1] - before[1], after[2] - before[2], m)
            if joined:
                log_p, _, _ = moves.between(run[-1][1], c, math.hypot(p[1] - run[-1][0][1], p[2] - run[-1][0][2]), p[0] - run[-1][0][0])
                total = run[-1][2][:, None] + log_p
                back, z = total.argmax(axis=0), total.max(axis=0) + e
            else:
                if run:
                    finish()
                    run = []
                back, z = None, e - math.log(len(e))
                if i == 0 and kept is not None and kept[0] == c["link"].tolist():
                    z = np.array(kept[1])
            run.append((p, c, z - z.max(), back))  # only differences matter, and scores must not drift off
        if run:
            finish()
            last = run[-overlap:]
            state.update(([q[0][0] for q in last], [q[0][1] for q in last], [q[0][2] for q in last], last[0][1]["link"].tolist(), last[0][2].tolist()))
            state.setTimeoutDuration(int(gap_s * 1000))
        elif state.exists:
            state.setTimeoutDuration(int(gap_s * 1000))
        yield pd.DataFrame(rows, columns=["agent_id", "t_s", "link", "dist_m", "revised"])

    return points.groupBy("agent_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
