"""Stops and trips by spatio-temporal density clustering of each session's events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import paths
from trackloom.functions.geo import EARTH_RADIUS_M
from trackloom.operators.pings import DAY_S, SESSION_GAP_S
from trackloom.operators.tracks import Days, agent_habits, over_batches, tracks
from trackloom.plans.joins import cell_join

LEAST_S, FAR_M = 300, 60.0

PARTS = "agent_id string, day bigint, kind string, start_s bigint, end_s bigint, distance_m double, lng double, lat double, n_events bigint, begins boolean, opens boolean, ping_ids array<bigint>"


def _steps(lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Great-circle metres from each position to the next."""
    a, b = np.radians(lng), np.radians(lat)
    h = np.sin(np.diff(b) / 2) ** 2 + np.cos(b[1:]) * np.cos(b[:-1]) * np.sin(np.diff(a) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _right_stays(d: Days, b: pa.RecordBatch, least_s: int, far_m: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The events with right positions, and the stays as their first and last event."""
    here = np.flatnonzero(d.located)
    h = d.habits(b, here)
    off, stale = paths.false_positions(d.seg[here], d.t[here], d.lng[here], d.lat[here], h)
    good = ~(off | stale)
    right = here[good]
    x, y = paths.plane(d.seg[right], d.lng[right], d.lat[right])
    found = paths.stays(d.seg[right], d.t[right], x, y, h.jitter[good], least_s, far_m)
    return right, [(int(right[p]), int(right[q])) for p, q in found]


def _stopped(least_s: int, far_m: float):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        d = Days(b)
        _, stays = _right_stays(d, b, least_s, far_m)
        at = np.zeros(len(d.t), dtype=bool)
        for a, z in stays:
            at[a : z + 1] = True
        return pa.RecordBatch.from_arrays([pa.array(d.ids_of(np.flatnonzero(at & d.core))[0])], names=["ping_id"])

    return run


def _parts(least_s: int, far_m: float):
    """Stops and trips of a batch of days, cut to the days' own seconds."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        d = Days(b)
        right, stays = _right_stays(d, b, least_s, far_m)
        step = np.zeros(len(d.t))
        if len(right):
            way = np.where(d.seg[right][1:] == d.seg[right][:-1], _steps(d.lng[right], d.lat[right]), 0.0)
            step[right[1:]] = way
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        first = paths.begins(d.seg)
        last = np.append(first[1:], len(d.seg))
        stop_at = 0
        for a, z in zip(first, last):
            mine: list[tuple[int, int]] = []
            while stop_at < len(stays) and stays[stop_at][0] < z:
                mine.append(stays[stop_at])
                stop_at += 1
            row = int(d.pack[a])
            lo, hi = d.day[row] * DAY_S, (d.day[row] + 1) * DAY_S
            edge = a
            for p, q in [*mine, (z, z)]:
                # a trip runs from the last event of a stop to the first of the next one
                i, j = (edge - 1 if edge > a else edge), (p if p < z else z - 1)
                pieces = [("trip", i, j, edge, p)] if d.t[j] > d.t[i] else []
                if p < z:
                    pieces.append(("stop", p, q, p, q + 1))
                    edge = q + 1
                for kind, i, j, m, n in pieces:
                    # the piece's seconds within the day; a piece that reaches over a border goes on in the next day
                    if d.t[j] < lo or d.t[i] >= hi:
                        continue
                    own = np.arange(m, n)
                    own = own[d.core[own]]
                    on = np.arange(i + 1, j + 1)
                    on = on[d.core[on]]
                    inside = right[(right >= p) & (right <= q)] if kind == "stop" else right[:0]
                    middle = (float(np.median(d.lng[inside])), float(np.median(d.lat[inside]))) if len(inside) else (None, None)
                    rows.append((b.column("agent_id")[row].as_py(), int(d.day[row]), kind, int(d.t[i]), int(d.t[j]), float(step[on].sum()), *middle, len(own), bool(d.t[i] >= lo), bool(i == a and d.t[i] >= lo)))
                    ids.append(d.ids_of(own)[0])
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        cols = list(zip(*rows)) if rows else [()] * 11
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)))], names=[c.split()[0] for c in PARTS.split(", ")])

    return run


def _with_habits(raw: DataFrame) -> DataFrame:
    packed = tracks(raw)
    return cell_join(packed, agent_habits(packed).drop("usual", "readings"), ["agent_id"])


def stops_and_trips(raw: DataFrame, least_s: int = LEAST_S, far_m: float = FAR_M) -> DataFrame:
    """Stops and the trips between them: agent_id, session_s, kind, start_s, end_s, duration_s, distance_m, lng, lat, n_events.

    Within a session (no gap over 1,800 s) false and stale positions are set
    aside by the source's own habits, the right ones are clustered by density in
    space and time (``paths.dense_clusters``), places of at least ``least_s``
    within ``far_m`` of their middle are stops, the ordered noise between them
    makes the trips.  distance_m is the way over the right positions; lng and lat
    are a stop's middle.  A trip's start and end are those of the stops it joins,
    or of the session.  Sessions without a position have one trip of 0 m if they
    last at all.

    Days are searched one by one, each with a halo of two hours.  A stop or trip
    that reaches over a day's border is found on both sides of it; its pieces,
    each with its own day's events and metres, are joined by a window over the
    parts, which are few.
    """
    parts = _with_habits(raw).mapInArrow(over_batches(_parts(least_s, far_m)), PARTS).drop("ping_ids")
    w = Window.partitionBy("agent_id").orderBy("day", "start_s", "end_s")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # a piece that began before its day goes on from the day before, if that ended with the same kind
    was = F.lag(F.struct("day", "kind", "end_s")).over(w)
    goes_on = ~F.col("begins") & (F.col("_was.kind") == F.col("kind")) & (F.col("_was.day") == F.col("day") - 1) & (F.col("_was.end_s") >= F.col("start_s"))
    p = parts.withColumn("_was", was).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    p = p.withColumn("_part", F.sum("_new").over(upto))
    g = p.groupBy("agent_id", "_part").agg(F.first("kind").alias("kind"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("distance_m").alias("distance_m"), F.min_by("lng", "day").alias("lng"), F.min_by("lat", "day").alias("lat"), F.sum("n_events").alias("n_events"))
    over = Window.partitionBy("agent_id").orderBy("start_s", "end_s")
    opened = F.when(F.coalesce(F.col("start_s") - F.lag("end_s").over(over) > SESSION_GAP_S, F.lit(True)), F.col("start_s"))
    g = g.withColumn("_opened", opened).withColumn("session_s", F.last("_opened", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("agent_id", "session_s", "kind", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "distance_m", "lng", "lat", "n_events")


def stop_pings(raw: DataFrame, least_s: int = LEAST_S, far_m: float = FAR_M) -> DataFrame:
    """ping_id of the usable pings made during a stop."""
    return _with_habits(raw).mapInArrow(over_batches(_stopped(least_s, far_m)), "ping_id bigint")
