"""Runs of near-identical consecutive events as regex matches over symbol strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import EARTH_RADIUS_M, great_circle_m
from trackloom.operators.pings import SESSION_GAP_S, by_day, usable_pings
from trackloom.plans.stage import staged

#: First code point and number of code points of the symbols; none of them is a line end.
SYMBOL_BASE, SYMBOLS = 0x4E00, 20_000

END = "start_s: bigint, end_s: bigint, n: bigint, lng: double, lat: double"
FOUND = f"agent_id string, day bigint, first_s bigint, last_s bigint, broken boolean, head struct<{END}>, tail struct<{END}>, runs array<struct<start_s: bigint, end_s: bigint, n: bigint>>"


def _metres(lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """From each position to the next one."""
    a, b = np.radians(lng), np.radians(lat)
    h = np.sin(np.diff(b) / 2) ** 2 + np.cos(b[1:]) * np.cos(b[:-1]) * np.sin(np.diff(a) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _spans(near_m: float, least: int, gap_s: int):
    pattern, first_run = re.compile(r"(.)\1{%d,}" % (least - 1), re.S), re.compile(r"(.)\1*", re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
            t, lng, lat = flat("s").astype(np.int64), flat("lng").astype(float), flat("lat").astype(float)
            pack = np.repeat(np.arange(b.num_rows), np.diff(b.column("s").offsets.to_numpy()))
            # deliveries of one second are one event, with the greatest position if they differ
            order = np.lexsort((-lat, -lng, t, pack))
            t, lng, lat, pack = t[order], lng[order], lat[order], pack[order]
            keep = np.concatenate([[True], (np.diff(t) != 0) | (np.diff(pack) != 0)])
            t, lng, lat, pack = t[keep], lng[keep], lat[keep], pack[keep]
            seg = np.cumsum(np.concatenate([[0], (np.diff(t) > gap_s) | (np.diff(pack) != 0)]))
            at = np.searchsorted(pack, np.arange(b.num_rows + 1))
            here = np.flatnonzero(~(np.isnan(lng) | np.isnan(lat)))
            with np.errstate(invalid="ignore"):
                far = _metres(lng[here], lat[here]) <= near_m
            island = np.cumsum(np.concatenate([[0], ~far | (np.diff(seg[here]) != 0)])) if len(here) else here
            text = (SYMBOL_BASE + island % SYMBOLS).astype("<u2").tobytes().decode("utf-16-le")
            place = np.searchsorted(pack[here], np.arange(b.num_rows + 1))
            agents, days = b.column("agent_id").to_pylist(), b.column("day").to_pylist()
            rows = []
            end = lambda i, j, k: {"start_s": int(t[here[i]]), "end_s": int(t[here[j - 1]]), "n": j - i, "lng": float(lng[here[k]]), "lat": float(lat[here[k]])}
            for p in range(b.num_rows):
                first, last = int(at[p]), int(at[p + 1]) - 1
                i, j = int(place[p]), int(place[p + 1])
                head = tail = None
                runs: list[dict] = []
                if j > i:
                    h = first_run.match(text, i, j).end()
                    k = i + int(np.searchsorted(island[i:j], island[j - 1]))
                    # groups at the ends of a day may go on beyond it, if no session begins or ends in between
                    if seg[here[i]] == seg[first]:
                        head = end(i, h, i)
                    if seg[here[j - 1]] == seg[last]:
                        tail = end(k, j, j - 1)
                    for m, n, kept in ((i, h, head), (k, j, tail)) if h < j else ((i, j, head or tail),):
                        if kept is None and n - m >= least:
                            runs.append({"start_s": int(t[here[m]]), "end_s": int(t[here[n - 1]]), "n": n - m})
                    for m in pattern.finditer(text, h, max(h, k)):
                        runs.append({"start_s": int(t[here[m.start()]]), "end_s": int(t[here[m.end() - 1]]), "n": m.end() - m.start()})
                rows.append({"agent_id": agents[p], "day": days[p], "first_s": int(t[first]), "last_s": int(t[last]), "broken": bool(seg[first] != seg[last]), "head": head, "tail": tail, "runs": runs})
            one = pa.struct([("start_s", pa.int64()), ("end_s", pa.int64()), ("n", pa.int64()), ("lng", pa.float64()), ("lat", pa.float64())])
            kinds = {"agent_id": pa.string(), "day": pa.int64(), "first_s": pa.int64(), "last_s": pa.int64(), "broken": pa.bool_(), "head": one, "tail": one, "runs": pa.list_(pa.struct([("start_s", pa.int64()), ("end_s", pa.int64()), ("n", pa.int64())]))}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return run


def position_runs(raw: DataFrame, near_m: float = 5.0, least: int = 3, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """agent_id, start_s, end_s, n_events, duration_s of each run of events that stay where they are.

    Located events of a session are canonicalised: an event at most ``near_m``
    from the one before it keeps that one's symbol, any other takes the next code
    point.  The symbols of an agent's day, at most 86,400, are concatenated, the
    backreference ``(.)\\1+`` finds the repetitions and the spans are mapped back
    to times.  Neighbouring groups always differ in their symbol, so a match is
    exactly one maximal run.

    A run may reach over midnight: of each day the first and last group come out
    with their end positions, and where the session goes on and the next day's
    first position is near, a window over these few rows joins them, so that a
    device parked for months is one run.  Events without a position are passed
    over; a run shorter than ``least`` isn't reported; deliveries of one second
    are one event; unusable rows are left out; an empty table gives no rows;
    further columns are ignored.
    """
    e = F.collect_list(F.struct("s", "lng", "lat"))
    packed = by_day(usable_pings(raw)).groupBy("agent_id", "day").agg(e.alias("e")).select("agent_id", "day", F.col("e.s").alias("s"), F.col("e.lng").alias("lng"), F.col("e.lat").alias("lat"))
    found = staged(packed.mapInArrow(_spans(near_m, least, gap_s), FOUND))
    within = found.select("agent_id", F.explode("runs").alias("r")).select("agent_id", "r.*")
    by_agent = Window.partitionBy("agent_id").orderBy("day")
    was = F.lag(F.struct("last_s", "broken", "tail")).over(by_agent)
    # the last group of an earlier day can go on, unless a session ended since
    cut = F.col("_was.last_s").isNull() | (F.col("first_s") - F.col("_was.last_s") > gap_s) | (F.col("_was.broken") & F.col("_was.tail").isNull())
    days = found.select("agent_id", "day", "first_s", "last_s", "broken", "head", "tail").withColumn("_was", was)
    days = days.withColumn("_chain", F.sum(cut.cast("int")).over(by_agent.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("agent_id", "_chain").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_from", F.last("tail", ignorenulls=True).over(chain))
    near = great_circle_m(F.col("_from.lng"), F.col("_from.lat"), F.col("head.lng"), F.col("head.lat")) <= near_m
    whole = F.col("head.start_s") == F.col("tail.start_s")
    piece = lambda c, new: F.struct(F.col(f"{c}.start_s").alias("start_s"), F.col(f"{c}.end_s").alias("end_s"), F.col(f"{c}.n").alias("n"), new.alias("new"))
    head = F.when(F.col("head").isNotNull(), piece("head", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)))
    tail = F.when(F.col("tail").isNotNull() & ~F.coalesce(whole, F.lit(False)), piece("tail", F.lit(1)))
    pieces = days.select("agent_id", "day", F.explode(F.array_compact(F.array(head, tail))).alias("p")).select("agent_id", "day", "p.*")
    order = Window.partitionBy("agent_id").orderBy("start_s").rowsBetween(Window.unboundedPreceding, 0)
    joined = pieces.withColumn("_run", F.sum("new").over(order)).groupBy("agent_id", "_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n").alias("n")).where(F.col("n") >= least)
    both = within.unionByName(joined.drop("_run"))
    return both.select("agent_id", "start_s", "end_s", F.col("n").alias("n_events"), (F.col("end_s") - F.col("start_s")).alias("duration_s"))
