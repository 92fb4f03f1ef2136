"""Days of events as arrays, and what each agent usually does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import paths
from trackloom.operators.pings import DAY_S, SESSION_GAP_S, day_packs
from trackloom.plans.stage import staged

#: Seconds before and behind a day that its kernels see as well.
HALO_S = 7_200
#: Bytes of a batch that a kernel sees at once; its arrays take many times as much.
PIECE_BYTES = 2 << 20


class Days:
    """One Arrow batch of ``day_packs`` as flat numpy arrays of events in order.

    Deliveries of one second are one event, with the greatest position if they
    differ; n_ids tells how many there are.  ``seg`` numbers the sessions, which
    end where the next event comes more than ``gap_s`` later or at the end of the
    halo; ``core`` tells the day's own events from those of its halo.
    """

    def __init__(self, b: pa.RecordBatch, gap_s: int = SESSION_GAP_S) -> None:
        self.agent = b.column("agent_id").to_pylist()
        self.day = b.column("day").to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        t, lng, lat, ids = flat("s").astype(np.int64), flat("lng").astype(float), flat("lat").astype(float), flat("ping_ids").astype(np.int64)
        pack = np.repeat(np.arange(b.num_rows), np.diff(b.column("s").offsets.to_numpy()))
        order = np.lexsort((-lat, -lng, t, pack))
        t, pack = t[order], pack[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(t) != 0) | (np.diff(pack) != 0)])) if len(t) else np.zeros(0, np.int64)
        self.ids = ids[order]
        self.t, self.lng, self.lat, self.pack = t[first], lng[order][first], lat[order][first], pack[first]
        self.n_ids = np.diff(np.append(first, len(t)))
        self.located = ~(np.isnan(self.lng) | np.isnan(self.lat))
        self.first_id = np.concatenate([[0], np.cumsum(self.n_ids)])
        self.seg = np.cumsum(np.concatenate([[0], (np.diff(self.t) > gap_s) | (np.diff(self.pack) != 0)])) if len(self.t) else np.zeros(0, np.int64)
        self.core = self.t // DAY_S == self.day[self.pack]

    def ids_of(self, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The deliveries of the given events and, for each, its event."""
        k = np.repeat(events, self.n_ids[events])
        inner = np.arange(len(k)) - np.repeat(np.cumsum(self.n_ids[events]) - self.n_ids[events], self.n_ids[events])
        return self.ids[self.first_id[k] + inner], k

    def habits(self, b: pa.RecordBatch, events: np.ndarray) -> paths.Habits:
        """The habits joined to the packs, for each of the given events."""
        return paths.Habits(*(b.column(c).to_numpy(zero_copy_only=False).astype(float)[self.pack[events]] for c in ("top", "jitter", "lines")))


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, in order, halved until a piece has PIECE_BYTES or is a single row."""
    if b.num_rows > 1 and b.nbytes > PIECE_BYTES:
        half = b.num_rows // 2
        yield from _pieces(b.slice(0, half))
        yield from _pieces(b.slice(half))
    elif b.num_rows:
        yield b


def over_batches(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over the pieces of all batches.

    ``f`` must treat rows apart, or give what is summed later.  Arrow batches are
    bounded by rows, and a row is a whole day; in pieces a worker's memory doesn't
    grow with the days in a batch or with their events.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b):
                yield f(piece)

    return run


def tracks(raw: DataFrame) -> DataFrame:
    """``day_packs`` with the halo of the kernels, staged."""
    return staged(day_packs(raw, HALO_S))


def _profile(b: pa.RecordBatch) -> pa.RecordBatch:
    d = Days(b)
    here = np.flatnonzero(d.located)
    names, owner = np.unique(np.array(d.agent, dtype=object).astype(str), return_inverse=True)
    c = paths.step_counts(d.seg[here], owner[d.pack[here]], d.core[here], d.t[here], d.lng[here], d.lat[here], len(names))
    at, k = np.nonzero(c)
    # an agent without a single position still needs a row
    at, k = np.concatenate([at, np.arange(len(names))]), np.concatenate([k, np.zeros(len(names), np.int64)])
    n = c[at, k]
    n[len(n) - len(names) :] = 0
    return pa.RecordBatch.from_arrays([pa.array(names[at], pa.string()), pa.array(k.astype(np.int32)), pa.array(n)], names=["agent_id", "k", "n"])


HABITS = "agent_id string, top double, jitter double, lines double, readings bigint, usual array<float>"


def agent_habits(packed: DataFrame) -> DataFrame:
    """HABITS of every agent.

    Counters over all steps (speeds, jitter, hours of day) add up, so they are
    summed before and after the shuffle and a hot agent costs no more than
    others; they are turned into habits where they arrive.  The sums over all
    agents, which stand in where an agent shows little, are COUNTERS numbers
    whatever the input.
    """
    by_agent = packed.mapInArrow(over_batches(_profile), "agent_id string, k int, n double").groupBy("agent_id", "k").agg(F.sum("n").alias("n")).groupBy("agent_id").agg(F.collect_list(F.struct("k", "n")).alias("c"))
    by_agent = staged(by_agent.select("agent_id", F.col("c.k").alias("ck"), F.col("c.n").alias("cn")))
    everyone = np.zeros(paths.COUNTERS)
    for r in by_agent.select(F.explode(F.arrays_zip("ck", "cn")).alias("x")).groupBy("x.ck").agg(F.sum("x.cn").alias("n")).collect():
        everyone[r["ck"]] = r["n"]

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros((b.num_rows, paths.COUNTERS))
        row = np.repeat(np.arange(b.num_rows), np.diff(b.column("ck").offsets.to_numpy()))
        counts[row, b.column("ck").flatten().to_numpy()] = b.column("cn").flatten().to_numpy()
        h, usual = paths.habits(counts, everyone), paths.usual_speed(counts, everyone).astype(np.float32)
        hours = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 24), pa.array(usual.ravel()))
        return pa.RecordBatch.from_arrays([b.column("agent_id"), pa.array(h.top), pa.array(h.jitter), pa.array(h.lines), pa.array(counts[:, paths.READINGS].astype(np.int64)), hours], names=[c.split()[0] for c in HABITS.split(", ")])

    return staged(by_agent.mapInArrow(over_batches(settle), HABITS))
