"""Implausible readings: an isolation forest per source decides, physical limits confirm."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import paths
from trackloom.functions.forest import SAMPLE, Forests
from trackloom.operators.tracks import Days, agent_habits, over_batches, tracks
from trackloom.plans.joins import cell_join
from trackloom.plans.stage import staged

#: Readings of a source that its trees are drawn from, on average; each tree has its own SAMPLE of them.
POOL = 4 * SAMPLE
#: A reading whose score reaches this is an outlier of its source; about 0.5 is usual.
OUTLIER = 0.42
#: How far beyond the sample cuts may lie, by feature (paths.FEATURES), in logarithms.
SPREAD = (3.0, 1.0, 0.5, 0.5, 0.5, 0.5, 1.0, 3.0)

FLAGGED = "agent_id string, s array<bigint>, ping_ids array<bigint>, copies array<int>, features binary, flags binary, pooled binary"
SCORED = "ping_id bigint, agent_id string, s bigint, score double, suspect boolean, impossible boolean, displaced boolean, stale boolean"


def _drawn(t: np.ndarray) -> np.ndarray:
    """A number in [0, 1) by a hash of the time."""
    with np.errstate(over="ignore"):
        h = t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(24)).astype(float) / 2.0**40


def _flags(b: pa.RecordBatch) -> pa.RecordBatch:
    """Features, rules and the draw for the pool of a batch of days, one row a day."""
    d = Days(b)
    here = np.flatnonzero(d.located)
    seg, t, lng, lat, h = d.seg[here], d.t[here], d.lng[here], d.lat[here], d.habits(b, here)
    usual = b.column("usual").flatten().to_numpy().reshape(b.num_rows, 24)
    off, stale = paths.false_positions(seg, t, lng, lat, h)
    x = paths.reading_features(seg, t, lng, lat, h, usual[d.pack[here]], off, stale).astype(np.float16)
    bad = paths.impossible(lng, lat)
    flags = (bad + 2 * (off & ~bad) + 4 * stale).astype(np.uint8)
    own = d.core[here]
    mine = here[own]
    x, flags, t = x[own], flags[own], t[own]
    share = POOL / np.maximum(b.column("readings").to_numpy(), 1)
    pool = np.flatnonzero(_drawn(t) < share[d.pack[mine]])
    pool = pool[np.lexsort((_drawn(t[pool] ^ 0x5555), d.pack[mine][pool]))]
    rows = np.arange(b.num_rows + 1)
    at, pooled = np.searchsorted(d.pack[mine], rows), np.searchsorted(d.pack[mine][pool], rows)
    ids, e = d.ids_of(mine)
    id_at = np.searchsorted(d.pack[e], rows)
    lists = lambda at, v: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v))
    texts = lambda at, v: pa.array([v[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
    return pa.RecordBatch.from_arrays(
        [b.column("agent_id"), lists(at, t), lists(id_at, ids), lists(at, d.n_ids[mine].astype(np.int32)), texts(at, x), texts(at, flags), texts(pooled, x[pool])],
        names=[c.split()[0] for c in FLAGGED.split(", ")],
    )


def _forests(b: pa.RecordBatch) -> pa.RecordBatch:
    """A forest a source from its pool."""
    width = len(paths.FEATURES)
    pools = [np.frombuffer(b"".join(p), np.float16).reshape(-1, width).astype(float) for p in b.column("pools").to_pylist()]
    # the draws of a source's days are put in one random order
    pools = [p[np.argsort(_drawn(np.arange(len(p)) + 1), kind="stable")] for p in pools]
    agents = b.column("agent_id").to_pylist()
    start = np.concatenate([[0], np.cumsum([len(p) for p in pools])]).astype(np.int64)
    seed = np.array([zlib.crc32(a.encode()) for a in agents], dtype=np.int64)
    out: list[bytes] = []
    for i in range(0, len(agents), 256):
        j = min(i + 256, len(agents))
        out += Forests.grown(np.concatenate([*pools[i:j], np.zeros((1, width))]), start[i : j + 1] - start[i], seed[i:j], SPREAD).packed()
    return pa.RecordBatch.from_arrays([b.column("agent_id"), pa.array(out, pa.binary())], names=["agent_id", "forest"])


def _scores(b: pa.RecordBatch) -> pa.RecordBatch:
    names, source = np.unique(np.array(b.column("agent_id").to_pylist(), dtype=object).astype(str), return_inverse=True)
    first = np.unique(source, return_index=True)[1]
    forests = Forests.unpacked([b.column("forest")[int(i)].as_py() for i in first])
    joined = lambda c, kind: np.frombuffer(b"".join(b.column(c).to_pylist()), kind)
    x = joined("features", np.float16).reshape(-1, len(paths.FEATURES)).astype(np.float32)
    flags = joined("flags", np.uint8)
    t = b.column("s").flatten().to_numpy()
    who = np.repeat(source, np.diff(b.column("s").offsets.to_numpy()))
    score = forests.score(x, who)
    impossible, displaced, stale = flags & 1 > 0, flags & 2 > 0, flags & 4 > 0
    e = np.repeat(np.arange(len(t)), b.column("copies").flatten().to_numpy())
    cols = [b.column("ping_ids").flatten(), pa.array(names[who[e]], pa.string()), pa.array(t[e]), pa.array(score[e]), *(pa.array(v[e]) for v in (impossible | (score >= OUTLIER), impossible, displaced, stale))]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCORED.split(", ")])


def score_readings(raw: DataFrame) -> DataFrame:
    """Every usable, located reading with its score and rules, in SCORED columns.

    Per source an isolation forest is grown once, on the features level,
    difference, speeds, seasonal deviation, run length and what becomes of a run
    (``paths.reading_features``, in the source's own units).  Its pool is drawn by
    a hash of time from all readings, at a rate that gives about POOL; each tree
    has its own SAMPLE of them.  The forest scores every reading, and one that
    reaches OUTLIER is suspect.  Explicit physical limits: positions off the
    globe (always suspect), positions off the path with the most right events
    under the source's own top speed (displaced), repetitions of a stuck receiver
    (stale).  Habits (top speed, jitter, hourly means) are counted over all rows.

    Sessions are cut at a day's halo (two hours), so no group grows with a device
    that never pauses.  Unusable and unlocated rows have no row here; every
    delivery of an event has one.  A source with a single reading is only tested
    for impossible values; an empty table gives no rows.
    """
    packed = tracks(raw)
    habits = agent_habits(packed)
    flagged = staged(cell_join(packed, habits, ["agent_id"]).mapInArrow(over_batches(_flags), FLAGGED))
    # about POOL readings a source, however many it has
    pools = flagged.where(F.length("pooled") > 0).groupBy("agent_id").agg(F.sort_array(F.collect_list("pooled")).alias("pools"))
    forests = staged(habits.select("agent_id").join(pools, "agent_id", "left").select("agent_id", F.coalesce("pools", F.array().cast("array<binary>")).alias("pools")).mapInArrow(over_batches(_forests), "agent_id string, forest binary"))
    return cell_join(flagged.drop("pooled"), forests, ["agent_id"]).mapInArrow(over_batches(_scores), SCORED)


def false_readings(raw: DataFrame) -> DataFrame:
    """ping_id of readings that are outliers to their source's forest and break a physical limit."""
    return score_readings(raw).where("suspect and (impossible or displaced or stale)").select("ping_id")
