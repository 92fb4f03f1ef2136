"""Numpy kernels over the located events of many sessions at once.

Arrays are flat: ``seg`` numbers the sessions, ascending, and within a session
events are in order of time.  Coordinates are metres on a plane that touches the
sphere near the session's middle; sessions span a city or a country, and what
lies absurdly far away stays absurdly far away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from trackloom.functions.geo import M_PER_DEG

#: Logarithmic bins of speeds and lengths: BINS_PER_OCTAVE from LOWEST on.
LOWEST, BINS_PER_OCTAVE, BINS = 0.05, 8, 128
#: Places of the counters after the speed bins.
MOVING_STEPS, LONE_LINES = 128, 129
LENGTH_BINS = 200
#: Counters of usual speed by hour of day: sum of log speed and number of steps; number of readings.
HOURS_AT = LENGTH_BINS + BINS
READINGS = HOURS_AT + 48
COUNTERS = READINGS + 1
#: A step is taken for movement from this length on, and for jitter up to it.
MOVE_M, LEAST_MOVE_M, JITTER_M = 30.0, 12.0, 30.0
#: Events on either side in the running median that shows excursions.
HALF = 5
#: Pieces of a path that are looked at together when its best continuation is sought.
BLOCK = 512


@dataclass(frozen=True)
class Habits:
    """What an agent usually does: top speed, jitter of the receiver, chance that one coordinate repeats on the move.

    The values are numbers, or arrays with one value an event.
    """

    top: float | np.ndarray
    jitter: float | np.ndarray
    lines: float | np.ndarray

    def of(self, k: np.ndarray | slice) -> Habits:
        pick = lambda v: v[k] if isinstance(v, np.ndarray) else v
        return Habits(pick(self.top), pick(self.jitter), pick(self.lines))


def log_bin(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(v, LOWEST) / LOWEST) * BINS_PER_OCTAVE), 0, BINS - 1).astype(np.int64)


def bin_top(b: np.ndarray) -> np.ndarray:
    return LOWEST * 2.0 ** ((b + 1) / BINS_PER_OCTAVE)


def begins(seg: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)


def plane(seg: np.ndarray, lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of a place of the session: the middle ones of its first, middle and last usable coordinates."""
    if not len(seg):
        return lng.copy(), lat.copy()
    with np.errstate(invalid="ignore"):
        ok = np.flatnonzero((np.abs(lng) <= 180) & (np.abs(lat) <= 90))
    at = begins(seg)
    number = np.cumsum(np.concatenate([[0], seg[1:] != seg[:-1]]))
    lo = np.searchsorted(ok, at)
    hi = np.searchsorted(ok, np.append(at[1:], len(seg)))
    some = hi > lo
    centre = []
    for c in (lng, lat):
        m = np.zeros(len(at))
        if some.any():
            three = np.stack([c[ok[lo[some]]], c[ok[(lo[some] + hi[some]) // 2]], c[ok[hi[some] - 1]]])
            m[some] = np.sort(three, axis=0)[1]
        centre.append(m[number])
    return (lng - centre[0]) * (M_PER_DEG * np.cos(np.radians(centre[1]))), (lat - centre[1]) * M_PER_DEG


def impossible(lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Off the globe, not a number at all, or the null island a receiver reports without a fix."""
    with np.errstate(invalid="ignore"):
        return (np.abs(lng) > 180) | (np.abs(lat) > 90) | ~np.isfinite(lng) | ~np.isfinite(lat) | ((lng == 0) & (lat == 0))


def _running_median(v: np.ndarray, half: int) -> np.ndarray:
    return np.sort(np.lib.stride_tricks.sliding_window_view(v, 2 * half + 1), axis=1)[:, half]


def step_counts(seg: np.ndarray, owner: np.ndarray, core: np.ndarray, t: np.ndarray, lng: np.ndarray, lat: np.ndarray, owners: int) -> np.ndarray:
    """Counters of the owners' steps, one row an owner: speed bins, kinds of steps, bins of jitter, speeds by hour, readings.

    A step counts for its second event, and only if that is a ``core`` event.
    """
    out = np.zeros((owners, COUNTERS))

    def add(rows: np.ndarray, at: np.ndarray | int, weights: np.ndarray | None = None) -> None:
        out.ravel()[:] += np.bincount(rows * COUNTERS + at, weights, minlength=out.size)

    if not len(t):
        return out
    add(owner[core], READINGS)
    ok = ~impossible(lng, lat)
    seg, owner, core, t = seg[ok], owner[ok], core[ok], t[ok]
    x, y = plane(seg, lng[ok], lat[ok])
    if len(t) < 2:
        return out
    n = len(t)
    joined = seg[1:] == seg[:-1]
    d, dt = np.where(joined, np.hypot(np.diff(x), np.diff(y)), 0.0), np.maximum(np.diff(t), 1)
    own = joined & core[1:]
    who = owner[1:]
    # steps beside a sharp out-and-back aren't how the agent moves
    spiky = np.zeros(n, dtype=bool)
    if n > 2:
        least = np.minimum(d[1:], d[:-1])
        spiky[1:-1] = joined[1:] & joined[:-1] & (np.hypot(x[2:] - x[:-2], y[2:] - y[:-2]) < 0.3 * least) & (least > 100)
    if n >= 2 * HALF + 1:
        whole = np.flatnonzero(seg[2 * HALF :] == seg[: -2 * HALF])
        if len(whole):
            windows = lambda v, half: np.sort(np.lib.stride_tricks.sliding_window_view(v, 2 * half + 1)[whole], axis=1)[:, half]
            k = whole + HALF
            spiky[k] |= np.hypot(x[k] - windows(x, HALF), y[k] - windows(y, HALF)) > 2 * HALF * windows(d, HALF - 1) + 60
    calm = ~(spiky[1:] | spiky[:-1])
    zero, small = d == 0, d < JITTER_M
    move = own & calm & ((d >= MOVE_M) | (d >= LEAST_MOVE_M) & (d / dt > 1.0))
    add(who[move], log_bin(d[move] / dt[move]))
    add(who[move], MOVING_STEPS)
    for c, other in ((x, y), (y, x)):
        same = joined & (np.diff(c) == 0) & (np.abs(np.diff(other)) > 5)
        lone = own & same & ~np.concatenate([[False], same[:-1]]) & ~np.concatenate([same[1:], [False]])
        add(who[lone], LONE_LINES)
    if n > 2:
        # off the line between its neighbours a slow event is only put by jitter
        f = np.diff(t)[:-1] / np.maximum(t[2:] - t[:-2], 1)
        off = np.hypot(x[:-2] + (x[2:] - x[:-2]) * f - x[1:-1], y[:-2] + (y[2:] - y[:-2]) * f - y[1:-1])
        slow = joined[1:] & joined[:-1] & core[1:-1] & small[1:] & small[:-1] & ~zero[1:] & ~zero[:-1]
        add(owner[1:-1][slow], LENGTH_BINS + log_bin(off[slow]))
    hour = t[1:] // 3600 % 24
    add(who[own], HOURS_AT + hour[own], np.log1p(d[own] / dt[own]))
    add(who[own], HOURS_AT + 24 + hour[own])
    return out


def quantile(counts: np.ndarray, q: float) -> np.ndarray:
    """Of the histograms in the rows; 0 where there is nothing."""
    total = counts.sum(axis=1, keepdims=True)
    at = (np.cumsum(counts, axis=1) < q * total).sum(axis=1)
    return np.where(total[:, 0] > 0, bin_top(at.astype(float)), 0.0)


def habits(counts: np.ndarray, everyone: np.ndarray) -> Habits:
    """From the agents' counters (one a row), blended with everyone's where an agent shows little."""
    moving = counts[:, :BINS]
    few = 20.0 * np.maximum(0.0, 1 - moving.sum(axis=1, keepdims=True) / 20.0) / max(1.0, everyone[:BINS].sum())
    jitter = counts[:, LENGTH_BINS : LENGTH_BINS + BINS]
    return Habits(
        np.maximum(1.0, 1.1 * quantile(moving + everyone[:BINS] * few, 0.94)),
        np.where(jitter.sum(axis=1) >= 5, quantile(jitter, 0.5), 0.0),
        (counts[:, LONE_LINES] + 1) / (2 * counts[:, MOVING_STEPS] + 20),
    )


def usual_speed(counts: np.ndarray, everyone: np.ndarray) -> np.ndarray:
    """Expected log speed by hour of day, one row an agent; an hour without steps has the day's mean, an agent without any has everyone's."""
    c = np.where(counts[:, HOURS_AT + 24 : READINGS].sum(axis=1, keepdims=True) > 0, counts[:, HOURS_AT:READINGS], everyone[HOURS_AT:READINGS])
    total, n = c[:, :24], c[:, 24:]
    mean = total.sum(axis=1, keepdims=True) / np.maximum(n.sum(axis=1, keepdims=True), 1)
    return np.where(n > 0, total / np.maximum(n, 1), mean)


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each element: number of its run; of each run: first element, length; ``new`` marks first elements."""
    begin = np.flatnonzero(new)
    return np.cumsum(new) - 1, begin, np.diff(np.append(begin, len(new)))


def _chain(first: np.ndarray, last: np.ndarray, t: np.ndarray, xy: tuple[np.ndarray, np.ndarray], since: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], bound: float, slack: float) -> np.ndarray:
    """Which pieces make the path with the most right events.

    A piece is the events first..last.  Another can follow if the way from its
    last event is possible in the time between; or if it is so from the first
    repetition of each coordinate on (since), at the price of holding the
    repetitions (held, at most 3.5) to be stale.  Pieces are searched backwards
    in blocks, until none of the earlier ones can be better than the best found.
    """
    n, weight = len(first), (last - first + 1).astype(float)
    best, back = weight.copy(), np.full(n, -1)
    most = np.empty(n)  # the best of all pieces up to here
    most[0] = best[0]
    for j in range(1, n):
        found, at, hi = 0.0, -1, j
        while hi > 0 and most[hi - 1] > found:
            i = np.arange(max(0, hi - BLOCK), hi)
            a, b = last[i], first[j]
            soon = np.hypot(xy[0][a] - xy[0][b], xy[1][a] - xy[1][b]) - slack <= bound * (t[b] - t[a])
            late, price = np.ones(len(i), dtype=bool), np.zeros(len(i))
            for c, s, h in zip(xy, since, held):
                d = np.abs(c[a] - c[b]) - slack
                late &= d <= bound * (t[b] - s[a])
                price = np.maximum(price, np.where(d > bound * (t[b] - t[a]), h[a], 0))
            gain = np.where(soon, best[i], np.where(late, best[i] - np.clip(price, 1.0, 3.5), -1.0))
            k = int(np.argmax(gain))
            if gain[k] > found or gain[k] == found and at < 0 < gain[k]:
                found, at = float(gain[k]), int(i[k])
            hi = int(i[0])
        if at >= 0:
            best[j], back[j] = weight[j] + found, at
        most[j] = max(most[j - 1], best[j])
    keep = np.zeros(n, dtype=bool)
    j = int(np.argmax(best))
    while j >= 0:
        keep[j] = True
        j = back[j]
    return keep


def _stuck_repeats(seg: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray, h: Habits, slack: np.ndarray) -> np.ndarray:
    """Events of paths that repeat a stuck receiver's position or one coordinate of it."""
    stale = np.zeros(len(s), dtype=bool)
    tol = np.minimum(15.0, slack / 3) + 2 * h.jitter
    joined = seg[1:] == seg[:-1]
    both = np.concatenate([[False], joined & (np.diff(x) == 0) & (np.diff(y) == 0)])
    if both.any():
        run, begin, length = _runs(~both)
        a, b = begin[1:] - 1, begin[1:]
        d, wait = np.hypot(x[b] - x[a], y[b] - y[a]), np.maximum(s[b] - s[a], 1)
        stuck = np.append((seg[a] == seg[b]) & (length[:-1] > 1) & (d - tol[a] > 1.2 * h.top[a] * wait), False)
        stale |= stuck[run] & both
    # and those that repeat one coordinate while the other goes on
    for c, other in ((x, y), (y, x)):
        same = joined & (c[1:] == c[:-1])
        if not (same[1:] & same[:-1]).any():
            continue
        run, begin, length = _runs(np.concatenate([[True], ~same]))
        a, b = begin[1:] - 1, begin[1:]
        moved = np.concatenate([[0], np.cumsum(np.diff(other) != 0)])
        moves = moved[a] - moved[begin[:-1]]
        dc, wait = np.abs(c[b] - c[a]), np.maximum(s[b] - s[a], 1)
        lone = length[:-1]
        fast = (lone >= 3) & (dc - tol[a] > 1.2 * h.top[a] * wait)
        long = (lone >= 5) & (np.maximum(h.lines[a], 1e-3) ** (lone - 1.0) < 1e-3) & (dc > 15 + h.jitter[a])
        stuck = np.append((seg[a] == seg[b]) & (fast | long) & (moves >= 0.6 * (lone - 1)), False)
        repeats = np.ones(len(s), dtype=bool)
        repeats[begin] = False
        stale |= stuck[run] & repeats
    return stale


def false_positions(seg: np.ndarray, t: np.ndarray, lng: np.ndarray, lat: np.ndarray, h: Habits) -> tuple[np.ndarray, np.ndarray]:
    """(false, stale) of located events: positions the agent can't have been at, and those merely repeated.

    Impossible values go first.  Where a step is too fast, the session falls into
    pieces, of which the path with the most right events is kept; the rest is
    displaced.  A position, or one coordinate, that the path repeats and then
    leaves faster than the agent ever goes was stuck: its repetitions are stale,
    its first event isn't.  So was a single coordinate that is repeated, while the
    other one changes, more often than chance allows for this receiver.
    """
    n = len(t)
    false, stale = impossible(lng, lat), np.zeros(n, dtype=bool)
    ok = np.flatnonzero(~false)
    if len(ok) < 2:
        return false, stale
    full = lambda v: v if isinstance(v, np.ndarray) else np.full(n, float(v))
    h = Habits(full(h.top)[ok], full(h.jitter)[ok], full(h.lines)[ok])
    g, s = seg[ok], t[ok]
    x, y = plane(g, lng[ok], lat[ok])
    slack, bound = 30.0 + 3 * h.jitter, 1.5 * h.top
    joined = g[1:] == g[:-1]
    dt = np.diff(s)
    pace = np.where(joined, np.hypot(np.diff(x), np.diff(y)) - slack[1:], -np.inf)
    on = np.ones(len(s), dtype=bool)
    torn = np.unique(g[1:][pace > bound[1:] * dt])
    if len(torn):
        lo, hi = np.searchsorted(g, torn), np.searchsorted(g, torn, side="right")
        for a, z in zip(lo, hi):
            # pieces end at any step beyond the top speed, if one is impossible
            cut = pace[a : z - 1] > h.top[a + 1 : z] * dt[a : z - 1]
            px, py, m = x[a:z], y[a:z], z - a
            since, held = [], []
            for c in (px, py):
                run, begin, _ = _runs(np.concatenate([[True], np.diff(c) != 0]))
                since.append(s[a:z][begin][run])
                held.append((np.arange(m) - begin[run]).astype(float))
            first = np.concatenate([[0], np.flatnonzero(cut) + 1])
            last = np.append(first[1:] - 1, m - 1)
            on[a:z] = np.repeat(_chain(first, last, s[a:z], (px, py), tuple(since), tuple(held), float(bound[a]), float(slack[a])), last - first + 1)
    path = np.flatnonzero(on)
    false[ok] |= ~on
    if len(path) > 1:
        stale[ok[path]] = _stuck_repeats(g[path], s[path], x[path], y[path], h.of(path), slack[path])
    return false, stale


def dense_clusters(seg: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, near_m: np.ndarray, within_s: int, least: int) -> np.ndarray:
    """Spatio-temporal density clusters: the least event of each event's cluster, -1 for noise.

    Neighbours are events of one session at most ``near_m`` metres and
    ``within_s`` seconds apart, or next to each other in time, an event being its
    own neighbour.  Events with at least ``least`` of them are cores; cores that
    are neighbours share a cluster; other neighbours of a core belong to its
    cluster, the earlier one of two.  Pairs are gone through by their distance in
    rank, so that memory doesn't grow with the number of neighbours.
    """
    n = len(t)

    def neighbours() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, step = np.arange(n), 1
        while True:
            i = i[i + step < n]
            j = i + step
            i = i[(seg[j] == seg[i]) & ((t[j] - t[i] <= within_s) | (step == 1))]
            if not len(i):
                return
            j = i + step
            close = np.hypot(x[j] - x[i], y[j] - y[i]) <= near_m[i]
            yield i[close], j[close]
            step += 1

    count = np.ones(n, dtype=np.int64)
    for i, j in neighbours():
        count[i] += 1
        count[j] += 1
    core = count >= least
    root = np.arange(n)
    reached = np.full(n, n, dtype=np.int64)
    for i, j in neighbours():
        new = core[i] & core[j] & (root[i] != root[j])
        if new.any():
            root = _joined(root, i[new], j[new])
        for inside, outside in ((i, j), (j, i)):
            edge = core[inside] & ~core[outside]
            np.minimum.at(reached, outside[edge], inside[edge])
    label = np.where(core, root, -1)
    late = ~core & (reached < n)
    label[late] = root[reached[late]]
    return label


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least element of each element's component, once ``a`` and ``b`` are joined pairwise."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new[a] == new[b]).all():
            return new
        root = new


#: Radius in time and least number of neighbours of a dense event.
NEIGHBOUR_S, NEIGHBOURS = 600, 2


def reach_of(jitter: np.ndarray, far_m: float = 60.0) -> np.ndarray:
    """Radius of a place: what the receiver's jitter explains, at least 10 m."""
    return np.clip(4.5 * jitter / 1.44, 10.0, far_m)


def stays(seg: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, jitter: np.ndarray, least_s: int = 300, far_m: float = 60.0) -> list[tuple[int, int]]:
    """(first, last) of each stay among the sessions' right positions, in order.

    Dense events (``dense_clusters``, twice the receiver's reach apart at most)
    are clustered; a cluster that lasts at least ``least_s`` may hold stays.  It
    may also be slow progress, whose neighbours chain along the way, so each
    cluster is taken apart: the event whose unbroken neighbours last longest is
    the core of a place; the place reaches from it both ways as far as events stay
    within the reach of their middle, a single event outside being forgiven if
    the next two are inside again.  Places of at least ``least_s`` are stays
    unless their middle drifts more than jitter explains.  The rest is searched again.
    """
    reach = reach_of(jitter, far_m)
    label = dense_clusters(seg, t, x, y, 2 * reach, max(NEIGHBOUR_S, 2 * least_s), NEIGHBOURS)
    kept = np.flatnonzero(label >= 0)
    out: list[tuple[int, int]] = []
    if not len(kept):
        return out
    names, first = np.unique(label[kept], return_index=True)
    back = len(kept) - 1 - np.unique(label[kept][::-1], return_index=True)[1]
    spans = [(int(a), int(z)) for a, z in zip(kept[first], kept[back]) if t[z] - t[a] >= least_s]
    # clusters that overlap in time are taken apart together
    merged: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
        else:
            merged.append((a, z))
    for a, z in merged:
        out += [(a + i, a + j) for i, j in _places(t[a : z + 1], x[a : z + 1], y[a : z + 1], float(reach[a]), max(float(jitter[a]) / 1.44, 1.0), least_s)]
    return sorted(out)


def _places(t: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float, sigma: float, least_s: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    todo = [(0, len(t) - 1)]
    while todo:
        a, b = todo.pop()
        if t[b] - t[a] < least_s:
            continue
        px, py, s = x[a : b + 1], y[a : b + 1], t[a : b + 1]
        m = len(s)
        i, j = core = _densest(s, px, py, reach, max(1, least_s // 3))
        seen = set()
        # the middle is moved until nothing changes, or an earlier state comes again
        while (i, j) not in seen:
            seen.add((i, j))
            cx, cy = np.median(px[i : j + 1]), np.median(py[i : j + 1])
            near = np.hypot(px - cx, py - cy) <= reach
            k = (i + j) // 2
            if not near[k]:
                inside = np.flatnonzero(near[i : j + 1])
                if not len(inside):
                    break
                k = i + int(inside[len(inside) // 2])
            i, j = k, k
            while i > 0 and (near[i - 1] or (i > 2 and near[i - 2] and near[i - 3])):
                i -= 1 if near[i - 1] else 2
            while j < m - 1 and (near[j + 1] or (j < m - 3 and near[j + 2] and near[j + 3])):
                j += 1 if near[j + 1] else 2
        if s[j] - s[i] >= least_s:
            if not _drifts(s[i : j + 1], px[i : j + 1], py[i : j + 1], sigma):
                out.append((a + i, a + j))
        elif s[j] - s[i] == 0 and i == core[0]:
            i, j = core
        if i > 0:
            todo.append((a, a + i - 1))
        if j < m - 1:
            todo.append((a + j + 1, b))
    return out


def _unbroken(k: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the unbroken neighbours of each of the events ``k``, which ascend."""
    n = len(x)
    first, last = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    for c in range(0, len(k), 16):
        q = k[c : c + 16]
        wide = 16
        while True:
            lo, hi = max(0, int(q[0]) - wide), min(n, int(q[-1]) + wide + 1)
            col = np.arange(lo, hi)
            far = np.hypot(x[lo:hi] - x[q][:, None], y[lo:hi] - y[q][:, None]) > reach
            z = np.where(far & (col > q[:, None]), col, hi).min(axis=1) - 1
            a = np.where(far & (col < q[:, None]), col, lo - 1).max(axis=1) + 1
            if (lo == 0 or (a > lo).all()) and (hi == n or (z < hi - 1).all()):
                break
            wide *= 4
        first[c : c + 16], last[c : c + 16] = a, z
    return first, last


def _densest(s: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float, every_s: int) -> tuple[int, int]:
    """The longest time any event's unbroken neighbours cover, as their first and last place.

    One event in ``every_s`` seconds is a seed, so that neighbours lasting that
    long include one.  Events whose neighbours include a seed lie in its reach,
    and these neighbours within twice that; so only events around seeds whose
    unbroken surroundings of twice the reach last longer than the best found have
    to be tried.  If nothing lasts ``every_s``, every event is tried.
    """
    seeds = np.flatnonzero(np.concatenate([[True], np.diff(s // every_s) != 0]))

    def longest(k: np.ndarray) -> tuple[int, tuple[int, int]]:
        first, last = _unbroken(k, x, y, reach)
        m = int(np.argmax(s[last] - s[first]))
        return int(s[last[m]] - s[first[m]]), (int(first[m]), int(last[m]))

    best, found = longest(seeds)
    lo, hi = _unbroken(seeds, x, y, 2 * reach)
    bound = s[hi] - s[lo]
    tried = np.zeros(len(s), dtype=bool)
    tried[seeds] = True
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best:
            break
        a, z = int(lo[i]), int(hi[i]) + 1
        k = a + np.flatnonzero(~tried[a:z] & (np.hypot(x[a:z] - x[seeds[i]], y[a:z] - y[seeds[i]]) <= reach))
        tried[k] = True
        # those nearest to the middle first, as they cover most
        for part in np.array_split(k[np.argsort(np.hypot(x[k] - np.median(x[a:z]), y[k] - np.median(y[a:z])))], max(1, len(k) // 64)):
            if bound[i] > best and len(part):
                spent, at = longest(np.sort(part))
                if spent > best:
                    best, found = spent, at
    if best < every_s:
        spent, at = longest(np.arange(len(s)))
        if spent > best:
            found = at
    return found


def _drifts(s: np.ndarray, x: np.ndarray, y: np.ndarray, sigma: float) -> bool:
    """Whether the line through the positions over time goes farther than jitter explains."""
    n = len(s)
    if n < 3:
        return False
    u = s - s.mean()
    spread = float((u * u).sum())
    if spread == 0:
        return False
    moved = np.hypot((u * x).sum(), (u * y).sum()) / spread * (s[-1] - s[0])
    doubt = sigma * (s[-1] - s[0]) / np.sqrt(spread)
    return bool(moved > max(8.0, 4.0 * doubt))


FEATURES = ("level", "difference", "least speed", "greatest speed", "season", "run length", "speed after run", "held")


def reading_features(seg: np.ndarray, t: np.ndarray, lng: np.ndarray, lat: np.ndarray, h: Habits, usual: np.ndarray, false: np.ndarray, stale: np.ndarray) -> np.ndarray:
    """One row of FEATURES a located event, in logarithms and in the source's own units.

    level is the distance from the agent's path, that is from the line between
    the events before and behind that are neither false nor stale; difference
    that from the line between the neighbours; speeds are in units of the
    source's top speed; season the deviation from ``usual``, the log speed
    expected in each hour of day (one row an event); run length the place in a
    run of equal coordinates; speed after run how fast the run is left; held the
    place among repetitions that can't be a stand.
    """
    n = len(t)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    full = lambda v: v if isinstance(v, np.ndarray) else np.full(n, float(v))
    top, unit = full(h.top), 10.0 + full(h.jitter)
    x, y = plane(seg, lng, lat)
    x, y = np.nan_to_num(x, posinf=1e9, neginf=-1e9), np.nan_to_num(y, posinf=1e9, neginf=-1e9)
    path = np.flatnonzero(~(false | stale))
    odd = np.flatnonzero(false | stale)
    if len(path) and len(odd):
        k = np.searchsorted(path, odd)
        a, b = path[np.maximum(k - 1, 0)], path[np.minimum(k, len(path) - 1)]
        has_a, has_b = (k > 0) & (seg[a] == seg[odd]), (k < len(path)) & (seg[b] == seg[odd])
        a, b = np.where(has_a, a, b), np.where(has_b, b, a)
        f = np.clip((t[odd] - t[a]) / np.maximum(t[b] - t[a], 1), 0, 1)
        away = np.hypot(x[a] + (x[b] - x[a]) * f - x[odd], y[a] + (y[b] - y[a]) * f - y[odd])
        out[odd, 0] = np.where(has_a | has_b, np.log1p(away / unit[odd]), 0.0)
    if n < 2:
        return out
    joined = seg[1:] == seg[:-1]
    dt = np.maximum(np.diff(t), 1)
    speed = np.hypot(np.diff(x), np.diff(y)) / dt
    v = np.where(joined, np.log1p(speed / top[1:]), 0.0)
    before, after = np.concatenate([[0.0], v]), np.append(v, 0.0)
    opens, ends = np.concatenate([[True], ~joined]), np.append(~joined, True)
    before, after = np.where(opens, after, before), np.where(ends, before, after)
    out[:, 2], out[:, 3] = np.minimum(before, after), np.maximum(before, after)
    real = np.concatenate([[0.0], np.where(joined, np.log1p(speed), 0.0)])
    out[:, 4] = np.where(opens, 0.0, np.abs(real - usual[np.arange(n), (t // 3600 % 24).astype(np.int64)]))
    if n > 2:
        f = dt[:-1] / np.maximum(t[2:] - t[:-2], 1)
        aside = np.hypot(x[:-2] + (x[2:] - x[:-2]) * f - x[1:-1], y[:-2] + (y[2:] - y[:-2]) * f - y[1:-1])
        out[1:-1, 1] = np.where(joined[1:] & joined[:-1], np.log1p(aside / unit[1:-1]), 0.0)
    for c in (x, y):
        same = joined & (c[1:] == c[:-1])
        if not same.any():
            continue
        run, begin, length = _runs(np.concatenate([[True], ~same]))
        place = np.arange(n) - begin[run]
        a, b = begin[1:] - 1, begin[1:]
        leave = np.append(np.where(seg[a] == seg[b], np.log1p(np.abs(c[b] - c[a]) / np.maximum(t[b] - t[a], 1) / top[a]), 0.0), 0.0)
        out[:, 5] = np.maximum(out[:, 5], np.log1p(place))
        out[:, 6] = np.maximum(out[:, 6], np.where(place > 0, leave[run], 0.0))
        out[:, 7] = np.maximum(out[:, 7], np.where(stale & (place > 0), 1.0 + np.log1p(place), 0.0))
    return out
