"""Map matching of whole sequences in numpy: candidates from a grid of segments, moves from a table of paths.

Nothing between a point and its match becomes a row.  Formulas and their order
are those of ``operators.matching``, so that results are equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Points and moves that are looked at together; a longer sequence is gone through in such pieces.
POINTS, MOVES = 16_384, 384
#: Slots of the table of paths beyond which it is begun anew; a bound on memory, not on what is found.
SLOTS = 6_000_000
#: Segments that one step of the candidate search looks at, about.
NEAR = 400_000


class Roads:
    """Segments, in order of link and part, as arrays, and the ranks of all ``nodes``; the grid and the table of paths are made where they are used."""

    def __init__(self, cols: dict[str, np.ndarray], nodes: np.ndarray) -> None:
        order = np.lexsort((cols["part"], cols["link"]))
        c = {k: v[order] for k, v in cols.items()}
        self.x1, self.y1, self.before, self.heading = c["x1"], c["y1"], c["before"], c["heading"]
        self.ux, self.uy = c["x2"] - c["x1"], c["y2"] - c["y1"]
        first = np.flatnonzero(np.concatenate([[True], c["link"][1:] != c["link"][:-1]])) if len(order) else np.zeros(0, np.int64)
        self.seg_link = (np.cumsum(np.bincount(first, minlength=len(order))) - 1).astype(np.int32)
        self.link, self.from_node, self.to_node = (c[k][first] for k in ("link", "from_node", "to_node"))
        # nodes are ranked by x, so that what is reached from one lies in a narrow range of ranks
        ends = np.concatenate([self.from_node, self.to_node, nodes])
        last = np.append(first[1:], len(order)) - 1 if len(order) else first
        xs = np.concatenate([c["x1"][first], c["x2"][last], np.full(len(nodes), np.inf)])
        ids, at = np.unique(ends, return_index=True)
        rank = np.empty(len(ids), np.int32)
        rank[np.argsort(xs[at], kind="stable")] = np.arange(len(ids), dtype=np.int32)
        self.ids, self.rank = ids, rank
        self.f, self.t = (rank[np.searchsorted(ids, n)] for n in (self.from_node, self.to_node))
        self.node_of = np.empty(len(ids), np.int64)
        self.node_of[rank] = ids
        self.kept: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}


class Grid:
    """Square cells, each with the segments that points in it may lie within ``radius`` of."""

    def __init__(self, r: Roads, radius: float) -> None:
        self.r, self.radius, self.size = r, radius, radius / 2
        wide = radius + 1e-3
        x2, y2 = r.x1 + r.ux, r.y1 + r.uy
        cell = lambda v: np.floor(v / self.size).astype(np.int64)

        def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = hi - lo + 1
            k = np.repeat(np.arange(len(n)), n)
            return k, lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)

        k, cx = spread(cell(np.minimum(r.x1, x2) - wide), cell(np.maximum(r.x1, x2) + wide))
        ux, upright = r.ux[k], r.ux[k] == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.clip((cx * self.size - wide - r.x1[k]) / ux, 0, 1)
            b = np.clip(((cx + 1) * self.size + wide - r.x1[k]) / ux, 0, 1)
        a, b = np.where(upright, 0.0, a), np.where(upright, 1.0, b)
        ya, yb = r.y1[k] + a * r.uy[k], r.y1[k] + b * r.uy[k]
        q, cy = spread(cell(np.minimum(ya, yb) - wide), cell(np.maximum(ya, yb) + wide))
        seg, cx = k[q], cx[q]
        order = np.lexsort((seg, cy, cx))
        self.seg, cx, cy = seg[order].astype(np.int32), cx[order], cy[order]
        new = np.flatnonzero(np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])) if len(cx) else np.zeros(0, np.int64)
        self.low = int(cy.min()) if len(cy) else 0
        self.high = int(cy.max()) if len(cy) else -1
        self.keys = cx[new] * (self.high - self.low + 1) + cy[new] - self.low
        self.start, self.count = new, np.diff(np.append(new, len(cx)))

    def candidates(self, x: np.ndarray, y: np.ndarray, top: int) -> dict[str, np.ndarray]:
        """n of each point; seg, link (its place), dist and along of its candidates in order of link, -1 and 0 beyond n."""
        out = {"n": np.zeros(len(x), np.int64), "seg": np.full((len(x), top), -1, np.int32), "link": np.full((len(x), top), -1, np.int32), "dist": np.zeros((len(x), top)), "along": np.zeros((len(x), top))}
        ok = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        cx, cy = np.floor(x[ok] / self.size), np.floor(y[ok] / self.size)
        ok, cx, cy = (v[(cy >= self.low) & (cy <= self.high) & (np.abs(cx) < 2**40)] for v in (ok, cx, cy))
        if not len(ok) or not len(self.keys):
            return out
        key = cx.astype(np.int64) * (self.high - self.low + 1) + cy.astype(np.int64) - self.low
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        ok, at = ok[hit], at[hit]
        parts = np.cumsum(self.count[at]) // NEAR
        for g in np.split(np.arange(len(ok)), np.flatnonzero(np.diff(parts)) + 1) if len(ok) else []:
            self._near(ok[g], at[g], x, y, top, out)
        return out

    def _near(self, p: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, top: int, out: dict[str, np.ndarray]) -> None:
        r, n = self.r, self.count[at]
        k = np.repeat(np.arange(len(p)), n)
        seg = self.seg[np.arange(len(k)) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)]
        px, py, x1, y1, ux, uy = x[p][k], y[p][k], r.x1[seg], r.y1[seg], r.ux[seg], r.uy[seg]
        nn = ux * ux + uy * uy
        with np.errstate(divide="ignore", invalid="ignore"):
            f = ((px - x1) * ux + (py - y1) * uy) / nn
        f = np.clip(np.where(nn == 0, 0.0, f), 0.0, 1.0)
        dx, dy = px - (x1 + f * ux), py - (y1 + f * uy)
        d = np.sqrt(dx * dx + dy * dy)
        near = np.flatnonzero(d <= self.radius)
        if not len(near):
            return
        k, seg, d, f, nn = k[near], seg[near], d[near], f[near], nn[near]
        link = r.seg_link[seg]
        # of a link's segments the nearest, of equal ones the first
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (link[1:] != link[:-1])]))
        if len(new) < len(k):
            group = np.cumsum(np.bincount(new, minlength=len(k))) - 1
            least = np.minimum.reduceat(d, new)[group]
            pick = np.minimum.reduceat(np.where(d == least, np.arange(len(k)), len(k)), new)
            k, seg, d, f, nn, link = (v[pick] for v in (k, seg, d, f, nn, link))
        m = np.bincount(k, minlength=len(p))
        place = np.arange(len(k)) - (np.cumsum(m) - m)[k]
        wide = int(m.max())
        if wide > top:
            table = np.full((len(p), wide), np.inf)
            table[k, place] = d
            # equal distances by link
            order = np.argsort(table, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(wide), order.shape), axis=1)
            keep = np.flatnonzero(rank[k, place] < top)
            k, seg, d, f, nn, link = (v[keep] for v in (k, seg, d, f, nn, link))
            m = np.minimum(m, top)
            place = np.arange(len(k)) - (np.cumsum(m) - m)[k]
        out["n"][p] = m
        rows = p[k]
        out["seg"][rows, place], out["link"][rows, place], out["dist"][rows, place] = seg, link, d
        out["along"][rows, place] = r.before[seg] + f * np.sqrt(nn)


class Paths:
    """Bounded paths by the ranks of their ends: a row of slots a source, searched when it is first asked for."""

    def __init__(self, r: Roads, search: Callable[[int], dict[int, tuple]]) -> None:
        self.r, self.search = r, search
        self._begin()

    def _begin(self) -> None:
        n = len(self.r.ids)
        # a row has a slot for 'none' at either end
        self.lo, self.wide, self.base = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.cost, self.second, self.last, self.used = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0

    def ensure(self, sources: np.ndarray) -> None:
        marked = np.zeros(len(self.wide), bool)
        marked[sources] = True
        asked = np.flatnonzero(marked)
        todo = asked[self.wide[asked] < 0]
        if len(todo) and self.used > SLOTS:
            self._begin()
            todo = asked
        for o in todo.tolist():
            found = self.search(int(self.r.node_of[o]))
            d = self.r.rank[np.searchsorted(self.r.ids, np.fromiter(found, np.int64, len(found)))]
            lo, wide = (int(d.min()) - 1, int(d.max() - d.min()) + 2) if len(d) else (0, 0)
            if self.used + wide + 1 > len(self.cost):
                more = max(len(self.cost), wide + 1)
                self.cost, self.second, self.last = (np.concatenate([v, np.zeros(more, v.dtype)]) for v in (self.cost, self.second, self.last))
            u = self.used
            self.cost[u : u + wide + 1], self.second[u : u + wide + 1], self.last[u : u + wide + 1] = 0.0, -1, -1
            if len(d):
                c, s, b = (np.array(v) for v in list(zip(*found.values()))[:3])
                s, b = (self.r.rank[np.searchsorted(self.r.ids, v)] for v in (s, b))
                at = u + d - lo
                # a path without length leads nowhere
                self.cost[at], self.second[at], self.last[at] = c, np.where(c > 0, s, -1), b
            self.lo[o], self.wide[o], self.base[o] = lo, wide, u
            self.used += wide + 1

    def moves(self, la: np.ndarray, lb: np.ndarray, ra: np.ndarray, rb: np.ndarray, gps: np.ndarray, not_connected: float, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probability, route, valid) by k, end and start, from each of the links la[k] to each of lb[k]; routes count only where they are valid."""
        r = self.r
        fa, ta, fb, tb = r.f[la], r.t[la], r.f[lb][:, :, None], r.t[lb][:, :, None]
        self.ensure(fa[la >= 0])
        # within the row of its source, or one of the slots for 'none'
        at = fb - self.lo[fa][:, None, :]
        np.maximum(at, 0, out=at)
        np.minimum(at, np.maximum(self.wide[fa], 0)[:, None, :], out=at)
        at += self.base[fa][:, None, :]
        valid = self.second.take(at, mode="clip") == ta[:, None, :]
        valid &= self.last.take(at, mode="clip") != tb
        valid |= la[:, None, :] == lb[:, :, None]
        valid |= (fa[:, None, :] == tb) & (ta[:, None, :] == fb)
        route = self.cost.take(at, mode="clip")
        route -= ra[:, None, :]
        route += rb[:, :, None]
        np.abs(route, out=route)
        log_p = gps[:, None, None] - route
        np.abs(log_p, out=log_p)
        np.copyto(log_p, not_connected, where=~valid)
        log_p *= scale
        return log_p, route, valid


class Matcher:
    """The most probable links of sequences of points."""

    def __init__(self, roads: Roads, search: Callable[[int], dict[int, tuple]], m) -> None:
        # both serve all tasks of a worker
        made = {("grid", m.buffer_m): lambda: Grid(roads, m.buffer_m), ("paths", m.cutoff_m): lambda: Paths(roads, search)}
        for k, make in made.items():
            if k not in roads.kept:
                roads.kept[k] = make()
        self.grid, self.paths = (roads.kept[k] for k in made)
        self.roads, self.m = roads, m
        self.logs = np.array([math.log(h) for h in m.headings])

    def _seen(self, x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Candidates, and their emissions: minus infinity beyond n."""
        m, r = self.m, self.roads
        c = self.grid.candidates(x, y, m.top_k)
        dx, dy = r.ux[c["seg"]], r.uy[c["seg"]]
        gx, gy = gx[:, None], gy[:, None]
        own = np.sqrt(gx * gx + gy * gy)
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = (gx * dx + gy * dy) / (own * np.sqrt(dx * dx + dy * dy))
            angle = np.degrees(np.arccos(np.clip(cos, -1.0, 1.0)))
        angle = np.where(np.isnan(angle), 0.0, angle)
        off = np.where((own > m.omitted_m) & m.use_heading, np.minimum(angle, 179.9), 0.0)
        e = self.logs[np.floor(off / (180.0 / len(m.headings))).astype(np.int64)] - 0.5 * (m.dis_para * c["dist"] / m.sigma_m) ** 2
        return c, np.where(np.arange(m.top_k) < c["n"][:, None], e, -np.inf)

    def _fold(self, c: dict[str, np.ndarray], e: np.ndarray, x: np.ndarray, y: np.ndarray, seq: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Places of the predecessors.  Rows are ordered by ``seq``, their sequence; z has a row a sequence and goes from its first row to its last."""
        k, top = len(seq), self.m.top_k
        back = np.zeros((k, top), np.int8 if top < 128 else np.int32)
        new = np.concatenate([[True], seq[1:] != seq[:-1]])
        begin = np.flatnonzero(new)
        step = np.arange(k) - begin[np.cumsum(new) - 1]
        # all sequences go on together, by their number of steps
        order = np.argsort(step, kind="stable")
        order = order[len(begin) :]
        level = step[order]
        for a in range(0, len(order), MOVES):
            b = order[a : a + MOVES]
            lv = level[a : a + MOVES]
            log_p = self._moves(c, x, y, b - 1, b)[0]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(lv)) + 1, [len(b)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                rows = b[i:j]
                s = seq[rows]
                part = log_p[i:j]
                part += z[s][:, None, :]
                best = part.argmax(axis=2)
                back[rows] = best
                z[s] = np.take_along_axis(part, best[:, :, None], axis=2)[:, :, 0] + e[rows]
        return back

    def _moves(self, c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, ka: np.ndarray | None = None, kb: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = lambda v, i, k: v[i] if k is None else v[i, k][:, None]
        dx, dy = x[b] - x[a], y[b] - y[a]
        gps = np.sqrt(dx * dx + dy * dy)
        return self.paths.moves(at(c["link"], a, ka), at(c["link"], b, kb), at(c["along"], a, ka), at(c["along"], b, kb), gps, self.m.not_connected, -self.m.dis_para / self.m.beta)

    def match(self, seq: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """row, seg, dist, along, route and valid of the points with a candidate; route is NaN at a sequence's last one.

        ``seq`` numbers the sequences from 0, ascending; points are in order.
        """
        n = len(seq)
        joined = seq[1:] == seq[:-1]
        after, before = np.arange(n), np.arange(n)
        after[:-1][joined] += 1
        before[1:][joined] -= 1
        new = lambda v, k: np.where(np.isnan(v[k]), v, v[k])
        gx, gy = (new(v, after) - new(v, before) for v in (x, y))
        sequences = int(seq[-1]) + 1 if n else 0
        if not len(self.roads.link):
            n = 0
        if n <= 2 * POINTS:
            pieces = [np.arange(n)]
        elif sequences == 1:
            pieces = np.split(np.arange(n), np.arange(POINTS, n, POINTS))
        else:
            raise ValueError("several sequences must fit one piece")
        z: np.ndarray | None = None
        held: int | None = None
        rows_of, backs = [], []
        for p in pieces:
            own = p if held is None else np.concatenate([[held], p])
            c, e = self._seen(x[own], y[own], gx[own], gy[own])
            some = np.flatnonzero(c["n"] > 0)
            if not len(some):
                continue
            rows, c, e = own[some], {k: v[some] for k, v in c.items()}, e[some]
            s = seq[rows]
            if z is None:
                z = np.full((sequences, self.m.top_k), -np.inf)
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                z[s[first]] = e[first] - np.array([math.log(v) for v in c["n"][first].tolist()])[:, None]
            backs.append(self._fold(c, e, x[rows], y[rows], s, z)[0 if held is None else 1 :])
            rows_of.append(rows[0 if held is None else 1 :])
            held = int(rows[-1])
        if z is None:
            return {k: np.zeros(0, np.int64 if k in ("row", "seg") else float) for k in ("row", "seg", "dist", "along", "route", "valid")}
        rows, back = np.concatenate(rows_of), np.concatenate(backs)
        s = seq[rows]
        best = np.empty(len(rows), np.int64)
        final = z.argmax(axis=1)
        for i in range(len(rows) - 1, -1, -1):
            best[i] = final[s[i]] if i == len(rows) - 1 or s[i + 1] != s[i] else back[i + 1, best[i + 1]]
        out = {"row": rows, "seg": np.empty(len(rows), np.int64), "dist": np.empty(len(rows)), "along": np.empty(len(rows)), "route": np.full(len(rows), np.nan), "valid": np.zeros(len(rows), bool)}
        for a in range(0, len(rows), 2 * POINTS):
            # the first of the next piece is needed for the way to it
            q = slice(a, min(len(rows), a + 2 * POINTS + 1))
            if len(pieces) > 1 or len(c["n"]) != len(rows):
                c = self.grid.candidates(x[rows[q]], y[rows[q]], self.m.top_k)
            k, b = np.arange(len(best[q])), best[q]
            for name in ("seg", "dist", "along"):
                out[name][q] = c[name][k, b]
            on = np.flatnonzero(s[q][1:] == s[q][:-1])
            _, route, valid = self._moves(c, x[rows[q]], y[rows[q]], on, on + 1, b[on], b[on + 1])
            out["route"][a + on], out["valid"][a + on] = np.where(valid, route, self.m.not_connected)[:, 0, 0], valid[:, 0, 0]
        return out
