"""Isolation forests, grown and asked for many sources at once."""

from __future__ import annotations

import numpy as np

TREES, SAMPLE, DEPTH = 16, 64, 6
NODES, LEAVES = 2**DEPTH - 1, 2**DEPTH


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _chance(*key: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key alone, so a repeated task grows the same forest."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in key:
            h = (np.asarray(k).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) / 2.0**53


class Forests:
    """One forest a source: random axis cuts over samples; short paths mean isolated readings.

    Node k of a level has the children 2k and 2k+1 on the next one, so a tree is
    a row of arrays and a batch of readings walks through all its trees by
    indexing.  ``feature`` and ``cut`` are (sources, trees, nodes), ``length`` is
    (sources, trees, leaves), the path length in units of the usual one.
    """

    def __init__(self, feature: np.ndarray, cut: np.ndarray, length: np.ndarray) -> None:
        self.feature, self.cut, self.length = feature, cut, length

    @classmethod
    def grown(cls, x: np.ndarray, start: np.ndarray, seed: np.ndarray, spread: np.ndarray | float = 0.0, trees: int = TREES, size: int = SAMPLE) -> Forests:
        """From the readings x[start[a]:start[a + 1]] of each source a, which are in random order.

        Each tree has its own run of ``size`` readings.  Cuts are drawn between a
        node's least and greatest value, the greatest extended by ``spread`` a
        feature, so that readings beyond everything in the sample are cut off too.
        """
        sources, width = len(start) - 1, x.shape[1]
        n = np.diff(start)
        spread = np.broadcast_to(np.asarray(spread, dtype=float), (width,))
        a, tree = np.arange(sources)[:, None, None], np.arange(trees)[None, :, None]
        s = np.asarray(seed)[:, None, None]
        k = np.arange(size)[None, None, :]
        at = (np.floor(_chance(s, tree, np.int64(1)) * np.maximum(n, 1)[:, None, None]).astype(np.int64) + k) % np.maximum(n, 1)[:, None, None]
        live = np.broadcast_to(k < n[:, None, None], at.shape)
        who = np.broadcast_to(a * trees + tree, at.shape)[live]
        rows = (start[:-1, None, None] + at)[live]
        node = np.zeros(len(rows), dtype=np.int64)
        feature, cut = np.zeros((sources * trees, NODES), np.int8), np.zeros((sources * trees, NODES), np.float32)
        length = np.zeros((sources * trees, 1))
        one = np.arange(sources * trees)[:, None]
        key = np.asarray(seed)[one // trees]
        for level in range(DEPTH):
            m = 2**level
            nodes = np.arange(m)[None, :] + m - 1
            f = np.floor(_chance(key, one % trees, nodes, np.int64(2)) * width).astype(np.int64)
            v = x[rows, f[who, node]]
            flat = who * m + node
            lo, hi = np.full(len(one) * m, np.inf), np.full(len(one) * m, -np.inf)
            np.minimum.at(lo, flat, v)
            np.maximum.at(hi, flat, v)
            count = np.bincount(flat, minlength=len(lo)).reshape(-1, m)
            lo, hi = np.where(np.isfinite(lo), lo, 0.0), np.where(np.isfinite(hi), hi, 0.0)
            hi = hi + spread[f.ravel()]
            c = (lo + _chance(key, one % trees, nodes, np.int64(3)).ravel() * (hi - lo)).reshape(-1, m).astype(np.float32)
            node = 2 * node + (v >= c[who, node])
            length = np.repeat(length + (count > 1), 2, axis=1)
            feature[:, m - 1 : 2 * m - 1], cut[:, m - 1 : 2 * m - 1] = f, c
        leaves = np.bincount(who * LEAVES + node, minlength=len(one) * LEAVES).reshape(-1, LEAVES)
        usual = np.maximum(_average_path(np.minimum(n, size)), 1e-9)
        length = ((length + _average_path(leaves)).reshape(sources, trees, LEAVES) / usual[:, None, None]).astype(np.float32)
        return cls(feature.reshape(sources, trees, NODES), cut.reshape(sources, trees, NODES), length)

    def score(self, x: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each reading of the given source; about 0.5 is usual, near 1 isolated."""
        out = np.empty(len(x))
        for i in range(0, len(x), 8192):
            out[i : i + 8192] = self._score(x[i : i + 8192], source[i : i + 8192])
        return out

    def _score(self, x: np.ndarray, source: np.ndarray) -> np.ndarray:
        trees = self.feature.shape[1]
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        tree = source * trees + np.arange(trees)[:, None]
        node = np.zeros((trees, len(x)), dtype=np.int64)
        feature, cut = self.feature.ravel(), self.cut.ravel()
        base = tree * NODES
        for level in range(DEPTH):
            k = base + (2**level - 1) + node
            node = 2 * node + (flat[row + feature[k]] >= cut[k])
        return np.power(2.0, -self.length.ravel()[tree * LEAVES + node].mean(axis=0))

    def packed(self) -> list[bytes]:
        """One text of bytes a source."""
        return [self.feature[i].tobytes() + self.cut[i].tobytes() + self.length[i].tobytes() for i in range(len(self.feature))]

    @classmethod
    def unpacked(cls, forests: list[bytes], trees: int = TREES) -> Forests:
        a, b = trees * NODES, trees * NODES * 5
        raw = np.frombuffer(b"".join(forests), dtype=np.uint8).reshape(len(forests), -1)
        part = lambda i, j, kind, width: np.ascontiguousarray(raw[:, i:j]).view(kind).reshape(len(forests), trees, width)
        return cls(part(0, a, np.int8, NODES), part(a, b, np.float32, NODES), part(b, raw.shape[1], np.float32, LEAVES))
