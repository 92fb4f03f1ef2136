"""Byte-pair encoding by speculation: longest matches first, then proof or exact merging."""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np

NEVER = np.iinfo(np.int64).max
#: White space as Unicode defines it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words of up to so many bytes are merged by going over all pairs again and again.
FEW = 48
#: Pieces of a long text that are handled together.
PIECES = 1_000_000


@lru_cache(maxsize=1)
def splitter() -> re.Pattern[str]:
    """The pieces that merges never cross: contractions, letters, digits, other signs, white space.

    The standard library's matcher is several times faster than general property
    lookups once the categories are plain character classes.
    """

    def ranges(kind: str) -> str:
        inside = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2], edge[1::2]))

    letters, digits = ranges("L"), ranges("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: The same for texts of ASCII alone, where short classes match twice as fast.
ASCII_SPLITTER = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _room(v: np.ndarray, size: int) -> np.ndarray:
    """``v`` with room for ``size`` values; it doubles, so that growing costs no more than what is put in."""
    if len(v) >= size:
        return v
    out = np.zeros(max(size, 2 * len(v), 1024), v.dtype)
    out[: len(v)] = v
    return out


class BytePairs:
    """A vocabulary whose ids are the order of its merges, as in rank files."""

    def __init__(self, rank_file: bytes) -> None:
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        n = max(self.ids.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.pair: dict[tuple[int, int], int] = {}
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merge(token)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                    self.pair[parts[0], parts[1]] = i
        keys = np.array([a << 32 | b for a, b in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._merged = keys[order], np.array(list(self.pair.values()), dtype=np.int64)[order]
        self._reach: dict[bytes, int] = {}
        for token in self.ids:
            self._reach[token[:2]] = max(self._reach.get(token[:2], 1), len(token))
        self.known: dict[str, int] = {}
        self._used = 0
        self._flat, self._at, self._len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.failed = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the earliest merge, the leftmost of equals."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > FEW:
            return self._merge_many(parts)
        while len(parts) > 1:
            least = min(self.pair.get(p, NEVER) for p in zip(parts, parts[1:]))
            if least == NEVER:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.pair.get((parts[i], parts[i + 1])) == least:
                    merged.append(least)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _merge_many(self, parts: list[int]) -> list[int]:
        """The same with a heap of merges and linked neighbours, n log n in the word's length."""
        n, pair = len(parts), self.pair
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pair.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, a, b = heapq.heappop(heap)
            j = behind[i]
            # outdated if either part was merged meanwhile; a merged right part is -1
            if j == n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = merged, -1
            k = behind[i] = behind[j]
            if k < n:
                before[k] = i
                if (r := pair.get((merged, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, merged, parts[k]))
            h = before[i]
            if h >= 0 and (r := pair.get((parts[h], merged))) is not None:
                heapq.heappush(heap, (r, h, parts[h], merged))
        return [p for p in parts if p >= 0]

    def longest(self, word: bytes) -> list[int]:
        """Speculation: the longest token from each place on."""
        out, i, n = [], 0, len(word)
        while i < n:
            size = min(n - i, self._reach.get(word[i : i + 2], 1))
            while word[i : i + size] not in self.ids:
                size -= 1
            out.append(self.ids[word[i : i + size]])
            i += size
        return out

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._merged[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave the border between tokens a and b alone.

        Time runs backwards: the younger of the two tokens at the border is undone
        to its part at the border.  At every stage a merge across the border must
        not come before the merge that ended the stage; of equal merges the left
        one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        ended = np.full(len(a), NEVER)
        while len(live):
            x, y, end = a[live], b[live], ended[live]
            across = self._merge_of(x, y) < end
            ok[live[across]] = False
            undo_a = x > y
            whole = np.where(undo_a, self.left[x] == x, self.left[y] == y)
            ended[live] = np.where(undo_a, x, y + 1)
            a[live], b[live] = np.where(undo_a, self.right[x], x), np.where(undo_a, y, self.left[y])
            live = live[~across & ~whole]
        return ok

    def _learn(self, words: list[str]) -> None:
        """Encodes words not seen before: speculate, verify all borders at once, merge what fails."""
        guess = [self.longest(w.encode("utf-8", "surrogatepass")) for w in words]
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(guess)), size)
        border = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[border] << 32 | flat[border + 1], return_inverse=True)
        wrong = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(word[border[wrong]])
        for i in failing:
            guess[i] = self.merge(words[i].encode("utf-8", "surrogatepass"))
        self.failed += len(failing)
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        n, used = len(self.known), self._used
        self._len, self._at = _room(self._len, n + len(words)), _room(self._at, n + len(words))
        self._flat = _room(self._flat, used + int(size.sum()))
        self._len[n : n + len(words)], self._at[n : n + len(words)] = size, used + np.cumsum(size) - size
        self._flat[used : used + int(size.sum())] = np.fromiter(chain.from_iterable(guess), np.int32, int(size.sum()))
        self._used = used + int(size.sum())
        for i, w in enumerate(words, n):
            self.known[w] = i

    def _pieces(self, text: str) -> Iterator[list[str]]:
        pattern = ASCII_SPLITTER if text.isascii() else splitter()
        if len(text) <= PIECES:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while part := list(islice(found, PIECES)):
                yield part

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in the table; new ones are learnt together first."""
        try:
            return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            # a bound on memory, not on what is encoded: the table is rebuilt from what comes
            if len(self.known) > 2_000_000:
                self.known.clear()
                self._used = 0
            self._learn([w for w in dict.fromkeys(pieces) if w not in self.known])
            return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of pieces as (places in the table, first piece of each text that begins in the run)."""
        pieces: list[str] = []
        begin: list[int] = []
        for t in texts:
            begin.append(len(pieces))
            for p in self._pieces(t) if t else ():
                if len(pieces) + len(p) > PIECES and pieces:
                    yield self._numbers(pieces), np.array(begin, dtype=np.int64)
                    pieces, begin = [], []
                pieces += p
        yield self._numbers(pieces), np.array(begin, dtype=np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        at, total = [], 0
        for k, begin in self._parts(texts):
            upto = np.concatenate([[0], np.cumsum(self._len[k])])
            at.append(total + upto[begin])
            total += int(upto[-1])
        return np.diff(np.append(np.concatenate(at), total))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; null and empty texts have none."""
        out, at, total = [], [], 0
        for k, begin in self._parts(texts):
            size = self._len[k]
            upto = np.concatenate([[0], np.cumsum(size)])
            # a piece's ids are consecutive in the table
            out.append(self._flat[np.arange(upto[-1]) + np.repeat(self._at[k] - upto[:-1], size)])
            at.append(total + upto[begin])
            total += int(upto[-1])
        return np.append(np.concatenate(at), total), np.concatenate(out)


@lru_cache(maxsize=2)
def load(rank_file: bytes) -> BytePairs:
    """One vocabulary a worker process; its table of words is kept between batches."""
    return BytePairs(rank_file)
