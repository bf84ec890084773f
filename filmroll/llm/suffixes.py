"""Suffix order and common prefixes of a byte text by external induced sorting, to a limited depth.

A suffix smaller than its successor is of type S, any other of type L; an S after an L is an LMS suffix. Sorted LMS
suffixes induce all others: whatever is sorted is scanned in order, and each suffix's predecessor joins the queue of
its first byte. The keys of this priority queue, (first byte, turn), only grow, so it is one first-in first-out
list per byte, whose rows move to disk when all lists together outgrow `memory`. A row is a suffix's position and its common prefix with the row before it: one more
than the least common prefix scanned since that row joined. L suffixes are induced going up, S suffixes going down.

The LMS suffixes get their order from the same induction: fed with LMS positions in any order it sorts their substrings
up to the next LMS position, which are named, and the shorter text of names is ordered again, by doubling tuples
(name, next name), until names are all different or reach beyond `depth`. Tuples that outgrow memory are dealt to
files by ranges of names and sorted range by range. Common prefixes of neighbouring LMS suffixes are read off the text once;
those of all others are carried.

Beyond `depth` bytes nothing is told apart. All files are in the folder given, which the caller removes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Bytes that queues together, or an array, may take before they move to disk.
MEMORY = 128 << 20
#: Rows read at a time.
BLOCK = 1 << 19
ROW = 16


class Pool:
    """What the queues of a pass hold in memory together."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0


class Queue:
    """Rows (position, common prefix) in the order they joined; the older ones on disk once the pool is full."""

    def __init__(self, path: Path, pool: Pool):
        self.path, self.pool, self.spilt, self.size = path, pool, 0, 0
        self.blocks: list[np.ndarray] = []
        self.starts: list[int] = []

    def put(self, rows: np.ndarray) -> None:
        self.blocks.append(rows)
        self.starts.append(self.size)
        self.size += len(rows)
        self.pool.held += len(rows) * ROW
        if self.pool.held > self.pool.limit and (self.size - self.spilt) * ROW > self.pool.limit // 256:
            with self.path.open("ab") as f:
                for b in self.blocks:
                    f.write(np.ascontiguousarray(b).tobytes())
            self.pool.held -= (self.size - self.spilt) * ROW
            self.blocks, self.starts, self.spilt = [], [], self.size

    def drop(self) -> None:
        self.blocks, self.starts = [], []
        self.path.unlink(missing_ok=True)

    def _read(self, start: int, stop: int) -> np.ndarray:
        with self.path.open("rb") as f:
            f.seek(start * ROW)
            return np.frombuffer(f.read((stop - start) * ROW), np.int64).reshape(-1, 2)

    def forward(self) -> Iterator[np.ndarray]:
        """All rows, with those that join meanwhile."""
        at = 0
        while at < self.size:
            if at < self.spilt:
                rows = self._read(at, min(self.spilt, at + BLOCK))
            else:
                i = bisect_right(self.starts, at) - 1
                rows = np.concatenate([self.blocks[i][at - self.starts[i]:], *self.blocks[i + 1:]])[:BLOCK]
            at += len(rows)
            yield rows

    def backward(self) -> Iterator[np.ndarray]:
        """All rows, the last first."""
        held = np.concatenate(self.blocks) if self.blocks else np.zeros((0, 2), np.int64)
        for stop in range(len(held), 0, -BLOCK):
            yield held[max(0, stop - BLOCK):stop][::-1]
        for stop in range(self.spilt, 0, -BLOCK):
            yield self._read(max(0, stop - BLOCK), stop)[::-1]


def _turned(blocks: Iterator[np.ndarray], before: int) -> Iterator[np.ndarray]:
    """Rows read backwards, each with its common prefix with the row read before it; `before` for the first."""
    for rows in blocks:
        out = rows.copy()
        out[1:, 1] = rows[:-1, 1]
        out[0, 1] = before
        before = int(rows[-1, 1])
        yield out


class Sorter:
    """`text` (uint8) holds parts that end with a byte 0, and no other byte 0."""

    def __init__(self, text: np.ndarray, depth: int, folder: Path, memory: int = MEMORY):
        self.text, self.depth, self.folder, self.memory, self.made = text, depth, folder, memory, 0

    def _path(self) -> Path:
        self.made += 1
        return self.folder / f"{self.made}"

    def _queues(self) -> list[Queue]:
        pool = Pool(self.memory)
        return [Queue(self._path(), pool) for _ in range(256)]

    def _array(self, n: int) -> np.ndarray:
        if n * 8 <= self.memory or not n:
            return np.zeros(n, np.int64)
        return np.memmap(self._path(), dtype=np.int64, mode="w+", shape=(n,))

    def lms(self) -> np.ndarray:
        """Positions of the LMS suffixes, ascending; the last byte is one."""
        t, n, found, after = self.text, len(self.text), [], True
        for stop in range(n, 0, -BLOCK):
            start = max(0, stop - BLOCK)
            part = t[max(0, start - 1):stop + 1].astype(np.int16)
            rises = np.diff(part)  # of the byte before the block, and of the block's own
            if stop == n:
                rises = np.append(rises, 1)
            told = np.where(rises != 0, np.arange(len(rises)), len(rises))
            told = np.minimum.accumulate(told[::-1])[::-1]  # equal bytes are of their successor's type
            small = np.append(rises > 0, after)[told]
            own = small[1:] if start else small
            before = small[:-1] if start else np.concatenate(([True], small[:-1]))
            found.append(start + np.flatnonzero(own & ~before))
            after = bool(own[0])
        out = self._array(sum(map(len, found)))
        np.concatenate(found[::-1], out=out)
        return out

    def _push(self, queues: list[Queue], least: np.ndarray, rows: np.ndarray, lowest: int, highest: int) -> None:
        """The predecessors of scanned rows join their queues if their first byte is in [lowest, highest]. least[c]: the
        least common prefix scanned since a row last joined queue c."""
        pos, lcp = rows[:, 0], rows[:, 1]
        chars = np.where(pos > 0, self.text[np.maximum(pos, 1) - 1].astype(np.int64), -1)
        at = np.flatnonzero((chars >= lowest) & (chars <= highest))
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)
        left = np.minimum(least, tail[0])
        if len(at):
            at = at[np.argsort(chars[at], kind="stable")]
            c = chars[at]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            since = np.where(new, 0, np.concatenate(([0], at[:-1] + 1)))
            between = np.minimum.reduceat(np.append(lcp, 0), np.stack((since, at + 1), axis=1).ravel())[::2]
            between = np.where(new, np.minimum(between, least[c]), between)
            joined = np.stack((pos[at] - 1, np.minimum(between + 1, self.depth)), axis=1)
            first = np.flatnonzero(new)
            for a, b in zip(first, np.append(first[1:], len(at))):
                queues[c[a]].put(joined[a:b])
            last = np.append(first[1:], len(at)) - 1
            left[c[last]] = tail[at[last] + 1]
        least[:] = left

    def _border(self, c: int, a: int | None, b: int | None) -> int:
        """Common prefix of the L and the S suffix that meet within a byte's suffixes: the shorter run of the byte."""
        if a is None or b is None:
            return 0
        runs = []
        for at in (a, b):
            other = np.flatnonzero(self.text[at:at + self.depth] != c)
            runs.append(int(other[0]) if len(other) else self.depth)
        return min(runs)

    def induce(self, seeds: list[Queue]) -> tuple[list[Queue], list[Queue]]:
        """From LMS suffixes by first byte, in order: L suffixes by first byte, in order, and S suffixes, last first."""
        large, small = self._queues(), self._queues()
        least = np.zeros(256, np.int64)
        for c in range(256):
            meets, begun = None, False
            for rows in large[c].forward():
                if not begun:
                    rows = rows.copy()
                    rows[0, 1], begun = 0, True
                meets = int(rows[-1, 0])
                self._push(large, least, rows, c, 255)
            begun = False
            for rows in seeds[c].forward():
                if not begun:
                    rows = rows.copy()
                    rows[0, 1], begun = self._border(c, meets, int(rows[0, 0])), True
                self._push(large, least, rows, c + 1, 255)
        least[:] = 0
        for c in range(255, -1, -1):
            meets, begun = None, False
            for rows in small[c].forward():
                if not begun:
                    rows = rows.copy()
                    rows[0, 1], begun = 0, True
                meets = int(rows[-1, 0])
                self._push(small, least, rows, 0, c)
            if large[c].size:
                top = int(next(large[c].backward())[0, 0])
                for rows in _turned(large[c].backward(), self._border(c, top, meets)):
                    self._push(small, least, rows, 0, c - 1)
        return large, small

    def in_order(self, large: list[Queue], small: list[Queue]) -> Iterator[np.ndarray]:
        """All suffixes but the last byte's, in order, each with its common prefix with the one before."""
        for c in range(256):
            meets, begun = None, False
            for rows in large[c].forward():
                if not begun:
                    rows = rows.copy()
                    rows[0, 1], begun = 0, True
                meets = int(rows[-1, 0])
                yield rows
            if small[c].size:
                low = int(next(small[c].backward())[0, 0])
                yield from _turned(small[c].backward(), self._border(c, meets, low))

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes a[i] and b[i], up to most[i]."""
        out, n = np.zeros(len(a), np.int64), len(self.text)
        active = np.flatnonzero(most > 0)
        for step in range(int(most.max(initial=0))):
            x, y = a[active] + step, b[active] + step
            same = (y < n) & (x < n)
            same[same] = self.text[x[same]] == self.text[y[same]]
            active = active[same]
            out[active] = step + 1
            active = active[most[active] > step + 1]
            if not len(active):
                break
        return out

    def _ranked(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks told further apart. first[i]: how many are smaller than all with i's rank, all of which are given; by
        `second` within. Returns new ranks, and which are still shared."""
        n, out, shared = len(first), self._array(len(first)), np.zeros(len(first), bool)
        parts = max(1, -(-n * 32 // self.memory))
        sample = np.sort(np.asarray(first[::max(1, n // (parts * 64))]))
        edges = np.unique(sample[np.linspace(0, len(sample) - 1, parts + 1).astype(int)][1:-1]) if parts > 1 else np.zeros(0, np.int64)
        files = [self._path() for _ in range(len(edges) + 1)]
        if len(files) > 1:
            for start in range(0, n, BLOCK):
                part = np.searchsorted(edges, first[start:start + BLOCK], side="right")
                for p in np.unique(part):
                    with files[p].open("ab") as f:
                        f.write((start + np.flatnonzero(part == p)).astype(np.int64).tobytes())
        for path in files:
            at = np.arange(n) if len(files) == 1 else np.fromfile(path, np.int64) if path.exists() else np.zeros(0, np.int64)
            if not len(at):
                continue
            a, b = np.asarray(first[at]), np.asarray(second[at])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            group = np.concatenate(([True], a[1:] != a[:-1]))
            new = group | np.concatenate(([True], b[1:] != b[:-1]))
            index = np.arange(len(a))
            start = np.maximum.accumulate(np.where(new, index, 0))
            out[at[order]] = a + start - np.maximum.accumulate(np.where(group, index, 0))
            shared[at[order]] = ~new | np.append(~new[1:], False)
        return out, shared

    def _seeds(self, lms: np.ndarray, order: np.ndarray, lcp: bool) -> list[Queue]:
        seeds, n = self._queues(), len(order)
        for start in range(0, n, BLOCK):
            pos = np.asarray(lms[order[start:start + BLOCK]])
            prefix = np.zeros(len(pos), np.int64)
            if lcp:
                before = np.asarray(lms[order[max(0, start - 1):start + len(pos) - 1]])
                if start == 0:
                    before = np.concatenate(([pos[0]], before))[:len(pos)]
                prefix = self._common(before, pos, np.full(len(pos), self.depth))
            c = self.text[pos]
            by = np.argsort(c, kind="stable")
            rows, c = np.stack((pos, prefix), axis=1)[by], c[by]
            cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(c))):
                seeds[c[a]].put(rows[a:b])
        return seeds

    def sorted(self) -> Iterator[np.ndarray]:
        """All suffixes but the last byte's, in order to `depth`, each with its common prefix with the one before."""
        lms = self.lms()
        m = len(lms)
        if m == 1:
            yield from self.in_order(*self.induce(self._seeds(lms, np.arange(1), False)))
            return
        seeds = self._seeds(lms, np.arange(m), False)
        large, small = self.induce(seeds)
        for q in seeds + large:
            q.drop()
        ranks, shared, seen, rank, last = self._array(m), np.zeros(m, bool), 1, 0, None
        ends = lambda i: np.asarray(lms[np.minimum(i + 1, m - 1)]) - lms[i] + 1
        for c in range(256):
            for rows in small[c].backward():
                i = np.searchsorted(lms, rows[:, 0])
                i = i[np.asarray(lms[np.minimum(i, m - 1)]) == rows[:, 0]]
                if not len(i):
                    continue
                before = np.concatenate(([i[0] if last is None else last], i[:-1]))
                length = ends(i)
                same = ends(before) == length
                same[same] = self._common(np.asarray(lms[before[same]]), np.asarray(lms[i[same]]), length[same]) == length[same]
                if last is None:
                    same[0] = False
                found = np.maximum.accumulate(np.where(same, rank, seen + np.arange(len(i))))
                ranks[i] = found
                shared[i[same]] = shared[before[same]] = True
                seen, rank, last = seen + len(i), int(found[-1]), int(i[-1])
        for q in small:
            q.drop()
        ranks[m - 1], step = 0, 1
        open_ = np.flatnonzero(shared)
        while len(open_) and 2 * step < self.depth:
            after = open_ + step
            following = np.where(after < m, ranks[np.minimum(after, m - 1)], -1)
            ranks[open_], still = self._ranked(ranks[open_], following)
            open_, step = open_[still], 2 * step
        order = self._array(m)
        order[:] = np.argsort(ranks, kind="stable") if m * 16 <= self.memory else self._order(ranks)
        yield from self.in_order(*self.induce(self._seeds(lms, order, True)))

    def _order(self, ranks: np.ndarray) -> np.ndarray:
        """Positions by rank: ranks are made different by what comes first, and turned around."""
        at, _ = self._ranked(ranks, np.arange(len(ranks)))
        out = self._array(len(ranks))
        for start in range(0, len(at), BLOCK):
            out[at[start:start + BLOCK]] = np.arange(start, min(len(at), start + BLOCK))
        return out
