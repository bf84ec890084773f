"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of words with a smallest period q that repeats at least twice, `least` words long or longer, and can't
be extended on either side. Every word of one stands in a shingle of `shingle(least)` words that the text has twice, q
words apart; so words in no repeated shingle are left out first, and what lies between them is taken as a part.

1. Re-Pair: the most frequent pair of neighbouring word ids becomes a nonterminal, ties in order of first appearance,
   until no pair occurs twice. What is left of a part is joined by halves, so every part has one root.
2. Each nonterminal is taken once, where it first occurs. A run across the boundary between its two sides holds a whole
   period right or left of it, so the period is the distance from the word before the boundary to an equal one after it, or
   from the word after it to an equal one before. Candidates go up by period; a multiple of a period, whose two
   words lie in a run already found there, is that run. How far a period reaches is found by comparing blocks that double in length.
3. A nonterminal's runs are moved to all places it is derived at. A run lies across the boundary of the lowest
   nonterminal that holds all of it, so it is found whole; shorter findings of the same period that overlap it by a
   period or more are merged into it.

Defined cases: a null or empty text, or one of white space, has no words and no runs; repeated rows each get a row; null
ids stay null; an empty table gives no rows; other columns are ignored. A text is worked on in one task, in memory that
grows with its own length only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import texts

#: Fewest words of a run.
LEAST = 12
#: Text bytes worked on at a time.
SLICE = 4 << 20
#: White space between words, a fixed value.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string"


def shingle(least: int) -> int:
    """A run of length n >= max(least, 2 q) has n - q >= least / 2 words that equal the word q further on."""
    return max(1, (least + 1) // 2)


def parts(ids: np.ndarray, texts_of: np.ndarray, width: int) -> np.ndarray:
    """Which words stand in a shingle of `width` words that their text has at least twice. A collision of hashes keeps
    words that could go, and never drops one."""
    n = len(ids)
    keep = np.zeros(n, bool)
    if n < width:
        return keep
    h = np.zeros(n - width + 1, np.uint64)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k:n - width + 1 + k]
    h ^= h >> np.uint64(32)
    inside = texts_of[:n - width + 1] == texts_of[width - 1:]
    h = (h * np.uint64(0x9E3779B97F4A7C15) + texts_of[:n - width + 1].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    h, at = h[inside], np.flatnonzero(inside)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = at[twice]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


class Grammar:
    """Re-Pair over several sequences: `rules[k]` is the pair that nonterminal `first + k` stands for."""

    def __init__(self, sequences: list[list[int]], first: int):
        self.first, self.rules = first, []
        symbols: list[int | None] = []
        for s in sequences:
            symbols += [*s, None]  # no pair reaches over a None
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple, dict[int, None]] = defaultdict(dict)
        for i in range(n - 1):
            if symbols[i] is not None and symbols[i + 1] is not None:
                places[symbols[i], symbols[i + 1]][i] = None
        born = {p: k for k, p in enumerate(places)}
        heap = [(-len(at), born[p], p) for p, at in places.items() if len(at) > 1]
        heapify(heap)

        def gone(i, pair):
            at = places.get(pair)
            if at is not None:
                at.pop(i, None)

        def come(i, pair, touched):
            places[pair][i] = None
            born.setdefault(pair, len(born))
            touched[pair] = None

        while heap:
            size, _, pair = heappop(heap)
            at = places.get(pair)
            if at is None or len(at) < 2:
                continue
            if len(at) != -size:
                heappush(heap, (-len(at), born[pair], pair))
                continue
            del places[pair]
            new, touched, made = self.first + len(self.rules), {}, 0
            for i in sorted(at):
                j = after[i]
                if j >= n or (symbols[i], symbols[j]) != pair:
                    continue  # overlapped by the occurrence before it
                left, right = before[i], after[j]
                if left >= 0 and symbols[left] is not None:
                    gone(left, (symbols[left], pair[0]))
                if right < n and symbols[right] is not None:
                    gone(j, (pair[1], symbols[right]))
                symbols[i], symbols[j] = new, -1
                after[i] = right
                if right < n:
                    before[right] = i
                if left >= 0 and symbols[left] is not None:
                    come(left, (symbols[left], new), touched)
                if right < n and symbols[right] is not None:
                    come(i, (new, symbols[right]), touched)
                made += 1
            if made:
                self.rules.append(pair)
            for p in touched:
                if len(places.get(p, ())) > 1:
                    heappush(heap, (-len(places[p]), born[p], p))
        self.left: list[list[int]] = [[]]
        i = 0
        while i < n:
            if symbols[i] is None:
                self.left.append([])
            else:
                self.left[-1].append(symbols[i])
            i = after[i]
        self.left.pop()

    def rooted(self) -> list[int]:
        """The root of every sequence: what is left of it is joined by halves."""
        def join(found: list[int]) -> int:
            while len(found) > 1:
                joined = []
                for k in range(0, len(found) - 1, 2):
                    self.rules.append((found[k], found[k + 1]))
                    joined.append(self.first + len(self.rules) - 1)
                found = joined + found[len(found) & ~1:]
            return found[0]
        return [join(s) for s in self.left]


class Text:
    """The words of one part after another, with what is needed to compare any two stretches of one."""

    def __init__(self, ids: list[int]):
        self.ids, self.raw = ids, np.array(ids, "<i4").tobytes()
        self.at: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(ids):
            self.at[w].append(i)

    def right(self, i: int, j: int, stop: int) -> int:
        """How many words from i and from j on are equal; j > i, and none at `stop` or beyond is looked at."""
        ids, most, n = self.ids, stop - j, 0
        while n < most and n < 8:
            if ids[i + n] != ids[j + n]:
                return n
            n += 1
        step = 16
        while n < most:
            step = min(step, most - n)
            if self.raw[4 * (i + n):4 * (i + n + step)] == self.raw[4 * (j + n):4 * (j + n + step)]:
                n += step
                step *= 2
            elif step == 1:
                break
            else:
                step = max(1, step // 4)
        return n

    def left(self, i: int, j: int, start: int) -> int:
        """How many words before i and before j are equal; i < j, and none before `start` is looked at."""
        ids, most, n = self.ids, i - start, 0
        while n < most and n < 8:
            if ids[i - 1 - n] != ids[j - 1 - n]:
                return n
            n += 1
        step = 16
        while n < most:
            step = min(step, most - n)
            if self.raw[4 * (i - n - step):4 * (i - n)] == self.raw[4 * (j - n - step):4 * (j - n)]:
                n += step
                step *= 2
            elif step == 1:
                break
            else:
                step = max(1, step // 4)
        return n

    def across(self, lo: int, b: int, hi: int, least: int) -> list[tuple[int, int, int]]:
        """Runs (start, end, period) of [lo, hi) across the boundary between words b - 1 and b."""
        ids, at = self.ids, self.at
        after, before = at[ids[b - 1]], at[ids[b]]
        gaps = {i - b + 1 for i in after[bisect_left(after, b):bisect_left(after, hi)]}
        gaps.update(b - i for i in before[bisect_left(before, lo):bisect_left(before, b)])
        found: list[tuple[int, int, int]] = []
        for q in sorted(gaps):
            for i, j in ((b, b + q), (b - q, b)):  # a whole period right of the boundary, or left of it
                if i < lo or j > hi or any(q % p == 0 and s <= i - (i == b) and j - (i == b) < e for s, e, p in found):
                    continue
                s, e = i - self.left(i, j, lo), j + self.right(i, j, hi)
                if e - s >= max(least, 2 * q) and s < b < e and (s, e, q) not in found[-1:]:
                    found.append((s, e, q))
        return found


def runs_of(ids: list[int], stretches: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the words `ids` within the stretches [start, end)."""
    text = Text([w for a, b in stretches for w in ids[a:b]])
    first = max(text.ids) + 1
    grammar = Grammar([ids[a:b] for a, b in stretches], first)
    roots = grammar.rooted()

    length = [1] * first
    for a, b in grammar.rules:
        length.append(length[a] + length[b])
    base, held = [0], deque()
    for a, b in stretches:
        base.append(base[-1] + b - a)
    places: dict[int, list[int]] = defaultdict(list)
    for root, at in zip(roots, base):
        held.append((root, at))
    # all places of a nonterminal are known once every rule that uses it was opened: later rules never stand in earlier ones
    for root, at in held:
        places[root].append(at)
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for x in range(first + len(grammar.rules) - 1, first - 1, -1):
        at = places.pop(x, [])
        if not at:
            continue
        y, z = grammar.rules[x - first]
        places[y] += at
        places[z] += [p + length[y] for p in at]
        if length[x] < least:
            continue
        lo = at[0]
        for s, e, q in text.across(lo, lo + length[y], lo + length[x], least):
            merged[q] += [(s - lo + p, e - lo + p) for p in at]

    out = []
    offset = [a - x for (a, _), x in zip(stretches, base)]
    for q, spans in merged.items():
        spans.sort()
        now = list(spans[0])
        for s, e in [*spans[1:], (len(text.ids) + q, 0)]:
            if s + q <= now[1]:
                now[1] = max(now[1], e)
            else:
                part = bisect_left(base, now[0] + 1) - 1
                out.append((now[0] + offset[part], now[1] - now[0], q))
                now = [s, e]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Without the words of each run after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone) if not g]


def _stretches(keep: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]


def find(batch: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs, and kept text of each text of a batch."""
    known: dict[bytes, int] = {}
    words = [t.split() for t in batch]
    ids = [[known.setdefault(w, len(known)) for w in ws] for ws in words]
    sizes = np.array([len(i) for i in ids])
    flat = np.fromiter((i for d in ids for i in d), np.int64, int(sizes.sum()))
    keep = parts(flat, np.repeat(np.arange(len(ids)), sizes), shingle(least))
    out, start = [], 0
    for ws, numbers in zip(words, ids):
        mask = keep[start:start + len(ws)]
        start += len(ws)
        stretches = _stretches(mask, least) if mask.any() else []
        runs = runs_of(numbers, stretches, least) if stretches else []
        out.append((len(ws), runs, b" ".join(kept_words(ws, runs))))
    return out


def _task(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(docs, held):
            found = find(held, least)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in f[1]] for f in found], pa.list_(RUN)),
                 pa.array([f[2].decode() for f in found], pa.string())], ["doc_id", "n_words", "runs", "kept"])

        for b in batches:
            docs, held, size = [], [], 0
            for d, t in zip(b.column("doc_id"), b.column("text")):
                docs.append(d.as_py())
                held.append(t.as_py().encode())
                size += len(held[-1])
                if size > SLICE:
                    yield out(docs, held)
                    docs, held, size = [], [], 0
            if docs:
                yield out(docs, held)
    return task


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text of the words that are kept, of every row of `docs`."""
    if least < 2:
        raise ValueError("a run has two words at least")
    return texts(docs).mapInArrow(_task(least), SCHEMA)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one of ten documents, by a checksum of the id, the words from a point on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = words(F.col("text"))
    n = F.size("_w")
    cut = texts(docs).withColumns({"_g": g, "_w": F.when(h % 10 == 0, w)}).withColumn("_a", F.when(n > 0, F.col("_g") % n))
    cut = cut.withColumn("_p", F.floor((n - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1)
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    looped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", at(i).cast("int")))
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document, and the digests of its runs and of its kept text."""
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(key)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "runs", "kept", best.alias("best"), lines.alias("lines")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256"))
