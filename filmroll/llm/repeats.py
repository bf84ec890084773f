"""Removal of repeated strings by suffix order, by external induced sorting (see `suffixes`).

A byte goes if it is in a string of LENGTH bytes that also starts earlier: in a document before, or before in the
same document. Documents are ordered by doc_id, those that share one by a hash of their text.

Equal strings must meet in one shard. Of each string of LENGTH bytes the KMER bytes with the least hash, the
leftmost of equal ones, are its anchor, a function of the string alone; strings that follow one another mostly share theirs. So a document
falls into segments, about one for every (LENGTH - KMER) / 2 bytes, each with the strings of one anchor, and shards are made
by anchor. Nothing is sampled: every string is in one segment.

* Segments that are equal as a whole are settled before any sorting: within each task, then by one shuffle of thin
  rows (anchor, digest, place), all but the first are covered. A passage in a third of all documents is one row per task.
* Anchors with one segment left have no other repeats. Of the others the different segments' bytes are shuffled by
  anchor, joined to shards of about SHARD bytes, and every shard's suffixes are sorted. Suffixes whose common
  prefix with their neighbour is LENGTH or more are one string; all but its first place are covered.

Defined cases: a null text is empty; texts of fewer than LENGTH bytes lose nothing; repeated rows (id and text) are one document
and each gets its row; a null id counts as larger than any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmroll.llm.common import stored, texts
from filmroll.llm.suffixes import Sorter
from filmroll.session import attach

LENGTH = 100
KMER = 24
SHARD = 2 << 20
#: Bytes of a document hashed at a time.
PIECE = 1 << 20
#: Rows among which a task looks for equal segments.
ROWS = 1 << 19
#: A segment's last start less its first, and whether it may repeat itself, fit beside its start in one number.
SPAN_BITS = 16
PLACE_BITS = SPAN_BITS + 1
SPAN = (1 << SPAN_BITS) - 1
LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            p = np.full(PIECE + LENGTH + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start and last start of each segment of a text (uint8), and whether its anchor stands in
    it more than once: else no string of it can be another of it, since both would have the anchor at one place."""
    found: list[tuple[np.ndarray, ...]] = []
    up, down = _tables()
    for begin in range(0, len(raw) - LENGTH + 1, PIECE):
        part = raw[begin:begin + PIECE + LENGTH - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[:len(part)], dtype=np.uint64)))
        h = (sums[KMER:] - sums[:-KMER]) * down[:len(part) - KMER + 1]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
        least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        width, size = LENGTH - KMER + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[:size - width], least[width - size:])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        anchor = h[at[first]]
        keep = np.concatenate(([True], anchor[1:] != anchor[:-1]))  # a short period finds its anchor again and again
        many = np.diff(np.append(np.flatnonzero(keep), len(keep))) > 1
        anchor, first = anchor[keep], first[keep]
        found.append((anchor, first + begin, np.append(first[1:], len(at)) - 1 + begin, many))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    anchor, start, last, many = map(np.concatenate, zip(*found))
    pieces = (last - start >> SPAN_BITS) + 1
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        anchor, low, last, many = (np.repeat(x, pieces) for x in (anchor, start, last, many))
        start = low + (nth << SPAN_BITS)
        last = np.minimum(last, start + (1 << SPAN_BITS) - 1)
    return anchor, start, last, many


_ROW = ["settled", "anchor", "digest", "doc", "nth", "place"]
_ROW_SCHEMA = "settled boolean, anchor bigint, digest bigint, doc bigint, nth int, place bigint"


def _rows(settled, anchor, digest, doc, nth, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(settled), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc),
                                       pa.array(nth.astype(np.int32)), pa.array(place)], _ROW)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment; those equal to one before among the task's rows at hand are settled already, and dealt anywhere."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        anchor, digest, doc, nth, place = map(np.concatenate, zip(*held))
        order = np.lexsort((place, nth, doc, digest, anchor))
        anchor, digest, doc, nth, place = (x[order] for x in (anchor, digest, doc, nth, place))
        like = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])))
        again = np.concatenate(([False], (doc[1:] == doc[:-1]) & (nth[1:] == nth[:-1]) & (place[1:] == place[:-1]))) & like
        anchor = np.where(like, (doc.astype(np.uint64) * np.uint64(_BASE)) ^ (place.astype(np.uint64) * np.uint64(_INVERSE)), anchor)
        digest = np.where(like, np.uint64(0), digest)
        return _rows(*(x[~again] for x in (like, anchor, digest, doc, nth, place)))

    count = 0
    for b in batches:
        for doc, nth, t in zip(b.column("doc").to_pylist(), b.column("nth").to_pylist(), b.column("text")):
            text = t.as_py().encode()
            anchor, start, last, many = segments(np.frombuffer(text, np.uint8))
            if not len(anchor):
                continue
            digest = np.fromiter((xxhash.xxh3_64_intdigest(text[a:z + LENGTH]) for a, z in zip(start.tolist(), last.tolist())), np.uint64, len(start))
            held.append((anchor, digest, np.full(len(start), doc, np.int64), np.full(len(start), nth, np.int64), (start << PLACE_BITS) | (many.astype(np.int64) << SPAN_BITS) | (last - start)))
            count += len(start)
            if count >= ROWS:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest and place. Out come settled rows (all of equal segments but the first), and the first
    ones whose anchor has others, or stands in them more than once."""
    last: tuple | None = None  # the row before
    open_: tuple | None = None  # the first row that waits for another of its anchor, and if one came already
    for b in batches:
        settled, anchor, digest, doc, nth, place = (b.column(c).to_numpy(zero_copy_only=False) for c in _ROW)
        if settled.any():
            yield _rows(settled[settled], *(x[settled] for x in (anchor, digest, doc, nth, place)))
            anchor, digest, doc, nth, place = (x[~settled] for x in (anchor, digest, doc, nth, place))
        if not len(anchor):
            continue
        before = last or (anchor[0], ~digest[0], 0, 0, 0)
        shifted = [np.concatenate(([v], x[:-1])) for v, x in zip(before, (anchor, digest, doc, nth, place))]
        like = (anchor == shifted[0]) & (digest == shifted[1])
        again = like & (doc == shifted[2]) & (nth == shifted[3]) & (place == shifted[4])
        last = tuple(x[-1] for x in (anchor, digest, doc, nth, place))
        copies = like & ~again
        if copies.any():
            yield _rows(np.ones(copies.sum(), bool), *(x[copies] for x in (anchor, digest, doc, nth, place)))
        first = [x[~like] for x in (anchor, digest, doc, nth, place)]
        known = np.zeros(len(first[0]), bool)
        if open_ is not None:
            first = [np.concatenate(([v], x)) for v, x in zip(open_[0], first)]
            known = np.concatenate(([open_[1]], known))
        if not len(first[0]):
            continue
        same = first[0][1:] == first[0][:-1]
        some = known | np.append(same, False) | np.concatenate(([False], same)) | ((first[4] >> SPAN_BITS & 1) == 1)
        out = some.copy()
        out[-1] = False
        if out.any():
            yield _rows(np.zeros(out.sum(), bool), *(x[out] for x in first))
        open_ = (tuple(x[-1] for x in first), bool(some[-1]))
    if open_ is not None and open_[1]:
        yield _rows(np.zeros(1, bool), *(np.array([v]) for v in open_[0]))


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments wanted of each document."""
    for b in batches:
        for doc, nth, t, wanted in zip(b.column("doc").to_pylist(), b.column("nth").to_pylist(), b.column("text"), b.column("wanted").to_pylist()):
            text = t.as_py().encode()
            place = np.array([w["place"] for w in wanted], np.int64)
            starts, spans = place >> PLACE_BITS, place & SPAN
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array(np.full(len(place), doc, np.int64)), pa.array(np.full(len(place), nth, np.int32)),
                 pa.array(place), pa.array([text[a:a + n + LENGTH] for a, n in zip(starts.tolist(), spans.tolist())], pa.binary())],
                ["anchor", "doc", "nth", "place", "bytes"])


def _runs(doc: np.ndarray, nth: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Covered starts as stretches of bytes."""
    order = np.lexsort((start, nth, doc))
    doc, nth, start = doc[order], nth[order], start[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (start[1:] > start[:-1] + LENGTH)))
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(nth[first].astype(np.int32)), pa.array(start[first]),
                                       pa.array(start[np.append(first[1:], len(start)) - 1] + LENGTH)], ["doc", "nth", "start", "stop"])


class _Shard:
    """Segments of whole anchors: their bytes in a file, their places at hand."""

    def __init__(self, folder: Path):
        self.folder, self.size, self.rows = folder, 0, []
        self.file = (folder / "text").open("wb")

    def add(self, doc: int, nth: int, place: int, raw: bytes) -> None:
        self.rows.append((self.size, doc, nth, place))
        self.file.write(raw + b"\xff")  # no byte of UTF-8
        self.size += len(raw) + 1

    def covered(self) -> Iterator[pa.RecordBatch]:
        self.file.close()
        text = np.memmap(self.folder / "text", dtype=np.uint8, mode="r+")
        for at in range(0, len(text), 1 << 24):
            text[at:at + (1 << 24)] += np.uint8(1)
        at, doc, nth, place = np.array(self.rows, np.int64).T
        start, span = place >> PLACE_BITS, place & SPAN
        least = None  # place of the string at hand that comes first so far
        for rows in Sorter(text, LENGTH, self.folder).sorted():
            group = np.cumsum(rows[:, 1] < LENGTH)
            seg = np.searchsorted(at, rows[:, 0], side="right") - 1
            own = rows[:, 0] - at[seg] <= span[seg]
            final = int(group[-1])
            group, seg, pos = group[own], seg[own], rows[own, 0]
            d, n, s = doc[seg], nth[seg], start[seg] + pos - at[seg]
            if least is not None:
                d, n, s, group = (np.concatenate(([v], x)) for v, x in zip((*least, 0), (d, n, s, group)))
            if not len(d):
                continue
            order = np.lexsort((s, n, d, group))
            d, n, s, group = d[order], n[order], s[order], group[order]
            new = np.concatenate(([True], group[1:] != group[:-1]))
            if (~new).any():
                yield _runs(d[~new], n[~new], s[~new])
            tail = np.flatnonzero(new)[-1]
            least = (d[tail], n[tail], s[tail]) if group[tail] == final else None


def _shards(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Path(tempfile.mkdtemp(prefix="suffixes-"))  # of this task alone
        try:
            shard, last, made = None, None, 0
            for b in batches:
                for anchor, doc, nth, place, raw in zip(*(b.column(c) for c in ("anchor", "doc", "nth", "place", "bytes"))):
                    anchor = anchor.as_py()
                    if shard is not None and anchor != last and shard.size >= size:
                        yield from shard.covered()
                        shutil.rmtree(shard.folder)
                        shard = None
                    if shard is None:
                        made += 1
                        folder = top / str(made)
                        folder.mkdir()
                        shard = _Shard(folder)
                    last = anchor
                    shard.add(doc.as_py(), nth.as_py(), place.as_py(), raw.as_py())
            if shard is not None:
                yield from shard.covered()
        finally:
            shutil.rmtree(top, ignore_errors=True)
    return task


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (the id, null as the largest), nth (among texts that share the id) and text."""
    t = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", F.xxhash64("text").alias("hash"))
    several = t.groupBy("doc").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high").select("doc")
    others = (t.join(several, "doc", "left_semi").select("doc", "hash").distinct()
              .withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("hash")) - 1).where("nth > 0"))
    return attach(t, others, ["doc", "hash"], "left", label="same-ids").select("doc_id", "doc", F.coalesce("nth", F.lit(0)).alias("nth"), "text")


def covered(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc, nth, spans (start, stop, in order, apart) of every document of `_numbered` that loses something."""
    thin = docs.select("doc", "nth", "text").mapInArrow(_cut, _ROW_SCHEMA)
    settled = stored(thin.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc", "nth", "place").mapInArrow(_settle, _ROW_SCHEMA), "segments")
    wanted = settled.where("not settled").groupBy("doc", "nth").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))
    # what is wanted grows with the documents, so it is never broadcast on purpose
    bytes_ = docs.select("doc", "nth", "text").join(wanted, ["doc", "nth"]).select("doc", "nth", "text", "wanted").mapInArrow(
        _take, "anchor bigint, doc bigint, nth int, place bigint, bytes binary")
    sorted_ = bytes_.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(shard), "doc bigint, nth int, start bigint, stop bigint")
    start = F.shiftright("place", PLACE_BITS)
    whole = settled.where("settled").select("doc", "nth", start.alias("start"), (start + F.col("place").bitwiseAND(SPAN) + LENGTH).alias("stop"))
    each = Window.partitionBy("doc", "nth").orderBy("start", "stop")
    reach = F.max("stop").over(each.rowsBetween(Window.unboundedPreceding, -1))
    spans = (whole.union(sorted_).withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
             .withColumn("span", F.sum("new").over(each)).groupBy("doc", "nth", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    return spans.groupBy("doc", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, sizes, spans = [], [], b.column("spans").to_pylist()
        for t, ss in zip(b.column("text"), spans):
            raw, at, out = t.as_py().encode(), 0, []
            for s in ss or ():
                out.append(raw[at:s["start"]])
                at = s["stop"]
            out.append(raw[at:])
            kept.append(b"".join(out))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([len(s or ()) for s in spans], pa.int64()),
                                          pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_spans (maximal removed runs) and kept (the remaining bytes) of every row of `docs`."""
    rows = _numbered(docs)
    found = attach(rows, covered(rows, shard), ["doc", "nth"], "left", label="spans")
    return found.select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id bigint, n_bytes bigint, n_spans bigint, kept binary")


def digests(stripped: DataFrame) -> DataFrame:
    return stripped.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), "n_spans",
                           F.sha2("kept", 256).alias("kept_sha256"))
