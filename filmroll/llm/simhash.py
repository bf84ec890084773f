"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits, cut into three blocks of 21, 21 and 22. Two fingerprints that differ in at most 4 bits
differ in at most 2 within some two of the blocks (the three pairs of blocks count every difference twice). Each
pair of blocks, 42 or 43 bits, gets a covering code: the perfect Hamming [31, 26] code on its first 31 bits, all
words on the others. Its codewords are the anchors, and its covering radius is 1.

A fingerprint is replicated to the anchors within covering radius plus threshold. Because both sides are
replicated, half the threshold is enough: two words at distance 2 have a word between them at distance 1 from
each, and that word's anchor serves both. That makes at most 28 anchors per pair of blocks, and 2^38 anchors to spread them
over. Fingerprints are compared only within an anchor, on all 64 bits, so no link within 4 bits is missed and
none beyond is made.

Only distinct fingerprints are replicated, so a group of copies costs one. Compared runs are joined within the
task, and only a star per run leaves it: no pairs of a group are emitted. An anchor with more than `RUN` members
is not compared in one task: its members are dealt to chunks, and pairs of chunks are compared in many tasks.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any other; fewer
words than a shingle has make one shingle; repeated rows each get a row; a null doc_id counts as larger than any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import returning, stored, texts
from filmroll.llm.graph import components

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: Members of an anchor that one task compares.
RUN = 512
#: Shingles unpacked at a time.
SLICE = 65_536
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 31


def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split()  # of bytes: A-Z only, and exactly space and U+0009-U+000D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    above = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        pairs = zip(starts[at:min(n, at + SLICE)].tolist(), stops[at:at + SLICE].tolist())
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64)
        above += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * above > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text as it is, and the fingerprint's 64 bits as a signed long."""
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(returning(_fingerprints), "doc_id bigint, text_hash bigint, fp bigint")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words under the Hamming code whose column at position i is i: zero for a codeword."""
    out = np.zeros_like(words)
    at = np.arange(1, CODE_BITS + 1)
    for k in range(5):
        mask = np.uint64(sum(1 << (int(i) - 1) for i in at[(at >> k) & 1 == 1]))
        out |= (np.bitwise_count(words & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def _nearest(words: np.ndarray) -> np.ndarray:
    """The codeword within distance 1 of each 31-bit word."""
    s = _syndrome(words)
    return np.where(s == 0, words, words ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys and the row of `fp` (uint64) each belongs to."""
    one = np.uint64(1)
    parts = [(fp >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in BLOCKS]
    keys, owners = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        bits = BLOCKS[a][1] + BLOCKS[b][1]
        word = parts[a] | (parts[b] << np.uint64(BLOCKS[a][1]))
        head, rest = word & np.uint64((1 << CODE_BITS) - 1), word >> np.uint64(CODE_BITS)
        own = _nearest(head)
        found = [(own, rest)] + [(own, rest ^ (one << np.uint64(j))) for j in range(bits - CODE_BITS)]
        found += [(_nearest(head ^ (one << np.uint64(i))), rest) for i in range(CODE_BITS)]
        table = np.stack([c | (r << np.uint64(CODE_BITS)) | np.uint64(k << 60) for c, r in found], axis=1)
        table.sort(axis=1)
        new = np.ones(table.shape, bool)
        new[:, 1:] = table[:, 1:] != table[:, :-1]
        rows, _ = np.nonzero(new)
        keys.append(table[new])
        owners.append(rows)
    return np.concatenate(keys), np.concatenate(owners)


def _table(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns], axis=1)


def _replicas(columns: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = _table(b, columns)
            for at in range(0, len(table), 8192):
                part = table[at:at + 8192]
                keys, rows = anchors(part[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(c[rows].view(np.int64)) for c in part.T]], ["anchor", *columns])
    return task


def _star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: each node but the smallest with the smallest."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[:len(u)], flat[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


@dataclass(frozen=True)
class Rule:
    """What links two rows, and how links are told: `columns` are fp, the node's where that is another, then marks."""
    threshold: int
    stars: bool
    columns: list[str]
    node: int
    mark_bits: int


def _links(key: np.ndarray, table: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The links within runs of equal keys (rows sorted by key), or their components as stars."""
    us, vs, held, fp, node, marks = [], [], 0, table[:, 0], table[:, rule.node], table[:, rule.node + 1:]
    at, lag = np.arange(len(key)), 1
    while True:
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= rule.threshold]
        if marks.shape[1]:
            m, n = marks[near], marks[near + lag]
            apart = np.bitwise_count(m ^ n).sum(axis=1, dtype=np.int64)
            near = near[(apart <= rule.mark_bits) | ~m.any(axis=1) | ~n.any(axis=1)]
        us.append(node[near])
        vs.append(node[near + lag])
        held += len(near)
        if rule.stars and held > 1_000_000:
            u, v = _star(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        lag += 1
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    return _star(u, v) if rule.stars else (u, v)


def _compare(limit: int | None, rule: Rule):
    """Over rows sorted by key: links of each run of at most `limit` rows, and the rows of longer runs as they are."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(hot, key, u, v, more):
            columns = [pa.array(np.full(len(key), hot)), pa.array(key), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))]
            columns += [pa.nulls(len(key), pa.int64()) if more is None else pa.array(more[:, k].view(np.int64)) for k in range(len(rule.columns) - 1)]
            return pa.RecordBatch.from_arrays(columns, ["hot", "anchor", "u", "v", *rule.columns[1:]])

        def long(key, table):
            return out(True, key, table[:, 0], table[:, 0], table[:, 1:])

        def work(key, table):
            if limit is not None:
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                size = np.repeat(np.diff(np.concatenate((first, [len(key)]))), np.diff(np.concatenate((first, [len(key)]))))
                big = size > limit
                if big.any():
                    yield long(key[big], table[big])
                    key, table = key[~big], table[~big]
            u, v = _links(key, table, rule)
            if len(u):
                yield out(False, np.zeros(len(u), np.int64), u, v, None)

        key, table, hot = np.zeros(0, np.int64), np.zeros((0, len(rule.columns)), np.uint64), None
        for b in batches:
            key = np.concatenate((key, b.column("anchor").to_numpy(zero_copy_only=False)))
            table = np.concatenate((table, _table(b, rule.columns)))
            if hot is not None and len(key):  # a run already known to be too long goes out as it comes
                more = int(np.searchsorted(key != hot, True))
                if more:
                    yield long(key[:more], table[:more])
                    key, table = key[more:], table[more:]
                hot = None if len(key) else hot
            if not len(key):
                continue
            last = int(np.flatnonzero(key == key[-1])[0])
            yield from work(key[:last], table[:last])
            key, table = key[last:], table[last:]
            if limit is not None and len(key) > limit:
                hot = int(key[0])
                yield long(key, table)
                key, table = key[:0], table[:0]
        yield from work(key, table)
    return task


_FOUND = "hot boolean, anchor bigint, u bigint, v bigint"


def links(distinct: DataFrame, threshold: int = THRESHOLD, run: int = RUN, stars: bool = True, mark_bits: int = 0) -> DataFrame:
    """`fp` (distinct) -> edges `u`, `v` whose components are those of all links of at most `threshold` bits; or, without
    `stars`, every link, some of them more than once. Columns that may follow: `id` (bigint; `fp` needn't be distinct then), which
    edges name instead of `fp`, and mark columns (bigint, named mark...): rows are linked only if their marks, together, differ
    in at most `mark_bits` bits, or all marks of one of them are 0."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")
    named = "id" in distinct.columns
    rule = Rule(threshold, stars, ["fp", *["id"] * named, *sorted(c for c in distinct.columns if c.startswith("mark"))], int(named), mark_bits)
    more = "".join(f", {c} bigint" for c in rule.columns[1:])
    spread = distinct.select(*rule.columns).mapInArrow(returning(_replicas(rule.columns)), "anchor bigint, fp bigint" + more)
    found = stored(spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(returning(_compare(run, rule)), _FOUND + more), "links")
    members = found.where("hot").select("anchor", F.col("u").alias("fp"), *rule.columns[1:])
    size = members.groupBy("anchor").agg(F.count("*").alias("m"))
    dealt = (members.join(size, "anchor").withColumn("k", F.ceil(F.col("m") / F.lit(run)).cast("int"))
             .withColumn("c", F.pmod(F.xxhash64(rule.columns[rule.node]), F.col("k")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select(F.xxhash64("anchor", F.least("c", "o"), F.greatest("c", "o")).alias("anchor"), *rule.columns))
    crowded = dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(returning(_compare(None, rule)), _FOUND + more)
    return found.where("not hot").select("u", "v").union(crowded.select("u", "v"))


def near_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) and text_hash for every row."""
    rows = stored(fingerprints(docs), "fingerprints")
    unknown = F.lit(2**63 - 1)
    own = stored(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", unknown)).alias("least")), "distinct")
    roots = components(links(own, threshold)).select(F.col("node").alias("fp"), "root")
    joined = own.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "root").select("fp", F.when(F.col("component_id") != unknown, F.col("component_id")).alias("component_id"))
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")
